"""Namespaces, managed tables, previews and snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def quoted(name: str) -> str:
    """A one- to three-part table name, quoted for SQL."""
    return ".".join("`" + part.strip("`").replace("`", "``") + "`" for part in name.split("."))


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}{where}")


def save_table(
    df: DataFrame,
    name: str,
    mode: str = "overwrite",
    table_format: str = "parquet",
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
    swap: bool = True,
) -> None:
    """Save a frame as a managed table.

    An overwrite writes a new table and swaps it in at the end, so a failed job leaves the old table as it was and
    the frame may read the table it replaces. A store without renames copies on a swap; ``swap=False`` overwrites in
    place there. Buckets let later joins and lookups by the same key skip their shuffle.
    """
    spark = df.sparkSession
    replacing = swap and mode == "overwrite" and spark.catalog.tableExists(name)
    target = f"{name}__new_{uuid.uuid4().hex[:12]}" if replacing else name
    if buckets:
        keys = list(bucket_by)
        writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    else:
        writer = df.write
    try:
        writer.format(table_format).mode("errorifexists" if replacing else mode).saveAsTable(target)
    except Exception:
        if replacing:
            spark.sql(f"DROP TABLE IF EXISTS {quoted(target)}")
        raise
    if replacing:
        swap_table(spark, name, target)


def swap_table(spark: SparkSession, name: str, new: str, keep_as: str | None = None) -> None:
    """Put the table ``new`` in the place of ``name`` and drop what was there, or keep it as ``keep_as``.

    These are two renames, so a reader between them meets no table. Should the second one fail, the first is taken
    back and the error raised.
    """
    old = keep_as or f"{name}__old_{uuid.uuid4().hex[:12]}"
    spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(old)}")
    try:
        spark.sql(f"ALTER TABLE {quoted(new)} RENAME TO {quoted(name)}")
    except Exception:
        spark.sql(f"ALTER TABLE {quoted(old)} RENAME TO {quoted(name)}")
        raise
    if not keep_as:
        spark.sql(f"DROP TABLE {quoted(old)}")


def preview(df: DataFrame, keys: str | Sequence[str], rows: int = 100) -> DataFrame:
    """The first rows by key: the same ones each time, found without sorting the frame as a whole."""
    names = [keys] if isinstance(keys, str) else list(keys)
    return df.orderBy(*names).limit(rows)


def snapshot_table(spark: SparkSession, source: str, target: str, table_format: str = "parquet") -> None:
    """Copy a table under a new name unless that name exists; later writes to the source do not reach the copy."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted(target)} USING {table_format} AS SELECT * FROM {quoted(source)}"
    )
