"""Publishing a feature table to a row store over JDBC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish_table(
    df: DataFrame,
    jdbc: Mapping[str, str],
    table: str,
    mode: str = "overwrite",
    columns: Sequence[str] | None = None,
    connections: int = 8,
    batch_rows: int = 10_000,
) -> int:
    """Write the frame, or some of its columns, to an online table and return its row count.

    Every task commits its own partition. A task that is lost after its commit runs again and repeats its rows, so
    the published rows are counted against the source, and a difference is an error rather than a bad table in use.
    """
    # Dealt out before the writer narrows its tasks to the connections, which would narrow the query above it too.
    rows = (df.select(*columns) if columns else df).repartition(connections)
    expected = rows.count()
    options = {**jdbc, "dbtable": table}
    before = 0
    if mode == "append":
        before = _count(rows, options)
    (
        rows.write.format("jdbc")
        .options(**options, numPartitions=str(connections), batchsize=str(batch_rows))
        .mode(mode)
        .save()
    )
    published = _count(rows, options) - before
    if published != expected:
        raise RuntimeError(f"{table} received {published} rows for {expected}; publish it again")
    return published


def _count(df: DataFrame, options: Mapping[str, str]) -> int:
    reader = df.sparkSession.read.format("jdbc").options(**options)
    return reader.load().agg(F.count(F.lit(1))).first()[0]
