"""Feature tables: managed tables that are unique by their primary keys and carry them as table properties."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.profile import primary_key_audit
from holdfast.sources.tables import quoted, save_table, swap_table

KEYS_PROPERTY = "holdfast.primary_keys"
BUCKETS_PROPERTY = "holdfast.buckets"
DESCRIPTION_PROPERTY = "holdfast.description"
VERSION_PROPERTY = "holdfast.version"


@dataclass(frozen=True)
class FeatureTable:
    name: str
    primary_keys: tuple[str, ...]
    features: tuple[str, ...]
    description: str


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {row["key"]: row["value"] for row in spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()}


def _is_temporary(spark: SparkSession, name: str) -> bool:
    return spark.catalog.getTable(name).isTemporary


def primary_keys_of(spark: SparkSession, name: str) -> list[str]:
    """The primary keys a table was created with; empty for a table that is no feature table."""
    if _is_temporary(spark, name):
        return []
    return json.loads(_properties(spark, name).get(KEYS_PROPERTY, "[]"))


def create_feature_table(
    name: str,
    primary_keys: str | Sequence[str],
    df: DataFrame,
    description: str = "",
    buckets: int = 0,
) -> FeatureTable:
    """Write ``df`` as a feature table; the name must be free and the keys non-NULL and unique.

    The keys are checked on the written table, so the frame is computed once, and the table becomes a feature table
    only after they pass. ``buckets`` stores it hashed and sorted by its keys for lookups without a shuffle.
    """
    spark = df.sparkSession
    keys = [primary_keys] if isinstance(primary_keys, str) else list(primary_keys)
    missing = [key for key in keys if key not in df.columns]
    if missing or not keys:
        raise ValueError(f"primary keys not in the frame: {missing or 'none given'}")
    if spark.catalog.tableExists(name):
        raise ValueError(f"table {name} already exists")
    save_table(df, name, mode="errorifexists", bucket_by=keys, buckets=buckets)
    audit = primary_key_audit(spark.table(name), keys).first()
    if audit["null_key_rows"] or audit["surplus_rows"]:
        spark.sql(f"DROP TABLE {quoted(name)}")
        raise ValueError(
            f"{name} is not unique by {keys}: {audit['null_key_rows']} rows with a NULL key, "
            f"{audit['surplus_rows']} surplus rows"
        )
    spark.sql(
        f"ALTER TABLE {quoted(name)} SET TBLPROPERTIES "
        f"('{KEYS_PROPERTY}' = {_text(json.dumps(keys))}, '{DESCRIPTION_PROPERTY}' = {_text(description)}, "
        f"'{BUCKETS_PROPERTY}' = '{buckets}')"
    )
    spark.sql(f"COMMENT ON TABLE {quoted(name)} IS {_text(description)}")
    return get_feature_table(spark, name)


def refresh_feature_table(name: str, df: DataFrame, description: str | None = None, keep: int = 0) -> FeatureTable:
    """Replace the rows of a feature table; its keys, buckets and, without a new one, its description stay.

    The new table is written and its keys are checked before it takes the old one's place, so the frame may read the table,
    and a failed refresh leaves it as it was. Saved lookups find the refreshed rows under the same name. Each refresh counts
    the version up by one; the last ``keep`` versions before it stay under names of their own, see ``table_at``.
    """
    spark = df.sparkSession
    table = get_feature_table(spark, name)
    buckets = int(_properties(spark, name).get(BUCKETS_PROPERTY, "0"))
    said = table.description if description is None else description
    version = feature_table_version(spark, name)
    new = f"{name}__new_{uuid.uuid4().hex[:12]}"
    create_feature_table(new, table.primary_keys, df, said, buckets)
    spark.sql(f"ALTER TABLE {quoted(new)} SET TBLPROPERTIES ('{VERSION_PROPERTY}' = '{version + 1}')")
    swap_table(spark, name, new, _kept_name(name, version) if keep else None)
    for old in _kept_versions(spark, name):
        if old <= version - keep:
            spark.sql(f"DROP TABLE IF EXISTS {quoted(_kept_name(name, old))}")
    return get_feature_table(spark, name)


def feature_table_version(spark: SparkSession, name: str) -> int:
    """1 for a table as it was created, and one more after each refresh."""
    return int(_properties(spark, name).get(VERSION_PROPERTY, "1"))


def table_at(spark: SparkSession, name: str, version: int) -> str:
    """The table that holds a version of a feature table: the table itself, or the one that a refresh kept."""
    if feature_table_version(spark, name) == version:
        return name
    kept = _kept_name(name, version)
    if not spark.catalog.tableExists(kept):
        raise ValueError(f"version {version} of {name} is not kept; its last refreshes kept {_kept_versions(spark, name)}")
    return kept


def _kept_name(name: str, version: int) -> str:
    return f"{name}__v{version}"


def _kept_versions(spark: SparkSession, name: str) -> list[int]:
    *database, short = name.split(".")
    tables = spark.catalog.listTables(".".join(database) or None)
    marked = [t.name.rpartition("__v") for t in tables if not t.isTemporary]
    return sorted(int(version) for table, _, version in marked if table.lower() == short.lower() and version.isdigit())


def get_feature_table(spark: SparkSession, name: str) -> FeatureTable:
    """Metadata only: name, keys, features and description. ``features`` lists every column, as the store keeps it."""
    keys = primary_keys_of(spark, name)
    if not keys:
        raise ValueError(f"{name} is not a feature table")
    columns = tuple(spark.table(name).columns)
    return FeatureTable(name, tuple(keys), columns, _properties(spark, name).get(DESCRIPTION_PROPERTY, ""))


def read_feature_table(spark: SparkSession, name: str) -> DataFrame:
    if not primary_keys_of(spark, name):
        raise ValueError(f"{name} is not a feature table")
    return spark.table(name)


def drop_feature_table(spark: SparkSession, name: str) -> None:
    """Drop a feature table and its kept versions; any other table is refused, a missing one is no error."""
    if not spark.catalog.tableExists(name):
        return
    if not primary_keys_of(spark, name):
        raise ValueError(f"{name} is not a feature table")
    for version in _kept_versions(spark, name):
        spark.sql(f"DROP TABLE IF EXISTS {quoted(_kept_name(name, version))}")
    spark.sql(f"DROP TABLE {quoted(name)}")


def _is_kept(name: str, tables: set[str]) -> bool:
    table, _, version = name.rpartition("__v")
    return version.isdigit() and table in tables


def list_feature_tables(spark: SparkSession, database: str) -> list[FeatureTable]:
    """The feature tables of a database by name; kept versions, its other tables and views are left out."""
    found = {t.name for t in spark.catalog.listTables(database) if not t.isTemporary and t.tableType != "VIEW"}
    names = sorted(name for name in found if not _is_kept(name, found))
    tables = [f"{database}.{name}" for name in names]
    return [get_feature_table(spark, name) for name in tables if primary_keys_of(spark, name)]


def feature_table_audit(spark: SparkSession, database: str) -> DataFrame:
    """One row per feature table of a database: its keys, number of features, description and rows, and whether keys still hold.

    Keys are checked when a table is created or refreshed by this library; anything else that writes to it may break them.
    """
    rows = None
    for table in list_feature_tables(spark, database):
        audit = primary_key_audit(spark.table(table.name), table.primary_keys)
        row = audit.select(
            F.lit(table.name.rsplit(".", 1)[1]).alias("table"),
            F.lit(", ".join(table.primary_keys)).alias("primary_keys"),
            F.lit(len(table.features) - len(table.primary_keys)).alias("features"),
            F.lit(table.description).alias("description"),
            "rows",
            ((F.col("null_key_rows") == 0) & (F.col("surplus_rows") == 0)).alias("keys_hold"),
        )
        rows = row if rows is None else rows.unionByName(row)
    empty = "table string, primary_keys string, features int, description string, rows long, keys_hold boolean"
    return spark.createDataFrame([], empty) if rows is None else rows
