"""Counts by category. Every group is combined map-side first, so a hot category costs no more than a rare one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """Rows per value, most frequent first; NULL is left out unless ``dropna`` is false."""
    rows = df.where(F.col(column).isNotNull()) if dropna else df
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(column))


def group_count(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    """Rows per combination of keys, NULL keys included."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def sql_over(query: str, **frames: DataFrame) -> DataFrame:
    """Run SQL whose ``{name}`` placeholders stand for the given frames."""
    session = next(iter(frames.values())).sparkSession
    return session.sql(query, **frames)


def pivot_counts(
    df: DataFrame, index: str, columns: str, values: str, column_values: Sequence | None = None
) -> DataFrame:
    """Long to wide: one row per ``index``, one column per value of ``columns``, filled with ``values``.

    Give ``column_values`` where they are known; finding them costs one more job.
    """
    grouped = df.groupBy(index)
    pivoted = grouped.pivot(columns, list(column_values)) if column_values else grouped.pivot(columns)
    return pivoted.agg(F.sum(values))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per label value."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(label, "count", (F.col("count") / total).alias("share"))
