"""Columns by type, and category columns as 0/1 columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TooManyCategories(ValueError):
    """A column is no category column."""


def columns_by_type(df: DataFrame, *types: type[T.DataType], exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types) and f.name not in exclude]


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Roughly how many values each column has, from one pass with mergeable sketches; 0 means only NULL."""
    if not columns:
        return {}
    return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first().asDict()


def check_categories(counts: Mapping[str, int], limit: int | None) -> None:
    """With a limit, refuse columns that have about more categories, naming them, before the categories are listed."""
    wide = {c: n for c, n in counts.items() if limit is not None and n > limit}
    if wide:
        raise TooManyCategories(f"exclude these columns or group their values, they have too many categories: {wide}")


def categories(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> dict[str, list[str]]:
    """The sorted categories of each column, NULL left out; ``limit`` refuses columns with more."""
    if not columns:
        return {}
    if limit is not None:
        check_categories(distinct_counts(df, columns), limit)
    found = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).first()
    return {c: list(found[c]) for c in columns}


def one_hot_wide(df: DataFrame, known: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """One 0/1 column per known category; an unknown category or NULL makes all of its column's zeros."""
    flags = []
    for column, values in known.items():
        for value in values:
            flag = F.coalesce((F.col(column) == F.lit(value)).cast("int"), F.lit(0))
            flags.append(flag.alias(one_hot_name(column, value)))
    return df.select(*keep, *flags)


def one_hot_name(column: str, value: str) -> str:
    return f"{column}={value}"
