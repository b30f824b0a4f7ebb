"""Exploring a training table: how its columns go together, and all that is known of it as one long table."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions import finite
from holdfast.operators.aggregate import class_balance
from holdfast.operators.profile import numeric_columns, profile_columns, summary_typed
from holdfast.operators.sketches import by_lane

#: Rows whose means the sums are taken around. They guard against cancellation and need not be near the true means.
CENTER_ROWS = 1_000
#: Pairs per aggregate, so that its generated code stays bounded however many columns there are.
BLOCK = 64


def _sums(x: Column, y: Column) -> dict[str, Column]:
    """Of the rows that have both values: their number and the sums of values, squares and products."""
    both_x, both_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    sums = {"x": both_x, "y": both_y, "xx": both_x * x, "yy": both_y * y, "xy": x * y}
    return {"n": F.count(x * y), **{part: F.sum(value) for part, value in sums.items()}}


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per pair of number or flag columns: the rows that have both values, and their correlation.

    Executors hold six sums per pair, which are added in lanes first; one pass serves ``BLOCK`` pairs. A value that is
    NULL, NaN or infinite leaves its row out of that column's pairs only. A column that is constant over the
    rows of a pair has no correlation there: NULL. Each pair stands once, in the order of the columns.
    """
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    names = list(columns or [n for n in df.columns if n in {*numeric_columns(df), *flags}])
    pairs = list(itertools.combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, other string, rows long, correlation double")
    values = df.select(*[finite(F.col(n).cast("double")).alias(f"v{i}") for i, n in enumerate(names)])
    centers = values.limit(CENTER_ROWS).agg(*[F.avg(c).alias(c) for c in values.columns]).first()
    place = {name: F.col(f"v{i}") - F.lit(centers[i] or 0.0) for i, name in enumerate(names)}
    blocks = [_block(values, place, pairs[k : k + BLOCK]) for k in range(0, len(pairs), BLOCK)]
    return functools.reduce(DataFrame.unionByName, blocks)


def _block(values: DataFrame, place: Mapping[str, Column], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The correlations of some pairs from one aggregate."""
    partial, final = {}, {}
    for k, (a, b) in enumerate(pairs):
        for part, measure in _sums(place[a], place[b]).items():
            partial[f"{part}{k}"], final[f"{part}{k}"] = measure, F.sum(f"{part}{k}")
    merged = by_lane(values, partial, final)

    def row(k: int, a: str, b: str) -> Column:
        n, x, y, xx, yy, xy = (F.col(f"{part}{k}") for part in ("n", "x", "y", "xx", "yy", "xy"))
        spread_x, spread_y = xx - F.try_divide(x * x, n), yy - F.try_divide(y * y, n)
        # Of a constant column rounding may leave a trace of spread.
        varied = (spread_x > xx * 1e-14) & (spread_y > yy * 1e-14)
        related = F.when(varied, (xy - F.try_divide(x * y, n)) / F.sqrt(spread_x) / F.sqrt(spread_y))
        return F.struct(F.lit(a).alias("column"), F.lit(b).alias("other"), F.coalesce(n, F.lit(0)).alias("rows"), related.alias("correlation"))

    return merged.select(F.inline(F.array(*[row(k, a, b) for k, (a, b) in enumerate(pairs)])))


def _long(df: DataFrame, section: str, subject: str, numbers: Sequence[str] = (), texts: Sequence[str] = (), other: str | None = None) -> DataFrame:
    nothing, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = [F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("number"), no_text.alias("text")) for n in numbers]
    cells += [F.struct(F.lit(n).alias("measure"), nothing.alias("number"), F.col(n).cast("string").alias("text")) for n in texts]
    second = F.col(other) if other else no_text
    return df.select(F.lit(section).alias("section"), F.col(subject).alias("subject"), second.alias("other"), F.inline(F.array(*cells)))


def exploration_report(df: DataFrame, label: str, positive: str, exact: bool = True) -> DataFrame:
    """All findings about a training table in rows of section, subject, other, measure, and a number or a text.

    Sections: ``profile`` and ``summary`` per column, ``balance`` per label value, and ``correlation`` per pair of numbers
    and flags, the label among them as 1 where it is ``positive``. A NULL label has no value among the
    correlations and is a value of its own, NULL, in the balance. ``exact=False`` takes distinct and top values from sketches.
    """
    profile = profile_columns(df, exact=exact)
    summary = summary_typed(df)
    target = "label_is_positive"
    while target in df.columns:
        target += "_"
    numbers = df.withColumn(target, F.col(label) == F.lit(positive))
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    columns = [n for n in df.columns if n in {*numeric_columns(df), *flags} and n != label]
    related = correlation_matrix(numbers, [*columns, target])
    renamed = related.withColumn("other", F.when(F.col("other") == target, F.lit(label)).otherwise(F.col("other")))
    counted = ("rows", "nulls", "blanks", "zeros", "distinct_values", "min_number", "max_number", "top_count")
    return (
        _long(profile, "profile", "column", counted, ("type", "min_text", "max_text", "top_value"))
        .unionByName(_long(summary, "summary", "column", ("count", "mean", "stddev", "p25", "p50", "p75")))
        .unionByName(_long(class_balance(df, label), "balance", label, ("count", "share")))
        .unionByName(_long(renamed, "correlation", "column", ("rows", "correlation"), other="other"))
    )
