"""Descriptive statistics, data profiles and audits.

All of them are whole-table aggregates: executors build partial results per partition, and what is combined is one
row per column or one row per distinct value.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions import blank, to_number
from holdfast.operators.sketches import (
    BALANCE_SIZE,
    by_lane,
    deviation_of,
    frequent_sketch,
    mean_of,
    merged_frequent,
    merged_moments,
    merged_quantiles,
    moments,
    quantile_sketch,
    quantiles,
)

QUARTILES = (0.25, 0.5, 0.75)
# How far around a quartile its sketched neighbours are taken, as a share of the rows; some ten times the sketch's error.
MARGIN = 0.005
# Pieces into which the values around a quartile are cut before one of them is ordered.
PIECES = 512
# The rows of a description and where a column's statistics hold them.
STATISTICS = {
    "count": "CAST({c}.count AS DOUBLE)",
    "mean": "{c}.mean",
    "std": "{c}.stddev",
    "min": "{c}.min_number",
    "25%": "{c}.quartiles[0]",
    "50%": "{c}.quartiles[1]",
    "75%": "{c}.quartiles[2]",
    "max": "{c}.max_number",
}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _rows(*structs: Column) -> Column:
    return F.inline(F.array(*structs))


def _as_double(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return column.cast("double") if isinstance(df.schema[name].dataType, T.NumericType) else to_number(column)


def _statistics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row with a struct of statistics per column, from two passes."""
    numbers = set(numeric_columns(df))
    partial, final = {}, {}
    for i, name in enumerate(names):
        value = _as_double(df, name)
        extremes = value if name in numbers else F.col(name)
        partial |= {
            f"moments{i}": moments(value),
            f"sketch{i}": quantile_sketch(_number(df, name), BALANCE_SIZE),
            f"numbers{i}": F.count(_number(df, name)),
            f"least{i}": F.min(_number(df, name)),
            f"greatest{i}": F.max(_number(df, name)),
            f"low{i}": F.min(extremes),
            f"high{i}": F.max(extremes),
        }
        final |= {
            f"moments{i}": merged_moments(f"moments{i}"),
            f"sketch{i}": merged_quantiles(F.col(f"sketch{i}")),
            f"numbers{i}": F.sum(f"numbers{i}"),
            f"least{i}": F.min(f"least{i}"),
            f"greatest{i}": F.max(f"greatest{i}"),
            f"low{i}": F.min(f"low{i}"),
            f"high{i}": F.max(f"high{i}"),
        }
        if name not in numbers:
            partial[f"filled{i}"] = F.count(extremes)
            final[f"filled{i}"] = F.coalesce(F.sum(f"filled{i}"), F.lit(0))
    around = [min(max(share + side * MARGIN, 0.0), 1.0) for share in QUARTILES for side in (-1, 1)]
    nothing, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def statistics(i: int, name: str) -> Column:
        merged, low, high = F.col(f"moments{i}"), F.col(f"low{i}"), F.col(f"high{i}")
        is_number = name in numbers
        return F.struct(
            F.lit(name).alias("column"),
            (merged["n"] if is_number else F.col(f"filled{i}")).alias("count"),
            mean_of(merged).alias("mean"),
            deviation_of(merged).alias("stddev"),
            (low if is_number else nothing).alias("min_number"),
            F.array(*[nothing] * len(QUARTILES)).alias("quartiles"),
            quantiles(F.col(f"sketch{i}"), F.col(f"numbers{i}"), around).alias("around"),
            F.col(f"numbers{i}").alias("numbers"),
            F.col(f"least{i}").alias("least"),
            F.col(f"greatest{i}").alias("greatest"),
            (high if is_number else nothing).alias("max_number"),
            (no_text if is_number else low).alias("min_text"),
            (no_text if is_number else high).alias("max_text"),
        ).alias(name)

    wide = by_lane(df, partial, final).select(*[statistics(i, name) for i, name in enumerate(names)])
    return _with_quartiles(df, names, wide)


def _with_quartiles(df: DataFrame, names: Sequence[str], wide: DataFrame) -> DataFrame:
    """The one row of statistics with exact nearest-rank quartiles in place of the sketched ones.

    The sketches only say where to look: a quartile lies between two sketched quantiles a little below and above it.
    Rows below the interval are merely counted, in one aggregate for all quartiles; only the few values inside an
    interval are stacked, and counted per distinct value. These are cut into ``PIECES`` pieces of the interval; the
    pieces' totals show in which one the wanted rank lies, and only that piece is ordered. Should a sketch be
    wrong, the interval becomes the whole range and the pass is repeated.
    """
    spark = df.sparkSession
    row = wide.first()
    found = {name: [None] * len(QUARTILES) for name in names}
    wanted, bounds = {}, {}
    for i, name in enumerate(names):
        n = row[name]["numbers"]
        for q, share in enumerate(QUARTILES):
            if n:
                label = i * len(QUARTILES) + q
                wanted[label] = max(n - math.floor(n - share * n), 1)
                bounds[label] = (row[name]["around"][2 * q], row[name]["around"][2 * q + 1])
    while wanted:
        values = {label: F.col(f"v{label // len(QUARTILES)}") for label in wanted}
        numbers = df.select(*[_number(df, names[i]).alias(f"v{i}") for i in sorted({label // len(QUARTILES) for label in wanted})])
        below = numbers.agg(*[F.count_if(values[label] < bounds[label][0]).alias(str(label)) for label in wanted]).first().asDict()
        inside = [F.when(values[label].between(*map(F.lit, bounds[label])), values[label]).alias(str(label)) for label in wanted]
        stacked = numbers.select(*inside).unpivot([], [str(label) for label in wanted], "label", "value")
        counts = stacked.where(F.col("value").isNotNull()).groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("label", F.col("label").cast("int"))
        low, high = (F.create_map(*[F.lit(x) for k, b in bounds.items() for x in (k, b[side])]) for side in (0, 1))
        width = (high[F.col("label")] - low[F.col("label")]) / PIECES
        piece = F.coalesce(F.least(F.floor(F.try_divide(F.col("value") - low[F.col("label")], width)), F.lit(PIECES - 1)), F.lit(0))
        counts = counts.withColumn("piece", piece).persist(StorageLevel.DISK_ONLY)
        totals = counts.groupBy("label", "piece").agg(F.sum("n").alias("n")).collect()
        hits, failed = {}, {}
        for label, rank in wanted.items():
            upto = below[str(label)]
            for total in sorted((t for t in totals if t["label"] == label), key=lambda t: t["piece"]):
                if upto < rank <= upto + total["n"]:
                    hits[label] = (total["piece"], rank - upto)
                upto += total["n"]
            if label not in hits:
                failed[label] = rank
                column = row[names[label // len(QUARTILES)]]
                bounds[label] = (column["least"], column["greatest"])
        if hits:
            inside = F.lit(False)
            for label, (number, _) in hits.items():
                inside = inside | ((F.col("label") == label) & (F.col("piece") == number))
            rank = F.create_map(*[F.lit(x) for label, (_, r) in hits.items() for x in (label, r)])[F.col("label")]
            upto = F.sum("n").over(Window.partitionBy("label").orderBy("value"))
            reached = counts.where(inside).withColumn("upto", upto).where(F.col("upto") >= rank)
            for hit in reached.groupBy("label").agg(F.min("value").alias("value")).collect():
                found[names[hit["label"] // len(QUARTILES)]][hit["label"] % len(QUARTILES)] = hit["value"]
        counts.unpersist()
        wanted = failed
    filled = [{**row[name].asDict(), "quartiles": found[name]} for name in names]
    return spark.createDataFrame([tuple(filled)], wide.schema)


def _number(df: DataFrame, name: str) -> Column:
    """The column as a number, NULL for NaN, which has no place among the percentiles."""
    value = _as_double(df, name)
    return F.when(~F.isnan(value), value)


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Eight statistics as rows, one column per numeric column.

    Percentiles are exact nearest-rank values at any size, NaN left out; they take a second pass.
    """
    names = list(columns or numeric_columns(df))
    wide = _statistics(df, names)
    rows = [
        ", ".join([f"'{label}' AS statistic", *[f"{path.format(c=f'`{n}`')} AS `{n}`" for n in names]])
        for label, path in STATISTICS.items()
    ]
    return wide.selectExpr("inline(array(" + ", ".join(f"struct({row})" for row in rows) + "))")


def summary_typed(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One typed row per numeric or string column.

    Strings are summarised like ``DataFrame.summary``: their moments and percentiles are those of the values that
    are numbers, their minimum and maximum are alphabetical.
    """
    known = {*numeric_columns(df), *string_columns(df)}
    names = list(columns or [n for n in df.columns if n in known])
    long = _statistics(df, names).select(_rows(*[F.col(f"`{n}`") for n in names]))
    return long.select(
        "column",
        "count",
        "mean",
        "stddev",
        "min_number",
        F.col("quartiles")[0].alias("p25"),
        F.col("quartiles")[1].alias("p50"),
        F.col("quartiles")[2].alias("p75"),
        "max_number",
        "min_text",
        "max_text",
    )


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column: type, rows, nulls, blanks, zeros, distinct values, extremes and the most frequent value.

    ``exact`` counts every distinct value, which shuffles one row per distinct value and column. With ``exact=False``
    distinct and most frequent values come from sketches, and nothing but one row per task is shuffled.
    """
    names = list(columns or df.columns)
    return _profile_exact(df, names) if exact else _profile_sketched(df, names)


def _text_of(df: DataFrame, name: str) -> Column:
    """The value as text; 0.0 and -0.0 are one value."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        column = F.when(column == 0, F.lit(0).cast(df.schema[name].dataType)).otherwise(column)
    return column.cast("string")


def _profile_exact(df: DataFrame, names: list[str]) -> DataFrame:
    plain = _plain_statistics(df, names)
    kinds: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        kinds.setdefault(df.schema[name].dataType.json(), []).append(i)
    frequent = functools.reduce(DataFrame.unionByName, [_frequencies(df, names, places) for places in kinds.values()])
    return plain.join(F.broadcast(frequent), "place", "left").select(
        *[c for c in plain.columns if c != "place"][:6],
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        "min_number",
        "max_number",
        "min_text",
        "max_text",
        "top_value",
        "top_count",
    )


def _plain_statistics(df: DataFrame, names: list[str]) -> DataFrame:
    """A row per column, by its place, of what one aggregate over the columns finds."""
    nothing, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    measures, rows = [], []
    for i, name in enumerate(names):
        column, kind = F.col(name), df.schema[name].dataType
        number = column.cast("double") if isinstance(kind, T.NumericType) else None
        is_text = isinstance(kind, T.StringType)
        found = {"nulls": F.count_if(column.isNull())}
        found |= {"blanks": F.count_if(blank(column)), "min_text": F.min(column), "max_text": F.max(column)} if is_text else {}
        found |= {"zeros": F.count_if(number == 0), "min_number": F.min(number), "max_number": F.max(number)} if number is not None else {}
        measures += [measure.alias(f"{part}{i}") for part, measure in found.items()]
        of = lambda part, missing: F.col(f"{part}{i}").alias(part) if part in found else missing.alias(part)  # noqa: B023, E731
        rows.append(
            F.struct(
                F.lit(i).alias("place"),
                F.lit(name).alias("column"),
                F.lit(kind.simpleString()).alias("type"),
                F.col("rows"),
                of("nulls", F.lit(0).cast("long")),
                of("blanks", F.lit(0).cast("long")),
                of("zeros", F.lit(0).cast("long")),
                of("min_number", nothing),
                of("max_number", nothing),
                of("min_text", no_text),
                of("max_text", no_text),
            )
        )
    return df.agg(F.count(F.lit(1)).alias("rows"), *measures).select(_rows(*rows))


def _frequencies(df: DataFrame, names: list[str], places: list[int]) -> DataFrame:
    """Distinct values and the most frequent one of columns of one type, which are stacked and counted as they are.

    Among equally frequent values the first by its text is taken; only distinct values are ever made text.
    """
    labels = [str(i) for i in places]
    kind = df.schema[names[places[0]]].dataType
    plain = isinstance(kind, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType))
    cells = df.select(*[(F.col(names[i]) if plain else F.col(names[i]).cast("string")).alias(str(i)) for i in places]).unpivot([], labels, "label", "value")
    counts = cells.where(F.col("value").isNotNull()).groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("rank"), _text_of(counts, "value").alias("value")))
    found = counts.groupBy("label").agg(F.count(F.lit(1)).alias("distinct_values"), top.alias("top"))
    return found.select(F.col("label").cast("int").alias("place"), "distinct_values", F.col("top.value").alias("top_value"), (-F.col("top.rank")).alias("top_count"))


def _profile_sketched(df: DataFrame, names: list[str]) -> DataFrame:
    partial, final = {}, {}
    for i, name in enumerate(names):
        column, data_type = F.col(name), df.schema[name].dataType
        text = column if isinstance(data_type, T.StringType) else F.lit(None).cast("string")
        number = column.cast("double") if isinstance(data_type, T.NumericType) else F.lit(None).cast("double")
        partial |= {
            f"rows{i}": F.count(F.lit(1)),
            f"nulls{i}": F.count_if(column.isNull()),
            f"blanks{i}": F.count_if(blank(text)),
            f"zeros{i}": F.count_if(number == 0),
            f"distinct{i}": F.hll_sketch_agg(_text_of(df, name)),
            f"low{i}": F.min(number),
            f"high{i}": F.max(number),
            f"first{i}": F.min(text),
            f"last{i}": F.max(text),
            f"top{i}": frequent_sketch(_text_of(df, name)),
        }
        final[f"c{i}"] = F.struct(
            F.lit(name).alias("column"),
            F.lit(data_type.simpleString()).alias("type"),
            *[F.coalesce(F.sum(f"{c}{i}"), F.lit(0)).alias(c) for c in ("rows", "nulls", "blanks", "zeros")],
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"distinct{i}")), F.lit(0)).alias("distinct_values"),
            F.min(f"low{i}").alias("min_number"),
            F.max(f"high{i}").alias("max_number"),
            F.min(f"first{i}").alias("min_text"),
            F.max(f"last{i}").alias("max_text"),
            merged_frequent(F.col(f"top{i}"), 1).alias("top"),
        )
    long = by_lane(df, partial, final).select(_rows(*[F.col(n) for n in final]))
    top = F.get(F.col("top"), F.lit(0))
    return long.select(
        *[c for c in long.columns if c != "top"],
        top["item"].alias("top_value"),
        top["count"].alias("top_count"),
    )


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Rows per equal-width bin and numeric column, from one pass for the ranges and one for the counts.

    The bins 0 to ``bins - 1`` cut the range of the finite numbers. Bin -1 holds minus infinity, bin ``bins`` infinity,
    and the one after it NaN.
    """
    names = list(columns or numeric_columns(df))
    wide = df.select(*[_as_double(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    ends = [F.when(F.abs(c) < F.lit(float("inf")), F.col(c)) for c in wide.columns]
    found = wide.agg(*[end(c) for c in ends for end in (F.min, F.max)]).first()
    lows = {n: found[2 * i] if found[2 * i] is not None else 0.0 for i, n in enumerate(names)}
    highs = {n: found[2 * i + 1] if found[2 * i + 1] is not None else 0.0 for i, n in enumerate(names)}
    widths = {n: (highs[n] - lows[n]) / bins for n in names}
    labels = [str(i) for i in range(1, len(names) + 1)]

    def bin_of(i: int, name: str) -> Column:
        value = F.col(f"v{i}")
        place = F.least(F.floor((value - lows[name]) / F.lit(widths[name])), F.lit(bins - 1)).cast("int") if widths[name] > 0 else F.lit(0)
        beyond = F.when(F.isnan(value), F.lit(bins + 1)).when(value > 0, F.lit(bins)).when(value < 0, F.lit(-1))
        # False for NaN and the infinities, null for NULL, which has no bin.
        return F.when(F.abs(value) < F.lit(float("inf")), place).otherwise(beyond)

    # Bins are found per column before the columns are stacked: what is counted is two short values per cell.
    cells = wide.select(*[bin_of(k, n).alias(i) for k, (n, i) in enumerate(zip(names, labels))]).unpivot([], labels, "label", "bin")
    counts = cells.where(F.col("bin").isNotNull()).groupBy("label", "bin").agg(F.count(F.lit(1)).alias("count"))
    position = F.col("label").cast("int")
    low = F.element_at(F.array(*[F.lit(lows[n]) for n in names]), position)
    high = F.element_at(F.array(*[F.lit(highs[n]) for n in names]), position)
    width = F.element_at(F.array(*[F.lit(widths[n]) for n in names]), position)
    place, infinite, nan = F.col("bin"), F.lit(float("inf")), F.lit(float("nan"))
    lower = F.when(place == -1, -infinite).when(place == bins, high).when(place > bins, nan)
    upper = F.when(place == -1, low).when(place == bins, infinite).when(place > bins, nan)
    return counts.select(
        F.element_at(F.array(*map(F.lit, names)), position).alias("column"),
        "bin",
        lower.otherwise(low + place * width).alias("lower"),
        upper.otherwise(low + (place + 1) * width).alias("upper"),
        "count",
    )


def cast_audit(df: DataFrame, columns: Sequence[str] | None = None, target: str = "double") -> DataFrame:
    """Per string column: rows, nulls, blanks and values that do not cast to ``target`` (blanks included)."""
    names = list(columns or string_columns(df))

    def converted(name: str) -> Column:
        return to_number(name) if target == "double" else F.col(name).try_cast(target)

    measures = [
        F.struct(
            F.lit(n).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(n).isNull()).alias("nulls"),
            F.count_if(blank(n)).alias("blanks"),
            F.count_if(F.col(n).isNotNull() & converted(n).isNull()).alias("uncastable"),
        ).alias(n)
        for n in names
    ]
    return df.agg(*measures).select(_rows(*[F.col(f"`{n}`") for n in names]))


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key; partial counts are made map-side, so a hot key is one small row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def primary_key_audit(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row: rows, rows with a NULL key part, distinct full keys, keys held by several rows, and surplus rows."""
    names = [keys] if isinstance(keys, str) else list(keys)
    whole = F.lit(True)
    for name in names:
        whole = whole & F.col(name).isNotNull()
    n = F.col("rows")
    return key_counts(df, names).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(whole, 0).otherwise(n)), F.lit(0)).alias("null_key_rows"),
        F.count_if(whole).alias("distinct_keys"),
        F.count_if(whole & (n > 1)).alias("duplicated_keys"),
        F.coalesce(F.sum(F.when(whole, n - 1).otherwise(0)), F.lit(0)).alias("surplus_rows"),
    )


def duplicate_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """The keys that several rows hold, with their counts."""
    names = [keys] if isinstance(keys, str) else list(keys)
    return key_counts(df, names).where(F.col("rows") > 1)
