"""Sketches merged on two levels.

A sketch weighs up to a few hundred kilobytes, and a large table is read by hundreds of thousands of tasks. Merged by
one task, their sketches alone would be as large as a table. So each task's sketch goes to one of ``LANES`` merging
tasks first, and only one sketch per lane reaches the last one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 512
# Size of a quantile sketch; quantiles only balance work and bracket exact ones.
BALANCE_SIZE = 4_096
# Items that a frequent-items sketch keeps.
FREQUENT_ITEMS = 4_096


def by_lane(df: DataFrame, partial: Mapping[str, Column], final: Mapping[str, Column]) -> DataFrame:
    """Aggregate to one row: ``partial`` per lane, ``final`` over the lanes' columns."""
    measures = [c.alias(n) for n, c in partial.items()]
    lanes = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("lane")).agg(*measures).drop("lane")
    # Some sketches cannot be merged from nothing, so a frame without rows still has one lane, an empty one.
    empty = df.limit(0).agg(*measures)
    return lanes.unionByName(empty).agg(*[c.alias(n) for n, c in final.items()])


def quantile_sketch(value: Column, size: int = BALANCE_SIZE) -> Column:
    return F.call_function("kll_sketch_agg_double", value.cast("double"), F.lit(size))


def merged_quantiles(sketch: Column) -> Column:
    return F.call_function("kll_merge_agg_double", sketch)


def quantiles(sketch: Column, count: Column, shares: Sequence[float]) -> Column:
    """The nearest-rank quantiles of a merged sketch as an array; NULL where nothing was counted."""
    wanted = F.array(*[F.lit(float(share)) for share in shares])
    return F.when(count > 0, F.call_function("kll_sketch_get_quantile_double", sketch, wanted))


def frequent_sketch(value: Column, items: int = FREQUENT_ITEMS) -> Column:
    return F.call_function("approx_top_k_accumulate", value, F.lit(items))


def merged_frequent(sketch: Column, top: int, items: int = FREQUENT_ITEMS) -> Column:
    """The ``top`` most frequent items as an array of (item, count)."""
    merged = F.call_function("approx_top_k_combine", sketch, F.lit(items))
    return F.call_function("approx_top_k_estimate", merged, F.lit(top))


def moments(value: Column) -> Column:
    """Count, mean and squared deviation of one lane."""
    count = F.count(value)
    return F.struct(count.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * count).alias("m2"))


def merged_moments(lane_moments: str) -> Column:
    """Lanes' moments as one, without the cancellation that sums of squares suffer."""
    return F.expr(
        f"""aggregate(
            filter(collect_list({lane_moments}), lane -> lane.n > 0),
            named_struct('n', 0L, 'mean', 0D, 'm2', 0D),
            (a, b) -> if(a.n = 0, b, named_struct(
                'n', a.n + b.n,
                'mean', a.mean + (b.mean - a.mean) * b.n / (a.n + b.n),
                'm2', a.m2 + b.m2 + (b.mean - a.mean) * (b.mean - a.mean) * a.n * b.n / (a.n + b.n)
            ))
        )"""
    )


def mean_of(merged: Column) -> Column:
    return F.when(merged["n"] > 0, merged["mean"])


def deviation_of(merged: Column) -> Column:
    """Sample standard deviation; NULL for fewer than two values."""
    return F.when(merged["n"] > 1, F.sqrt(merged["m2"] / (merged["n"] - 1)))
