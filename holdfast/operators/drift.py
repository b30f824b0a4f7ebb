"""Checks that tell whether a model still fits the data it scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions import finite


def _ranges(df: DataFrame, numbers: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """The least and greatest finite value per numeric column."""
    if not numbers:
        return {}
    ends = [(finite(F.col(c).cast("double")), c) for c in numbers]
    found = df.agg(F.struct(*[F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias(c) for v, c in ends])).first()[0]
    return {c: (found[c]["low"], found[c]["high"]) for c in numbers}


def _bin_name(df: DataFrame, name: str, ranges: Mapping[str, tuple[float | None, float | None]], bins: int) -> Column:
    """The bin of a value, as text: the place in the range, the value itself, or the name of a number that is not finite."""
    if name not in ranges:
        return F.col(name).cast("string")
    low, high = ranges[name]
    value = F.col(name).cast("double")
    width = 0.0 if low is None else (high - low) / bins
    place = F.floor((value - low) / F.lit(width)) if width > 0 else F.lit(0).cast("bigint")
    bounded = F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0))
    # NaN and each infinity are bins of their own; the comparison is false for them and null for NULL.
    return F.when(F.abs(value) < F.lit(float("inf")), bounded.cast("string")).otherwise(value.cast("string"))


def _numbers(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]


def _stability(counts: DataFrame, features: int, floor: float) -> DataFrame:
    """PSI per feature from ``feature``, ``bin``, ``expected`` and ``actual``.

    Every row is in one bin of each feature, so all bins together hold each population once per feature.
    """
    sizes = counts.agg(F.struct((F.sum("expected") / features).alias("expected"), (F.sum("actual") / features).alias("actual"))).scalar()
    p = F.greatest(F.try_divide(F.col("expected"), sizes["expected"]), F.lit(floor))
    q = F.greatest(F.try_divide(F.col("actual"), sizes["actual"]), F.lit(floor))
    return counts.groupBy("feature").agg(F.count(F.lit(1)).alias("bins"), F.sum((p - q) * F.ln(p / q)).alias("psi"))


def drift_psi(
    df: DataFrame, is_reference: Column, columns: Sequence[str], bins: int = 10, floor: float = 1e-6
) -> DataFrame:
    """Population stability index per feature between the reference rows and the others.

    Numbers are cut into equal-width bins over the finite reference range, values beyond it falling into the end
    bins; other types are compared by value. NULL, NaN and the infinities are bins of their own. A bin empty on one side counts as ``floor``.
    One pass finds the ranges and one counts the bins.
    """
    ranges = _ranges(df.where(is_reference), _numbers(df, columns))
    side = F.coalesce(is_reference, F.lit(False)).alias("reference")
    counts = (
        _binned(df, columns, ranges, bins, side)
        .groupBy("feature", "bin")
        .agg(F.count_if("reference").alias("expected"), F.count_if(~F.col("reference")).alias("actual"))
    )
    return _stability(counts, len(columns), floor)


def _binned(df: DataFrame, columns: Sequence[str], ranges: Mapping[str, tuple[float | None, float | None]], bins: int, *more: Column) -> DataFrame:
    """One row per cell: ``feature``, ``bin``, and the columns ``more``."""
    labels = [f"bin{i}" for i in range(len(columns))]
    wide = df.select(*more, *[_bin_name(df, c, ranges, bins).alias(label) for c, label in zip(columns, labels)])
    rest = [c for c in wide.columns if c not in labels]
    long = wide.unpivot(rest, labels, "label", "bin")
    number = F.substring("label", 4, 10).cast("int") + 1
    return long.select(F.element_at(F.array(*map(F.lit, columns)), number).alias("feature"), "bin", *rest)


def distribution_profile(df: DataFrame, columns: Sequence[str], bins: int = 10, like: DataFrame | None = None) -> DataFrame:
    """How the rows spread over the bins of each feature: a small table that stands for the data in later comparisons.

    Rows of ``feature``, ``bin``, ``n``, and the range and number of bins that the bin's place refers to (``low``, ``high``, ``bins``; NULL
    for features that are compared by value). Bins are those of ``drift_psi``. With ``like``, an earlier profile, the
    features are cut as they were there, so that the two can be compared or added; only ``df`` is read, once.
    A frame without rows keeps one row per feature, of no bin and no count.
    """
    if like is None:
        ranges, cuts = _ranges(df, _numbers(df, columns)), dict.fromkeys(columns, bins)
    else:
        known = {r["feature"]: r for r in like.groupBy("feature").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("bins").alias("bins")).collect()}
        missing = [c for c in columns if c not in known]
        if missing:
            raise ValueError(f"the earlier profile has no {missing}")
        ranges = {c: (known[c]["low"], known[c]["high"]) for c in columns if known[c]["bins"] is not None}
        cuts = {c: known[c]["bins"] for c in columns}
        if len({cuts[c] for c in ranges}) > 1:
            raise ValueError("the earlier profile has features of different numbers of bins")
        bins = next((cuts[c] for c in ranges), bins)
    counts = _binned(df, columns, ranges, bins).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    empty = df.sparkSession.createDataFrame([(c, None, 0) for c in columns], "feature string, bin string, n long")
    whole = counts.unionByName(empty).groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    edges = [(c, *(ranges[c] if c in ranges else (None, None)), cuts[c] if c in ranges else None) for c in columns]
    described = df.sparkSession.createDataFrame(edges, "feature string, low double, high double, bins int")
    return whole.join(F.broadcast(described), "feature").select("feature", "bin", "low", "high", "bins", "n")


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """The profile of all rows together, from profiles that cut their features alike."""
    stacked = profiles[0]
    for profile in profiles[1:]:
        stacked = stacked.unionByName(profile)
    edges = F.struct("low", "high", "bins")
    merged = stacked.groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.min(edges).alias("least"), F.max(edges).alias("greatest"))
    same = F.assert_true(F.col("least").eqNullSafe(F.col("greatest")), F.lit("profiles are cut differently"))
    return merged.where(F.isnull(same)).select("feature", "bin", "least.low", "least.high", "least.bins", "n")


def profile_psi(reference: DataFrame, current: DataFrame, floor: float = 1e-6) -> DataFrame:
    """The PSI of ``drift_psi``, from two stored profiles and without the data of either.

    ``current`` must have been taken with ``like=reference``. Bins that neither side fills do not count.
    """
    expected = reference.select("feature", "bin", F.col("n").alias("expected"), F.lit(0).cast("long").alias("actual"))
    actual = current.select("feature", "bin", F.lit(0).cast("long").alias("expected"), F.col("n").alias("actual"))
    counts = expected.unionByName(actual).groupBy("feature", "bin").agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))
    features = reference.select("feature").distinct().count()
    return _stability(counts.where("expected + actual > 0"), max(features, 1), floor)


# Metrics that are better when they are smaller.
LOWER_IS_BETTER = ("log_loss",)


def metric_decay(
    metrics: DataFrame,
    reference_run: str,
    current_run: str,
    tolerance: float = 0.05,
    lower_is_better: Sequence[str] = LOWER_IS_BETTER,
) -> DataFrame:
    """Per split and metric: the value of both runs, by how much it got worse, and whether that exceeds the tolerance."""

    def of(run: str) -> Column:
        return F.max(F.when(F.col("run_id") == run, F.col("value")))

    fall = F.col("reference") - F.col("current")
    loss = F.when(F.col("metric").isin(*lower_is_better), -fall).otherwise(fall) if lower_is_better else fall
    return (
        metrics.where(F.col("run_id").isin(reference_run, current_run))
        .groupBy("split", "metric")
        .agg(of(reference_run).alias("reference"), of(current_run).alias("current"))
        .withColumn("loss", loss)
        .withColumn("decayed", F.coalesce(loss > tolerance, F.lit(False)))
    )


def needs_retraining(drift: DataFrame, decay: DataFrame | None = None, psi_limit: float = 0.2) -> bool:
    """True when any feature drifted beyond the limit or any metric decayed."""
    drifted = drift.agg(F.max("psi")).first()[0]
    if drifted is not None and drifted > psi_limit:
        return True
    return decay is not None and not decay.where("decayed").isEmpty()
