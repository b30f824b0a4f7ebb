"""The prediction every model must beat: the most frequent label of each segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.lookup import FeatureLookup, lookup_features


def majority_labels(train: DataFrame, segments: Sequence[str], label: str) -> DataFrame:
    """One row per segment with its most frequent label; on a tie the alphabetically first."""
    counts = train.where(F.col(label).isNotNull()).groupBy(*segments, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col(label).alias("label")))
    return counts.groupBy(*segments).agg(best.getField("label").alias("majority"))


def majority_baseline(
    df: DataFrame, train: DataFrame, segments: Sequence[str], label: str, prediction: str = "prediction"
) -> DataFrame:
    """Predict each row's segment majority; an unseen or NULL segment gets the overall majority."""
    counts = train.where(F.col(label).isNotNull()).groupBy(*segments, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col(label).alias("label")))
    # The training rows are read once for both: overall counts are sums of the segments' counts.
    counts = counts.persist()
    fallback = counts.groupBy(label).agg(F.sum("n").alias("n")).agg(best.getField("label")).first()[0]
    majorities = counts.groupBy(*segments).agg(best.getField("label").alias("majority"))
    found = lookup_features(df, [FeatureLookup(majorities, list(segments), ["majority"])])
    return found.withColumn(prediction, F.coalesce("majority", F.lit(fallback))).drop("majority")
