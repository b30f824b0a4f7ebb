"""Classifier metrics as aggregates over a prediction frame."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.sketches import BALANCE_SIZE, by_lane, merged_quantiles, quantile_sketch, quantiles
# Planned input bytes per range of scores, and the fewest and most ranges.
RANGE_BYTES, MIN_RANGES, MAX_RANGES = 128 * 1024 * 1024, 8, 20_000
METRICS_SCHEMA = "run_id string, split string, metric string, value double"


def _hit(label: str, prediction: str) -> Column:
    return F.col(label) == F.col(prediction)


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Share of labelled rows predicted right; a NULL prediction is a wrong one."""
    rows, right = F.count(label), F.count_if(_hit(label, prediction))
    return df.agg(rows.alias("rows"), right.alias("correct"), F.try_divide(right, rows).alias("accuracy"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("count"))


def precision_recall_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Support, precision, recall and F1 per class, from the confusion counts.

    A class that is never predicted has NULL precision, one that never occurs has NULL recall.
    """
    counts = confusion_matrix(df.where(F.col(label).isNotNull()), label, prediction)
    none = F.lit(0).cast("bigint")
    hits = F.when(_hit(label, prediction), F.col("count")).otherwise(none)

    def side(name: str, actual: Column, predicted: Column, right: Column) -> Column:
        return F.struct(
            F.col(name).alias("class"), actual.alias("actual"), predicted.alias("predicted"), right.alias("hits")
        )

    # Each cell of the matrix counts once as an actual class and once as a predicted one.
    cells = F.array(side(label, F.col("count"), none, hits), side(prediction, none, F.col("count"), none))
    sides = counts.select(F.inline(cells)).where(F.col("class").isNotNull())
    totals = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")])
    return totals.select(
        "class",
        F.col("actual").alias("support"),
        F.try_divide("hits", "predicted").alias("precision"),
        F.try_divide("hits", "actual").alias("recall"),
        F.try_divide(2 * F.col("hits"), F.col("actual") + F.col("predicted")).alias("f1"),
    )


def log_loss(df: DataFrame, label: str, probability: str, positive: str, floor: float = 1e-15) -> DataFrame:
    """Mean negative log likelihood of the labels; probabilities are kept ``floor`` away from 0 and 1."""
    loss = row_loss(label, probability, positive, floor)
    return df.agg(F.count(loss).alias("rows"), F.avg(loss).alias("log_loss"))


def row_loss(label: str, probability: str, positive: str, floor: float = 1e-15) -> Column:
    """Negative log likelihood of one row's label; NULL without a label or a probability."""
    p = F.least(F.greatest(F.col(probability), F.lit(floor)), F.lit(1.0 - floor))
    loss = F.when(F.col(label) == F.lit(positive), -F.ln(p)).otherwise(-F.ln(F.lit(1.0) - p))
    return F.when(F.col(label).isNotNull() & F.col(probability).isNotNull(), loss)


def model_metrics(df: DataFrame, label: str, prediction: str, score: str | None, positive: str | None) -> dict:
    """Accuracy and, with a score, log loss and ROC AUC, in two passes over the predictions.

    Predicting is the dear part, so what one pass can find is found together: accuracy, loss and the cut points of
    the scores.
    """
    partial = {"right": F.count_if(_hit(label, prediction)), "rows": F.count(label)}
    final = {"accuracy": F.try_divide(F.sum("right"), F.sum("rows"))}
    if score:
        loss = row_loss(label, score, positive)
        partial |= {"loss": F.sum(loss), "losses": F.count(loss)}
        partial |= {"scores": F.count(score), "sketch": quantile_sketch(F.col(score), BALANCE_SIZE)}
        final["log_loss"] = F.try_divide(F.sum("loss"), F.sum("losses"))
        final["cuts"] = _cuts(ranges_of(df))
    found = by_lane(df, partial, final).first().asDict()
    if score:
        cuts = found.pop("cuts") or []
        found["roc_auc"] = roc_auc(df, label, score, positive, cuts=cuts).first()["roc_auc"]
    return found


def _cuts(buckets: int) -> Column:
    """Sketched quantiles that cut the scores into about equal ranges."""
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    return quantiles(merged_quantiles(F.col("sketch")), F.sum("scores"), shares)


def cut_points(scored: DataFrame, buckets: int) -> list[float]:
    partial = {"scores": F.count("score"), "sketch": quantile_sketch(F.col("score"), BALANCE_SIZE)}
    return by_lane(scored, partial, {"cuts": _cuts(buckets)}).first()["cuts"] or []


def ranges_of(df: DataFrame) -> int:
    """As many ranges as the frame has input tasks, within bounds, so that a range stays as large as a task's input."""
    plan = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return min(max(int(plan) // RANGE_BYTES, MIN_RANGES), MAX_RANGES)


def score_totals(
    df: DataFrame,
    label: str,
    score: str,
    positive: str,
    buckets: int | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """One row per distinct score: its positives and negatives, those with a lower score, and the totals.

    This is a running total in global order. Rows are counted per distinct score first, so a score that many rows
    share is one row; the scores are cut at sketched quantiles into as many ranges as there are shuffle partitions,
    and each range sums on its own and adds the totals of the ranges below it. The cut points only balance the
    ranges, the totals are exact; without given ones they are found in a pass over the scores.
    """
    is_positive = F.col(label) == F.lit(positive)
    scored = df.select(F.col(score).cast("double").alias("score"), is_positive.cast("bigint").alias("positive"))
    scored = scored.where(F.col("score").isNotNull() & F.col("positive").isNotNull())
    if cuts is None:
        cuts = cut_points(scored, buckets or ranges_of(df))
    inner = sorted({float(cut) for cut in cuts if math.isfinite(cut)}) or [0.0]
    groups = scored.groupBy("score").agg(
        F.sum("positive").alias("positives"), F.sum(1 - F.col("positive")).alias("negatives")
    )
    splits = [float("-inf"), *inner, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="score", outputCol="range", handleInvalid="keep")
    ranges = bucketizer.transform(groups).withColumn("range", F.col("range").cast("int"))
    # At most one row per range, so this ordered window and the broadcast stay as small as the number of partitions.
    below = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = ranges.groupBy("range").agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("p").over(below), F.lit(0)).alias("p_below"),
        F.coalesce(F.sum("n").over(below), F.lit(0)).alias("n_below"),
        F.sum("p").over(everything).alias("all_positives"),
        F.sum("n").over(everything).alias("all_negatives"),
    )
    inside = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn("p_inside", F.coalesce(F.sum("positives").over(inside), F.lit(0)))
        .withColumn("n_inside", F.coalesce(F.sum("negatives").over(inside), F.lit(0)))
        # Every range has its offsets; an outer join puts no filter on one side only, so the counts are shuffled once.
        .join(F.broadcast(offsets), "range", "left")
        .select(
            "score",
            "positives",
            "negatives",
            (F.col("p_below") + F.col("p_inside")).alias("positives_below"),
            (F.col("n_below") + F.col("n_inside")).alias("negatives_below"),
            "all_positives",
            "all_negatives",
        )
    )


def roc_auc(
    df: DataFrame,
    label: str,
    score: str,
    positive: str,
    buckets: int | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Probability that a positive row scores above a negative one, ties counting half."""
    totals = score_totals(df, label, score, positive, buckets, cuts)
    won = F.col("positives").cast("double") * (F.col("negatives_below") + F.col("negatives") / 2)
    pairs = F.max("all_positives").cast("double") * F.max("all_negatives")
    return totals.agg(F.try_divide(F.sum(won), pairs).alias("roc_auc"))


def roc_curve(df: DataFrame, label: str, score: str, positive: str, buckets: int | None = None) -> DataFrame:
    """False and true positive rate of predicting positive at or above each distinct score."""
    totals = score_totals(df, label, score, positive, buckets)
    return totals.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("all_negatives") - F.col("negatives_below"), "all_negatives").alias("fpr"),
        F.try_divide(F.col("all_positives") - F.col("positives_below"), "all_positives").alias("tpr"),
    )


def pr_curve(df: DataFrame, label: str, score: str, positive: str, buckets: int | None = None) -> DataFrame:
    """Precision and recall of predicting positive at or above each distinct score."""
    totals = score_totals(df, label, score, positive, buckets)
    hits = F.col("all_positives") - F.col("positives_below")
    alarms = F.col("all_negatives") - F.col("negatives_below")
    return totals.select(
        F.col("score").alias("threshold"),
        F.try_divide(hits, hits + alarms).alias("precision"),
        F.try_divide(hits, F.col("all_positives")).alias("recall"),
    )


def metric_rows(df: DataFrame, run_id: str, split: str) -> DataFrame:
    """A one-row frame of metrics as long rows (run_id, split, metric, value)."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in numbers]
    return df.select(F.inline(F.array(*pairs))).select(
        F.lit(run_id).alias("run_id"), F.lit(split).alias("split"), "metric", "value"
    )


def append_metrics(metrics: DataFrame, table: str) -> None:
    """Append long metric rows to a metrics table, creating it on first use."""
    metrics.select("run_id", "split", "metric", "value").write.mode("append").saveAsTable(table)
