import math

import pytest
from pyspark.sql import functions as F

from holdfast.operators import drift, metrics
from holdfast.operators.search import best_trial


@pytest.fixture(scope="module")
def scored(spark):
    n = F.col("id")
    return spark.range(3000).select(
        F.when((n * 7919) % 11 < 4, "Yes").otherwise("No").alias("label"),
        # A third of the rows share one score.
        F.when(n % 3 == 0, 0.5).otherwise(((n * 104_729) % 1000) / 1000).alias("score"),
        F.when((n * 31) % 5 < 2, "Yes").otherwise("No").alias("prediction"),
    ).persist()


def brute_auc(rows):
    positives = [r["score"] for r in rows if r["label"] == "Yes"]
    negatives = [r["score"] for r in rows if r["label"] == "No"]
    won = sum((p > q) + (p == q) / 2 for p in positives for q in negatives)
    return won / (len(positives) * len(negatives))


def test_roc_auc_matches_brute_force_for_any_buckets(scored):
    want = brute_auc(scored.collect())
    for buckets in (1, 2, 8, 100):
        got = metrics.roc_auc(scored, "label", "score", "Yes", buckets).first()["roc_auc"]
        assert got == pytest.approx(want, abs=1e-12)


def test_roc_auc_ignores_a_monotone_transform(scored):
    moved = scored.withColumn("score", F.exp(F.col("score") * 3) - 100)
    one = metrics.roc_auc(scored, "label", "score", "Yes").first()[0]
    assert metrics.roc_auc(moved, "label", "score", "Yes").first()[0] == pytest.approx(one, abs=1e-12)


def test_roc_auc_edges(spark):
    one_class = spark.createDataFrame([("Yes", 0.1), ("Yes", 0.2)], "label string, score double")
    assert metrics.roc_auc(one_class, "label", "score", "Yes").first()[0] is None
    nothing = one_class.limit(0)
    assert metrics.roc_auc(nothing, "label", "score", "Yes").first()[0] is None
    infinite = spark.createDataFrame(
        [("Yes", float("inf")), ("No", float("-inf")), ("No", None), (None, 1.0)], "label string, score double"
    )
    assert metrics.roc_auc(infinite, "label", "score", "Yes").first()[0] == 1.0


def test_curves_end_where_they_should(scored):
    curve = metrics.roc_curve(scored, "label", "score", "Yes", 8).orderBy("threshold").collect()
    assert (curve[0]["fpr"], curve[0]["tpr"]) == (1.0, 1.0)
    assert [c["tpr"] for c in curve] == sorted((c["tpr"] for c in curve), reverse=True)
    area = sum(
        (a["fpr"] - b["fpr"]) * (a["tpr"] + b["tpr"]) / 2
        for a, b in zip(curve, [*curve[1:], {"fpr": 0.0, "tpr": 0.0}])
    )
    assert area == pytest.approx(brute_auc(scored.collect()))
    precision = metrics.pr_curve(scored, "label", "score", "Yes", 8).orderBy("threshold").first()
    assert precision["recall"] == 1.0


def test_accuracy_is_the_trace_of_the_confusion_matrix(scored):
    cells = metrics.confusion_matrix(scored, "label", "prediction").collect()
    trace = sum(c["count"] for c in cells if c["label"] == c["prediction"])
    got = metrics.accuracy(scored, "label", "prediction").first()
    assert got["correct"] == trace and got["accuracy"] == pytest.approx(trace / 3000)


def test_precision_recall_of_absent_classes(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", None), (None, "a")], "label string, prediction string")
    got = {r["class"]: r.asDict() for r in metrics.precision_recall_f1(df, "label", "prediction").collect()}
    assert got["a"]["precision"] == 1.0 and got["a"]["recall"] == 0.5
    assert got["b"]["recall"] is None and got["c"]["precision"] is None and got["c"]["recall"] == 0.0


def test_log_loss_is_finite_for_sure_predictions(spark):
    df = spark.createDataFrame([("Yes", 1.0), ("No", 0.0), ("Yes", 0.5)], "label string, p double")
    assert metrics.log_loss(df, "label", "p", "Yes").first()["log_loss"] == pytest.approx(math.log(2) / 3)
    wrong = spark.createDataFrame([("No", 1.0)], "label string, p double")
    assert math.isfinite(metrics.log_loss(wrong, "label", "p", "Yes").first()["log_loss"])


def test_metrics_are_appended(spark, database, scored):
    name = f"{database}.metrics"
    for run in ("r1", "r2"):
        metrics.append_metrics(metrics.metric_rows(metrics.accuracy(scored, "label", "prediction"), run, "test"), name)
    assert spark.table(name).columns == ["run_id", "split", "metric", "value"]
    assert spark.table(name).where("metric = 'accuracy'").count() == 2


def test_best_trial_breaks_ties_and_skips_null(spark):
    trials = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", None), ("d", 0.1)], "trial_id string, metric double")
    assert best_trial(trials).first()["trial_id"] == "a"
    assert best_trial(trials, larger_is_better=False).first()["trial_id"] == "d"


def test_psi_is_zero_for_equal_and_large_for_moved_data(spark):
    n = F.col("id")
    rows = spark.range(4000).select(
        (n % 2 == 0).alias("reference"),
        F.floor(n / 2).cast("double").alias("same"),
        (F.floor(n / 2) + F.when(n % 2 == 0, 0).otherwise(1500)).cast("double").alias("moved"),
        F.when(n % 4 < 2, "x").alias("category"),
        F.lit(3.0).alias("constant"),
    )
    got = {
        r["feature"]: r["psi"]
        for r in drift.drift_psi(rows, F.col("reference"), ["same", "moved", "category", "constant"]).collect()
    }
    assert got["same"] == pytest.approx(0) and got["category"] == pytest.approx(0) and got["constant"] == 0
    assert got["moved"] > 1
    assert drift.needs_retraining(drift.drift_psi(rows, F.col("reference"), ["moved"]))
    assert not drift.needs_retraining(drift.drift_psi(rows, F.col("reference"), ["same"]))


def test_decay(spark):
    rows = [("old", "test", "accuracy", 0.9), ("new", "test", "accuracy", 0.8), ("other", "test", "accuracy", 0.1)]
    frame = spark.createDataFrame(rows, "run_id string, split string, metric string, value double")
    got = drift.metric_decay(frame, "old", "new").first()
    assert got["loss"] == pytest.approx(0.1) and got["decayed"]
    flat = spark.createDataFrame([], "feature string, bins bigint, psi double")
    assert drift.needs_retraining(flat, drift.metric_decay(frame, "old", "new"))
    assert not drift.needs_retraining(flat, drift.metric_decay(frame, "new", "old"))


def test_decay_of_a_loss(spark):
    rows = [("old", "test", "log_loss", 0.3), ("new", "test", "log_loss", 0.9), ("old", "test", "accuracy", 0.5), ("new", "test", "accuracy", 0.9)]
    frame = spark.createDataFrame(rows, "run_id string, split string, metric string, value double")
    worse = {r["metric"]: r["decayed"] for r in drift.metric_decay(frame, "old", "new").collect()}
    better = {r["metric"]: r["decayed"] for r in drift.metric_decay(frame, "new", "old").collect()}
    assert worse == {"log_loss": True, "accuracy": False} and better == {"log_loss": False, "accuracy": True}


def test_drift_with_nan_and_infinities(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(True, float(i)) for i in range(100)] + [(False, float(i)) for i in range(100)]
    plain = spark.createDataFrame(rows, "r boolean, v double")
    odd = plain.union(spark.createDataFrame([(True, nan), (False, nan), (True, inf), (False, inf), (False, -inf)], "r boolean, v double"))
    assert drift.drift_psi(plain, F.col("r"), ["v"]).first()["bins"] == 10
    found = drift.drift_psi(odd, F.col("r"), ["v"]).first()
    assert found["bins"] == 13 and 0 < found["psi"] < 0.2
    none = spark.createDataFrame([(True, nan), (False, 1.0)], "r boolean, v double")
    assert drift.drift_psi(none, F.col("r"), ["v"]).first()["bins"] == 2


def test_curves_shuffle_their_scores_once(spark, tmp_path):
    rows = [("Yes" if i % 3 else "No", float(i % 97)) for i in range(2000)]
    spark.createDataFrame(rows, "label string, score double").write.parquet(f"{tmp_path}/scores")
    curve = metrics.roc_curve(spark.read.parquet(f"{tmp_path}/scores"), "label", "score", "Yes")
    curve.collect()
    text = curve._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text
