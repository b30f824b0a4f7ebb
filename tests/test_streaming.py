"""Runs over arriving keys: pinned versions, hot keys from earlier runs, failed runs."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from holdfast.operators.lookup import FeatureLookup
from holdfast.operators.scoring import score_batch
from holdfast.operators.training import PREDICTION
from holdfast.session import shared_path
from holdfast.sources.feature_tables import (
    create_feature_table,
    drop_feature_table,
    feature_table_version,
    list_feature_tables,
    refresh_feature_table,
    table_at,
)
from holdfast.sources.models import SavedModel
from holdfast.streaming import scoring
from holdfast.streaming.scoring import Run, RunLog, score_arrivals


@pytest.fixture
def echoed(monkeypatch):
    """Predictions that say which features were read."""
    import holdfast.operators.scoring as batch

    monkeypatch.setattr(batch, "predict", lambda _, df: df.withColumn(PREDICTION, F.concat_ws("/", "kind", "level")))


@pytest.fixture
def place(spark, database):
    name = f"{database}.kinds"
    create_feature_table(name, "key", spark.range(20).selectExpr("id AS key", "'one' AS kind", "id AS level"))
    model = PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__")])
    signature = spark.table(name).schema
    saved = SavedModel(model, (FeatureLookup(name, "key", ["kind", "level"]),), signature, "label", "")
    return name, saved, shared_path(spark, "inbox"), shared_path(spark, "out"), shared_path(spark, "progress")


def arrive(spark, inbox, rows):
    spark.createDataFrame([(k, i) for i, k in enumerate(rows)], "key long, place long").repartition(3).write.mode("append").parquet(inbox)


def stream(spark, inbox):
    return spark.readStream.schema("key long, place long").option("maxFilesPerTrigger", 1).parquet(inbox)


def renew(spark, name, kind, keep=1):
    return refresh_feature_table(name, spark.table(name).withColumn("kind", F.lit(kind)), keep=keep)


def kinds(spark, out):
    return {(r["run"], r["kind"], r["n"]) for r in spark.read.parquet(out).groupBy("run", "kind").agg(F.count("*").alias("n")).collect()}


def test_versions_are_kept_and_dropped(spark, database, place):
    name = place[0]
    for number, kind in enumerate(("two", "three", "four"), 2):
        renew(spark, name, kind, keep=2)
        assert feature_table_version(spark, name) == number
    assert [spark.table(table_at(spark, name, v)).first()["kind"] for v in (4, 3, 2)] == ["four", "three", "two"]
    with pytest.raises(ValueError, match="not kept"):
        table_at(spark, name, 1)
    assert [t.name for t in list_feature_tables(spark, database) if t.name.startswith(name)] == [name]
    renew(spark, name, "five", keep=0)
    with pytest.raises(ValueError, match="not kept"):
        table_at(spark, name, 4)
    renew(spark, name, "six")
    drop_feature_table(spark, name)
    assert not spark.catalog.tableExists(f"{name}__v5")


def test_each_run_reads_one_version_and_takes_new_keys_only(spark, place, echoed):
    name, saved, inbox, out, checkpoint = place
    arrive(spark, inbox, [*range(10), None, 99])
    assert score_arrivals(saved, stream(spark, inbox), out, checkpoint).versions == {name: 1}
    renew(spark, name, "two")
    arrive(spark, inbox, range(5))
    run = score_arrivals(saved, stream(spark, inbox), out, checkpoint)
    assert (run.number, run.versions) == (1, {name: 2})
    assert kinds(spark, out) == {(0, "one", 10), (0, None, 2), (1, "two", 5)}
    assert score_arrivals(saved, stream(spark, inbox), out, checkpoint).number == 2
    assert spark.read.parquet(out).count() == 17


def test_a_failed_run_is_taken_up_with_its_versions(spark, place, echoed, monkeypatch):
    name, saved, inbox, out, checkpoint = place
    arrive(spark, inbox, range(12))
    # The batch that holds the last key fails.
    real = scoring.score_batch

    def failing(model, keys, *args, **kwargs):
        scored = real(model, keys, *args, **kwargs)
        return scored.withColumn("place", F.when(F.col("place") == last, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("place")))

    last = 11
    monkeypatch.setattr(scoring, "score_batch", failing)
    with pytest.raises(Exception, match="lost"):
        score_arrivals(saved, stream(spark, inbox), out, checkpoint)
    monkeypatch.setattr(scoring, "score_batch", real)
    renew(spark, name, "two")
    arrive(spark, inbox, [1, 2])
    run = score_arrivals(saved, stream(spark, inbox), out, checkpoint)
    assert (run.number, run.versions) == (0, {name: 1})
    assert kinds(spark, out) == {(0, "one", 14)}
    # Without the kept version the failed run cannot be finished.
    log = RunLog(spark, checkpoint)
    log.begin(Run(1, {name: 1}, {}))
    renew(spark, name, "three", keep=0)
    with pytest.raises(ValueError, match="not kept"):
        score_arrivals(saved, stream(spark, inbox), out, checkpoint)


def test_hot_keys_of_earlier_runs_are_joined_apart(spark, place, echoed, monkeypatch):
    name, saved, inbox, out, checkpoint = place
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plans = []
        real = scoring.score_batch

        def watched(*args, **kwargs):
            plans.append(kwargs["known_hot"])
            return real(*args, **kwargs)

        monkeypatch.setattr(scoring, "score_batch", watched)
        skewed = [3] * 300 + [None] * 200 + list(range(8))
        for _ in range(2):
            arrive(spark, inbox, skewed)
            score_arrivals(saved, stream(spark, inbox), out, checkpoint, hot_rows=150)
        arrive(spark, inbox, [5])
        score_arrivals(saved, stream(spark, inbox), out, checkpoint, hot_rows=150)
        last = score_arrivals(saved, stream(spark, inbox), out, checkpoint, hot_rows=150)
        assert [len(p.get(("key",), [])) for p in plans] == [0, 2, 2, 2]
        # 301 rows in each of two runs, then none: 301 * (1/2 + 1/4), and once more half of it.
        assert max(last.weights[("key",)].values()) == pytest.approx((301 * 1.5) * 0.5)
        want = score_batch(saved, spark.read.parquet(inbox), hot_rows=None)
        got = spark.read.parquet(out).drop("run")
        assert got.count() == 2 * len(skewed) + 1 and got.exceptAll(want).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_static_frames_and_clashing_names_are_refused(spark, place):
    _, saved, inbox, out, checkpoint = place
    with pytest.raises(ValueError, match="streaming"):
        score_arrivals(saved, spark.range(1), out, checkpoint)
    arrive(spark, inbox, [1])
    with pytest.raises(ValueError, match="run_column"):
        score_arrivals(saved, stream(spark, inbox), out, checkpoint, run_column="place")
