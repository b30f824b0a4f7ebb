from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from holdfast.operators.baseline import majority_baseline
from holdfast.operators import lookup
from holdfast.operators.lookup import (
    FeatureLookup,
    LabelLeakage,
    create_training_set,
    hot_key_hashes,
    leakage_scan,
    lookup_features,
)


@pytest.fixture
def features(spark):
    return spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, "z", 3.0)], "id int, cat string, num double")


def test_unknown_and_null_keys_keep_their_rows(spark, features):
    keys = spark.createDataFrame([(1,), (1,), (9,), (None,)], "id int")
    got = lookup_features(keys, [FeatureLookup(features, "id")])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "x", 1.0), (1, "x", 1.0), (9, None, None), (None, None, None)], key=repr
    )


def test_clashing_names_are_refused(spark, features):
    with pytest.raises(ValueError, match="already"):
        lookup_features(features, [FeatureLookup(features, "id")])


def test_lookup_key_may_have_another_name(spark, features):
    rows = spark.createDataFrame([(7, 2)], "event int, id int")
    second = features.select("id", F.col("num").alias("other"))
    got = lookup_features(rows, [FeatureLookup(features, "id", ["num"]), FeatureLookup(second, "id")])
    assert got.columns == ["event", "id", "num", "other"] and got.first() == (7, 2, 2.0, 2.0)


def skewed(spark, rows=30_000):
    """A third of the rows hold one key, a third hold NULL, the rest are spread; some keys are unknown."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 1).when(n % 3 == 1, F.lit(None)).otherwise(n % 500)
    return spark.range(rows).select(n.alias("row"), key.cast("int").alias("id"))


@contextmanager
def no_broadcasts(spark):
    """Tables count as large: the optimizer broadcasts none of them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_found_and_do_not_change_the_result(spark, features):
    df = skewed(spark)
    assert len(hot_key_hashes(df, ["id"], min_rows=1000)) == 2
    assert hot_key_hashes(df, ["id"]) == []
    second = features.select("id", F.col("num").alias("other"))
    lookups = [FeatureLookup(features, "id"), FeatureLookup(second, "id")]
    plain = lookup_features(df, lookups, hot_rows=None)
    with no_broadcasts(spark):
        routed = lookup_features(df, lookups, hot_rows=1000)
        assert routed.columns == plain.columns and routed.count() == df.count()
        assert plain.exceptAll(routed).isEmpty() and routed.exceptAll(plain).isEmpty()


def test_hot_rows_take_a_broadcast_and_the_others_a_shuffle(spark, features):
    with no_broadcasts(spark):
        text = plan_of(lookup_features(skewed(spark), [FeatureLookup(features, "id")], hot_rows=1000))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text


def test_hot_rows_are_dealt_evenly(spark, features):
    with no_broadcasts(spark):
        routed = lookup_features(skewed(spark), [FeatureLookup(features, "id")], hot_rows=1000)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            sizes = [r["count"] for r in routed.groupBy(F.spark_partition_id()).count().collect()]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 2 * sum(sizes) / 8


def test_three_hot_keys_scan_the_input_once(spark, tmp_path, features):
    skewed(spark, 3000).withColumns({"two": F.col("id"), "three": F.col("id")}).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    lookups = [
        FeatureLookup(features.select(F.col("id").alias(key), F.col("num").alias(f"n{i}")), key) for i, key in enumerate(("id", "two", "three"))
    ]
    with no_broadcasts(spark):
        routed = lookup_features(df, lookups, hot_rows=500)
        assert routed._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
        assert routed.count() == 3000
        assert routed.where("id = 1 and n0 = n1 and n1 = n2").count() == df.where("id = 1").count()


def test_tables_that_are_broadcast_need_no_pass(spark, tmp_path, features):
    def refuse(*_):
        raise AssertionError("the input was read")

    features.write.parquet(f"{tmp_path}/features")
    features = spark.read.parquet(f"{tmp_path}/features")
    broken = skewed(spark).select("row", F.udf(refuse, "int")("id").alias("id"))
    assert "BroadcastHashJoin" in plan_of(lookup_features(broken, [FeatureLookup(features, "id")], hot_rows=1))


def test_tables_that_are_not_unique_keep_all_matches(spark, features):
    df, twice = skewed(spark), features.union(features)
    plain = lookup_features(df, [FeatureLookup(twice, "id")], hot_rows=None)
    with no_broadcasts(spark):
        assert lookup_features(df, [FeatureLookup(twice, "id")], hot_rows=1000).count() == plain.count()


def test_large_hot_features_are_salted_on_both_sides(spark, features, monkeypatch):
    """No broadcast and no task with a hot key: its rows lie in many partitions, NULL keys too, and find their features."""
    plain = lookup_features(skewed(spark), [FeatureLookup(features, "id")], hot_rows=None)
    monkeypatch.setattr(lookup, "FEW_BYTES", 10)
    with no_broadcasts(spark):
        salted = lookup_features(skewed(spark), [FeatureLookup(features, "id")], hot_rows=1000)
        text = plan_of(salted)
        assert "BroadcastHashJoin" not in text and text.count("SortMergeJoin") == 1
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            sizes = [r["count"] for r in salted.groupBy(F.spark_partition_id()).count().collect()]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert salted.columns == plain.columns
        assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()
    assert max(sizes) < 2 * sum(sizes) / 8


def test_key_types_may_differ(spark, features):
    df = skewed(spark).withColumn("id", F.col("id").cast("bigint"))
    with no_broadcasts(spark):
        routed = lookup_features(df, [FeatureLookup(features, "id")], hot_rows=1000)
        assert "BroadcastHashJoin" in plan_of(routed)
        assert routed.where("id = 1 and cat = 'x'").count() == df.where("id = 1").count()


def test_no_rows_have_no_hot_keys(spark, features):
    nothing = spark.createDataFrame([], "id int")
    assert hot_key_hashes(nothing, ["id"]) == []
    assert lookup_features(nothing, [FeatureLookup(features, "id")], prefilter=True).count() == 0


def test_prefilter_broadcasts_the_keys_and_changes_nothing(spark, features):
    keys = spark.createDataFrame([(1,), (1,), (9,), (None,)], "id int")
    lookups = [FeatureLookup(features, "id")]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, want = lookup_features(keys, lookups, prefilter=True), lookup_features(keys, lookups)
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_composite_key(spark):
    table = spark.createDataFrame([(1, "a", 10), (1, "b", 20)], "id int, k string, v int")
    rows = spark.createDataFrame([(1, "b"), (2, "a")], "id int, k string")
    got = lookup_features(rows, [FeatureLookup(table, ["id", "k"])])
    assert sorted(map(tuple, got.collect())) == [(1, "b", 20), (2, "a", None)]


def test_training_set_shape(spark, features):
    labels = spark.createDataFrame([(1, "Yes"), (2, "No"), (9, "No")], "id int, churn string")
    with_label = features.withColumn("Churn", F.lit("No"))
    for excluded in ("id", ["id"]):
        training = create_training_set(labels, [FeatureLookup(with_label, "id")], "churn", excluded).load_df()
        assert training.columns == ["cat", "num", "churn"] and training.count() == 3
    with pytest.raises(LabelLeakage):
        create_training_set(labels, [FeatureLookup(with_label, "id", ["Churn"])], "churn")
    with pytest.raises(ValueError):
        create_training_set(features, [], "churn")


def test_leakage_scan_flags_a_leaked_label(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 2 == 0, "Yes").otherwise("No").alias("churn"),
        (F.col("id") % 2 == 0).alias("leak"),
        (F.col("id") % 7).alias("noise"),
        F.lit(1.0).alias("constant"),
        F.lit(None).cast("double").alias("empty"),
    )
    got = {row["feature"]: row for row in leakage_scan(df, "churn", "Yes").collect()}
    assert got["leak"]["suspicious"] and got["leak"]["correlation"] == pytest.approx(1.0)
    assert not got["noise"]["suspicious"]
    assert got["constant"]["correlation"] is None and not got["constant"]["suspicious"]
    assert got["empty"]["rows"] == 0


def test_majority_baseline_ties_and_unseen(spark):
    train = spark.createDataFrame(
        [("a", "Yes"), ("a", "Yes"), ("a", "No"), ("b", "No"), ("b", "Yes"), (None, "Yes"), ("c", None)],
        "segment string, churn string",
    )
    rows = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "segment string")
    got = dict(map(tuple, majority_baseline(rows, train, ["segment"], "churn").collect()))
    assert got == {"a": "Yes", "b": "No", "new": "Yes", None: "Yes"}
