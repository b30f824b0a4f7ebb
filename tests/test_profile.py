import math

import pytest
from pyspark.sql import functions as F

from holdfast.operators import aggregate, profile


@pytest.fixture
def raw(spark):
    rows = [
        ("a", 0, "1.5", 1.0),
        ("b", 1, " ", 2.0),
        ("c", 1, "abc", None),
        (None, None, None, 4.0),
        ("a", 0, "1.5", 4.0),
    ]
    return spark.createDataFrame(rows, "key string, flag int, amount string, number double")


def by(df, column):
    return {row[column]: row.asDict() for row in df.collect()}


def test_value_counts_drop_null(raw):
    assert [tuple(r) for r in aggregate.value_counts(raw, "key").collect()] == [("a", 2), ("b", 1), ("c", 1)]
    assert aggregate.value_counts(raw, "key", dropna=False).count() == 4


def test_class_balance_counts_null_class(raw):
    shares = by(aggregate.class_balance(raw, "flag"), "flag")
    assert shares[0]["share"] == 0.4 and shares[None]["count"] == 1
    assert aggregate.class_balance(raw.limit(0), "flag").count() == 0


def test_pivot_finds_or_takes_values(raw):
    counts = aggregate.group_count(raw.where("flag is not null and key is not null"), ["key", "flag"], "n")
    found = by(aggregate.pivot_counts(counts, "key", "flag", "n"), "key")
    assert found["a"] == {"key": "a", "0": 2, "1": None}
    given = aggregate.pivot_counts(counts, "key", "flag", "n", [0, 1, 2])
    assert given.columns == ["key", "0", "1", "2"]


def test_describe_matches_pandas_api(raw):
    got = by(profile.describe_numeric(raw, ["number"]), "statistic")
    want = raw.select("number").pandas_api().describe()["number"].to_dict()
    for name, value in want.items():
        assert got[name]["number"] == pytest.approx(value)


def test_summary_matches_spark_summary(raw):
    got = by(profile.summary_typed(raw), "column")
    want = {row["summary"]: row for row in raw.summary().collect()}
    assert got["amount"]["mean"] == pytest.approx(float(want["mean"]["amount"]))
    assert got["amount"]["min_text"] == want["min"]["amount"]
    assert got["number"]["p50"] == float(want["50%"]["number"])
    assert got["key"]["mean"] is None and got["key"]["count"] == 4


def test_profile_exact_and_sketched_agree_on_small_data(raw):
    exact, sketched = profile.profile_columns(raw), profile.profile_columns(raw, exact=False)
    assert exact.columns == sketched.columns
    got = by(exact, "column")
    assert got["amount"]["blanks"] == 1 and got["amount"]["nulls"] == 1 and got["amount"]["distinct_values"] == 3
    assert (got["number"]["top_value"], got["number"]["top_count"]) == ("4.0", 2)
    same = [c for c in exact.columns if c != "top_value"]
    assert exact.select(same).exceptAll(sketched.select(same)).isEmpty()


def test_histogram_constant_and_null(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 10.0), (None, 9.99)], "same double, spread double")
    rows = {(r["column"], r["bin"]): r["count"] for r in profile.histogram(df, bins=10).collect()}
    assert rows == {("same", 0): 2, ("spread", 0): 1, ("spread", 9): 2}


def test_cast_audit(raw):
    got = by(profile.cast_audit(raw), "column")
    assert got["amount"] == {"column": "amount", "rows": 5, "nulls": 1, "blanks": 1, "uncastable": 2}


def test_primary_key_audit_and_offenders(raw):
    audit = profile.primary_key_audit(raw, "key").first().asDict()
    assert audit == {
        "rows": 5, "null_key_rows": 1, "distinct_keys": 3, "duplicated_keys": 1, "surplus_rows": 1,
    }
    assert [tuple(r) for r in profile.duplicate_keys(raw, "key").collect()] == [("a", 2)]
    empty = profile.primary_key_audit(raw.limit(0), "key").first()
    assert empty["rows"] == 0 and empty["surplus_rows"] == 0


def test_no_global_sort_and_no_python_in_plans(raw):
    for df in (
        profile.profile_columns(raw), profile.cast_audit(raw), profile.summary_typed(raw),
        profile.primary_key_audit(raw, "key"), profile.histogram(raw),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_sql_over_frames(raw):
    assert aggregate.sql_over("SELECT count(*) AS n FROM {rows}", rows=raw).first()["n"] == 5


def test_hot_value_is_combined_before_the_shuffle(spark):
    hot = spark.range(100_000).select(F.when(F.col("id") % 3 != 1, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    plan = aggregate.value_counts(hot, "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_empty_frames_have_empty_statistics(raw):
    got = by(profile.summary_typed(raw.limit(0)), "column")
    assert got["number"]["count"] == 0 and got["number"]["mean"] is None and got["number"]["p50"] is None
    assert by(profile.describe_numeric(raw.limit(0), ["number"]), "statistic")["std"]["number"] is None
    assert by(profile.profile_columns(raw.limit(0), exact=False), "column")["key"]["rows"] == 0


def test_moments_survive_a_large_offset(spark):
    """Many partitions, tiny spread around a large mean: sums of squares would lose every digit."""
    df = spark.range(0, 10_000, numPartitions=37).select((F.lit(1e9) + (F.col("id") % 10) / 10).alias("v"))
    got = by(profile.describe_numeric(df), "statistic")
    want = df.agg(F.stddev_samp("v"), F.avg("v")).first()
    assert got["std"]["v"] == pytest.approx(want[0], rel=1e-9) and got["mean"]["v"] == pytest.approx(want[1])


def test_large_percentiles_stay_within_their_rank_error(spark):
    rows = 400_000
    df = spark.range(0, rows, numPartitions=20).select(F.pmod(F.xxhash64("id"), F.lit(rows)).cast("double").alias("v"))
    got = by(profile.describe_numeric(df), "statistic")
    for share, name in ((0.25, "25%"), (0.5, "50%"), (0.75, "75%")):
        rank = df.where(F.col("v") <= got[name]["v"]).count() / rows
        assert abs(rank - share) < 0.002


def test_histogram_keeps_nan_and_infinities_apart(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(nan,), (inf,), (-inf,), (None,)], "v double")
    rows = {r["bin"]: r["count"] for r in profile.histogram(df, ["v"], bins=10).collect()}
    assert rows == {**dict.fromkeys(range(10), 10), -1: 1, 10: 1, 11: 1}


def test_zeros_of_either_sign_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (-0.0,), (1.0,)], "v double")
    for exact in (True, False):
        row = profile.profile_columns(df, exact=exact).first()
        assert row["distinct_values"] == 2 and row["top_count"] == 3 and row["zeros"] == 3


def test_quartiles_are_exact_beyond_any_sketch(spark):
    n = 120_000
    df = spark.range(n).selectExpr(
        "id * 7919 % 120000 AS a", "cast(id % 3 AS double) AS b", "CASE WHEN id % 50 = 0 THEN 1e300 ELSE -id / 7 END AS c",
        "CASE WHEN id % 2 = 0 THEN double('NaN') ELSE double(id) END AS d", "cast(null AS double) AS e", "5 AS f",
    )
    want = {r["statistic"]: r for r in profile.describe_numeric(df).collect()}
    pandas = df.toPandas()
    for column in "abcdef":
        values = sorted(v for v in pandas[column].tolist() if v is not None and v == v)
        for share, label in ((0.25, "25%"), (0.5, "50%"), (0.75, "75%")):
            rank = max(len(values) - math.floor(len(values) - share * len(values)), 1)
            assert want[label][column] == (values[rank - 1] if values else None)


def test_a_wrong_sketch_only_costs_a_pass(spark, monkeypatch):
    monkeypatch.setattr(profile, "MARGIN", -0.2)
    df = spark.range(1000).selectExpr("double(id) AS v")
    found = {r["statistic"]: r["v"] for r in profile.describe_numeric(df).collect()}
    assert (found["25%"], found["50%"], found["75%"]) == (249.0, 499.0, 749.0)
