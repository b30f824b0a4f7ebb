import pytest
from pyspark.sql import functions as F

from holdfast.functions import (
    clean_numeric,
    key_hash,
    map_category,
    percent_bucket,
    sanitise,
    strip_whitespace,
    to_boolean,
    to_number,
)
from holdfast.operators.featurize import FeatureSpec, assign_where, featurize


def values(df):
    return [row[0] for row in df.collect()]


def strings(spark, *items):
    return spark.createDataFrame([(i, item) for i, item in enumerate(items)], "i int, s string").coalesce(1)


def test_flag_keeps_null(spark):
    df = spark.createDataFrame([(0,), (1,), (None,), (2,)], "flag int").coalesce(1)
    assert values(df.select(to_boolean("flag"))) == [False, True, None, False]


def test_category_unmapped_is_null(spark):
    df = strings(spark, "Month-to-month", "One year", "Two year", "other", None)
    mapping = {"Month-to-month": 1, "One year": 12, "Two year": 24}
    assert values(df.select(map_category("s", mapping))) == [1, 12, 24, None, None]
    assert values(df.select(map_category("s", mapping, default=0))) == [1, 12, 24, 0, 0]


def test_category_needs_a_mapping():
    with pytest.raises(ValueError):
        map_category("s", {})


def test_clean_numeric_edges(spark):
    df = strings(spark, "29.85", "", " ", "   ", "\t", "abc", None, " 7 ", "-1e3")
    assert values(df.select(clean_numeric("s"))) == [29.85, 0.0, 0.0, 0.0, None, None, None, 7.0, -1000.0]
    assert values(df.select(clean_numeric("s", blank_value=-1)))[1:4] == [-1.0] * 3


def test_strip_matches_python(spark):
    items = ["\t a 　", "  x y\x85", "", " \n ", "a", "\x1cb\x1f", "​z​"]
    assert values(strings(spark, *items).select(strip_whitespace("s"))) == [item.strip() for item in items]


def test_sanitise_keeps_letters_of_any_script(spark):
    items = ["jane.doe+x@mail.org", "Łódź—2024!", "名前 1", "__a__", "", None]
    got = values(strings(spark, *items).select(sanitise("s")))
    assert got == ["jane_doe_x_mail_org", "Łódź_2024_", "名前_1", "__a__", "", None]


def test_assign_where_null_mask_keeps_value(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", 3.0)], "k string, v double").coalesce(1)
    assert values(assign_where(df, F.col("k") == "a", "v", 0.0).select("v")) == [0.0, 2.0, 3.0]


def test_assign_where_refuses_other_types(spark):
    df = spark.createDataFrame([("a", "x")], "k string, v string")
    with pytest.raises(TypeError):
        assign_where(df, F.col("k") == "a", "v", 1)


def test_featurize_is_one_projection(spark):
    df = spark.createDataFrame([(1, "One year", " ", "x")], "senior int, contract string, total string, other string")
    spec = FeatureSpec({"senior": 1}, {"contract": {"One year": 12}}, {"total": 0.0})
    typed = featurize(df, spec)
    assert [f.dataType.simpleString() for f in typed.schema.fields] == ["boolean", "int", "double", "string"]
    assert typed.first() == (True, 12, 0.0, "x")
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1
    with pytest.raises(ValueError):
        FeatureSpec({"a": 1}, {}, {"a": 0.0}).columns()


def test_hash_is_independent_of_partitioning_and_type(spark):
    df = spark.range(1000).withColumn("text", F.col("id").cast("string"))
    one = df.select("id", percent_bucket("id").alias("b"))
    other = df.repartition(13).select("id", percent_bucket("text").alias("b"))
    assert one.exceptAll(other).isEmpty()
    assert df.select(key_hash(["id", "text"])).first()[0] != df.select(key_hash(["id", "text"], seed=7)).first()[0]


def test_to_number_takes_decimal_numbers_only(spark):
    numbers = {
        "1": 1.0, "-1.5": -1.5, "+2": 2.0, ".5": 0.5, "5.": 5.0, "1e3": 1000.0, "1E-3": 0.001, " 7 ": 7.0, "\t8\n": 8.0,
        "\x1f9": 9.0, "-0.0": -0.0,
    }
    others = [
        "NaN", "nan", "-inf", "+Infinity", "infinity", "INF", "1d", "12d", "1f", "3f", "0x10", "0x1p3", "", " ", "abc",
        "No", "Infix", "name", "-", "+", ".", "e5", "1e", "1,000", None, "\u00a01", "\u0661", "--1", "+ 1", "1 2", "1_000",
        "NULL", "true",
    ]
    df = strings(spark, *numbers, *others).select("s", to_number("s").alias("n"), clean_numeric("s").alias("c"))
    rows = df.collect()
    assert {r["s"]: r["n"] for r in rows if r["n"] is not None} == numbers
    blanks = {"": 0.0, " ": 0.0}
    assert {r["s"]: r["c"] for r in rows if r["c"] is not None} == {**numbers, **blanks}


def test_compound_keys_have_hashes_of_their_own(spark):
    rows = [("a", "b|c"), ("a|b", "c"), ("a", None), (None, "a"), ("a", ""), ("", "a"), (None, None), ("|-", "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(key_hash(["x", "y"]).alias("h")).distinct().count() == len(rows)


def test_flags_may_be_compared_with_null_as_a_value(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "flag int")
    plain, safe = to_boolean("flag"), to_boolean("flag", null_safe=True)
    assert [tuple(r) for r in df.select(plain, safe).collect()] == [(True, True), (False, False), (None, False)]
