import math

import pytest
from pyspark.sql import functions as F

from holdfast.functions import key_hash
from holdfast.operators import split
from holdfast.operators.encode import TooManyCategories, categories, check_categories, distinct_counts, one_hot_wide


def test_hash_split_is_stable_and_near_its_shares(spark):
    df = spark.range(20_000)
    parts = {"test": 20, "validation": 20, "train": 60}
    once, again = split.hash_split(df, "id", parts), split.hash_split(df.repartition(17), "id", parts)
    assert once.exceptAll(again).isEmpty()
    sizes = {r["split"]: r["count"] for r in once.groupBy("split").count().collect()}
    assert abs(sizes["test"] - 4000) < 300 and abs(sizes["train"] - 12_000) < 400
    with pytest.raises(ValueError):
        split.hash_split(df, "id", {"a": 50})


@pytest.mark.parametrize("rows,fraction", [(1, 0.2), (7, 0.2), (1000, 0.2), (1003, 0.35), (10, 1.0), (10, 0.0)])
def test_exact_split_has_exact_size(spark, rows, fraction):
    got = split.exact_split(spark.range(rows), "id", fraction)
    assert got.where("split = 'test'").count() == math.ceil(round(fraction * rows, 9))


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_exact_split_ends_with_the_wanted_hash(spark, monkeypatch, digits):
    df = spark.range(5000)
    monkeypatch.setattr(split, "PREFIX", digits)
    got = split.exact_split(df, "id")
    assert got.where("split = 'test'").count() == 1000
    ranked = sorted(r["h"] for r in df.select(key_hash("id").alias("h")).collect())
    last = got.where("split = 'test'").agg(F.max(key_hash("id"))).first()[0]
    assert last == ranked[999]


def test_exact_split_reads_its_input_twice(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    split.exact_split(spark.range(500).mapInArrow(count, "id long"), "id")
    assert reads.value == 1000


def test_exact_split_keeps_a_hot_key_on_one_side(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"))
    got = split.exact_split(df, "id")
    assert got.where("id = -1").select("split").distinct().count() == 1
    test_rows = got.where("split = 'test'").count()
    assert test_rows >= 1800


def test_exact_split_of_nothing(spark):
    assert split.exact_split(spark.range(0), "id").count() == 0


def test_one_hot_rows_sum_to_at_most_one(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    known = categories(train, ["c"])
    assert known == {"c": ["a", "b"]}
    later = spark.createDataFrame([("a",), ("new",), (None,)], "c string").coalesce(1)
    got = one_hot_wide(later, known)
    assert got.columns == ["c=a", "c=b"] and [tuple(r) for r in got.collect()] == [(1, 0), (0, 0), (0, 0)]


def test_identifier_columns_are_refused(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("name"))
    with pytest.raises(TooManyCategories, match="name"):
        check_categories(distinct_counts(df, ["name"]), limit=100)
