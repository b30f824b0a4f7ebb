import re
from collections import Counter

import pytest
from llm_cases import ODD
from pyspark.sql import functions as F

from holdfast.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    features = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    n, chars, symbols, dup, repeated = features
    base = n < 50 or 100 * repeated > 50 * n
    rejected = base or 10 * symbols > n or chars < 2 * n or chars > 30 * n or 4 * dup > n
    return (*features, base, not rejected)


CASES = [
    *ODD,
    (10, " ".join(f"word{i}" for i in range(60))),
    (11, "a b c a b c d e f a b " * 30),
    (12, "\n".join(["same line", "same line", " same line", "", "\t", "other"] * 20)),
    (13, " ".join(f"w{i} #|$" for i in range(60))),
    (14, "x y x y x y z"),
    (15, "a b c"),
    (16, "a b c d"),
]


def test_query_equals_brute_force(spark, tmp_path):
    spark.createDataFrame(CASES, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in quality.op8(spark, str(tmp_path)).collect()]
    assert sorted(rows, key=str) == sorted(((k, *brute(t)) for k, t in CASES), key=str)


def test_filter_keeps_what_no_rule_rejects(frame):
    df = frame(CASES)
    kept = quality.filter_quality(df)
    assert kept.columns == df.columns
    want = sorted((str(k) for k, t in CASES if brute(t)[-1]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_order_never_changes_the_verdict(frame):
    rules = list(quality.RULES)
    for order in (rules, rules[::-1], rules[2:] + rules[:2]):
        rows = quality.quality_features(frame(CASES), rules=order).select("doc_id", "quality.rejected_by").collect()
        assert sorted(str(r.doc_id) for r in rows if r.rejected_by is None) == sorted(str(k) for k, t in CASES if brute(t)[-1])


def test_rules_that_reject_most_per_cost_come_first(spark):
    junk = spark.createDataFrame([(" ".join(["# $ %"] * 60),)] * 20, "text string")
    order = quality.rule_order(junk, "text")
    names = [rule.name for rule in order]
    assert len(names) == len(quality.RULES) and names.index("symbols") < names.index("short")


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.filter_quality(empty).collect() == []
    assert quality.rule_order(empty, "text") == list(quality.RULES)


@pytest.mark.parametrize("name", ["op8_quality_rules", "op5_exact_search"])
def test_sql(spark, name):
    import duckdb

    from holdfast.llm.queries import ORACLES, QUERIES

    sf_dir = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    relation = connection.sql(ORACLES[name])
    rows = QUERIES[name](spark, sf_dir)
    assert rows.columns == list(relation.columns)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(relation.fetchall(), key=str)


def test_costs_follow_the_work_and_not_the_job(spark):
    import random

    rng = random.Random(4)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(4000))

    def costs(rows):
        sample = spark.createDataFrame([(text,)] * rows, "text string").coalesce(1)
        sample = sample.withColumn("words", quality.words_of(F.col("text")))
        return quality.feature_costs(sample, quality.features_of(F.col("text"), F.col("words")), 4)

    one, many = costs(1), costs(60)
    # The dearest feature of 60 texts costs far more than that of one, and counting words far less than sorting windows.
    assert many["n_repeat_words"] > 8 * one["n_repeat_words"]
    assert many["n_repeat_words"] > 3 * many["n_symbols"]


def test_samples_come_from_all_over_the_table(spark):
    rows = spark.range(0, 20_000, 1, 20).select(F.spark_partition_id().cast("string").alias("text"))
    drawn = quality.sample_texts(rows, "text", 200)
    assert len(drawn) == 200 and len(set(drawn)) > 15


def test_order_takes_what_rejects_most_for_least(spark):
    names = quality.rule_order(spark.createDataFrame([("too short",)] * 50, "text string"), "text")
    assert names[0].name == "short" and {r.name for r in names} == {r.name for r in quality.RULES}


def test_a_column_of_the_working_name_stays(spark):
    df = spark.createDataFrame([("a b", 7)], "text string, quality_words int")
    row = quality.quality_features(df).first()
    assert row.quality_words == 7 and row.quality.n_words == 2
