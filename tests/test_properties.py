"""Operators against plain Python on generated rows."""

import math
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from holdfast.operators import metrics, profile, split
from holdfast.operators.drift import drift_psi
from holdfast.operators.lookup import FeatureLookup, lookup_features
from pyspark.sql import functions as F

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
keys = st.one_of(st.none(), st.integers(0, 6))


@few
@given(rows=st.lists(keys, min_size=1, max_size=40), table=st.dictionaries(st.integers(0, 6), st.integers(), max_size=7))
def test_lookup_is_a_dictionary_lookup(spark, rows, table):
    small = {k: v % 1000 for k, v in table.items()}
    df = spark.createDataFrame([(k,) for k in rows], "id int").repartition(3)
    features = spark.createDataFrame(list(small.items()), "id int, v int")
    want = Counter((k, small.get(k)) for k in rows)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold, floor in (("-1", None), ("-1", 1), ("-1", 3), (old, 1)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = lookup_features(df, [FeatureLookup(features, "id")], hot_rows=floor)
            assert Counter(map(tuple, got.collect())) == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@few
@given(rows=st.lists(st.tuples(st.booleans(), st.integers(-3, 3)), min_size=1, max_size=60), buckets=st.integers(1, 9))
def test_auc_is_the_share_of_ordered_pairs(spark, rows, buckets):
    df = spark.createDataFrame([("Yes" if y else "No", s / 3) for y, s in rows], "label string, score double")
    positives, negatives = [s for y, s in rows if y], [s for y, s in rows if not y]
    got = metrics.roc_auc(df, "label", "score", "Yes", buckets).first()["roc_auc"]
    if not positives or not negatives:
        assert got is None
    else:
        won = sum((p > q) + (p == q) / 2 for p in positives for q in negatives)
        assert math.isclose(got, won / len(positives) / len(negatives), abs_tol=1e-12)


@few
@given(rows=st.lists(st.integers(0, 30), min_size=1, max_size=60), percent=st.integers(0, 100))
def test_exact_split_reaches_its_size_with_whole_keys(spark, rows, percent):
    df = spark.createDataFrame([(k,) for k in rows], "id int").repartition(2)
    got = split.exact_split(df, "id", percent / 100).collect()
    sides = {}
    for row in got:
        assert sides.setdefault(row["id"], row["split"]) == row["split"]
    size = sum(row["split"] == "test" for row in got)
    wanted = math.ceil(round(percent / 100 * len(rows), 9))
    assert wanted <= size < wanted + max(Counter(rows).values())
    if len(set(rows)) == len(rows):
        assert size == wanted


@few
@given(rows=st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", " ", "", "1", "2.5"])), max_size=40))
def test_profile_counts(spark, rows):
    df = spark.createDataFrame([(v,) for v in rows], "v string").repartition(3)
    got = profile.profile_columns(df).collect()
    filled = [v for v in rows if v is not None]
    row = got[0]
    assert (row["rows"], row["nulls"]) == (len(rows), len(rows) - len(filled))
    assert row["blanks"] == sum(v.strip(" ") == "" for v in filled)
    assert row["distinct_values"] == len(set(filled))
    best = min(Counter(filled).items(), key=lambda item: (-item[1], item[0]), default=(None, None))
    assert (row["top_value"], row["top_count"]) == best
    audit = profile.cast_audit(df).first()
    assert audit["uncastable"] == sum(v in ("a", "b", " ", "") for v in filled)


@few
@given(rows=st.lists(st.tuples(st.booleans(), st.one_of(st.none(), st.sampled_from("xyz"))), min_size=1, max_size=60))
def test_psi_of_categories(spark, rows):
    df = spark.createDataFrame(rows, "ref boolean, c string")
    got = drift_psi(df, F.col("ref"), ["c"]).first()["psi"]
    old, new = Counter(c for r, c in rows if r), Counter(c for r, c in rows if not r)
    want = 0.0
    for c in {c for _, c in rows}:
        p = max(old[c] / sum(old.values()), 1e-6) if old else 1e-6
        q = max(new[c] / sum(new.values()), 1e-6) if new else 1e-6
        want += (p - q) * math.log(p / q)
    assert math.isclose(got, want, abs_tol=1e-9)
