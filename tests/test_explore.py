import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators.drift import distribution_profile, drift_psi, merge_profiles, profile_psi
from holdfast.operators.explore import BLOCK, correlation_matrix, exploration_report
from holdfast.plans.retraining import DRIFT, FIRST, METRICS, NOTHING, RunState, decide, decisions, retrain_if_needed
from holdfast.sources.feature_tables import create_feature_table, drop_feature_table, feature_table_audit, list_feature_tables
from holdfast.sources.tables import save_table


def rows_of(n, columns, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=n)
    values = np.stack([base * k + rng.normal(size=n) + 1e6 * k for k in range(columns)], axis=1)
    return [tuple(None if rng.random() < 0.1 else float(x) for x in row) for row in values]


@pytest.mark.parametrize("columns", [2, 13])
def test_correlations_equal_numpy_over_the_rows_that_have_both(spark, columns):
    rows = rows_of(300, columns)
    names = [f"c{i}" for i in range(columns)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    found = {(r["column"], r["other"]): (r["rows"], r["correlation"]) for r in correlation_matrix(df).collect()}
    assert len(found) == columns * (columns - 1) // 2
    assert columns < 13 or len(found) > BLOCK
    for (i, a), (j, b) in itertools.combinations(enumerate(names), 2):
        both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
        n, correlation = found[a, b]
        assert n == len(both)
        assert correlation == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)


def test_correlations_of_odd_columns(spark):
    rows = [(1.0, 5, True, None, math.nan, "x"), (2.0, 5, False, None, 1.0, "y"), (math.inf, 5, True, None, 2.0, None), (4.0, 5, False, None, 3.0, "z")]
    df = spark.createDataFrame(rows, "a double, same int, flag boolean, nothing double, b double, text string")
    found = {(r["column"], r["other"]): (r["rows"], r["correlation"]) for r in correlation_matrix(df).collect()}
    assert {c for pair in found for c in pair} == {"a", "same", "flag", "nothing", "b"}
    assert found["a", "same"] == (3, None)
    assert found["a", "nothing"] == (0, None)
    assert found["a", "b"][0] == 2
    assert found["a", "b"][1] == pytest.approx(1.0)
    assert all(r["rows"] == 0 and r["correlation"] is None for r in correlation_matrix(df.limit(0)).collect())
    assert correlation_matrix(df.select("text", "a")).collect() == []


def test_the_report_covers_every_section(spark):
    rows = [("k1", 1.0, "Yes", "q"), ("k2", 2.0, "No", "r"), ("k3", 3.0, "Yes", None), ("k4", 4.0, None, "")]
    df = spark.createDataFrame(rows, "id string, label_is_positive double, churn string, note string")
    found = exploration_report(df, "churn", "Yes").collect()
    cell = {(r["section"], r["subject"], r["other"], r["measure"]): (r["number"], r["text"]) for r in found}
    assert len(cell) == len(found)
    assert cell["balance", "Yes", None, "share"] == (0.5, None)
    assert cell["balance", None, None, "count"] == (1.0, None)
    assert cell["profile", "note", None, "blanks"] == (1.0, None)
    assert cell["profile", "id", None, "type"] == (None, "string")
    assert cell["correlation", "label_is_positive", "churn", "rows"] == (3.0, None)
    assert cell["summary", "label_is_positive", None, "p50"] == (2.0, None)


def drifting(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), None if x > 2 else int(x * 3), "abc"[k % 3] if k % 7 else None, k % 2 == 0) for k, x in enumerate(rng.normal(size=400))]
    rows += [(math.nan, 1, "a", True), (math.inf, 2, "new", False), (-math.inf, None, "b", False)]
    return spark.createDataFrame(rows, "x double, n int, word string, old boolean").repartition(4)


def psi(df):
    return {r["feature"]: (r["bins"], pytest.approx(r["psi"], abs=1e-9)) for r in df.collect()}


def test_psi_of_stored_profiles_equals_psi_of_the_rows(spark):
    df, names = drifting(spark), ["x", "n", "word"]
    reference = distribution_profile(df.where("old"), names, bins=7)
    current = distribution_profile(df.where("NOT old"), names, like=reference)
    assert psi(profile_psi(reference, current)) == psi(drift_psi(df, F.col("old"), names, bins=7))


def test_profiles_of_parts_add_up(spark):
    df, names = drifting(spark), ["x", "word"]
    whole = distribution_profile(df, names)
    parts = [distribution_profile(df.where(c), names, like=whole) for c in ("word = 'a'", "word <> 'a'", "word IS NULL", "false")]
    row = lambda r: (r["feature"], r["bin"], r["low"], r["high"], r["bins"], r["n"])
    assert sorted(map(row, merge_profiles(*parts).collect()), key=str) == sorted(map(row, whole.collect()), key=str)
    with pytest.raises(Exception, match="cut differently"):
        merge_profiles(whole, distribution_profile(df, names, bins=3)).collect()
    with pytest.raises(ValueError, match="no"):
        distribution_profile(df, ["n"], like=whole)


def metric(spark, value):
    return spark.createDataFrame([("any", "test", "accuracy", value)], "run_id string, split string, metric string, value double")


def test_decisions_hold_each_run_against_the_last_one_that_trained(spark, database):
    state, names = RunState(database), ["x", "word"]
    df = drifting(spark)
    moved = df.withColumn("x", F.col("x") + 1.5)
    runs = [("r1", df, 0.9), ("r2", df, 0.89), ("r3", moved, 0.9), ("r4", moved, 0.9), ("r5", moved, 0.7), ("r6", df, 0.5)]
    for run_id, frame, value in runs:
        assert decide(frame, names, state, run_id, metric(spark, value)).count() == 1
    found = [(r["run_id"], r["reference_run"], r["drifted"], r["decayed"], r["retrain"], r["reason"]) for r in decisions(spark, state).orderBy("place").collect()]
    assert found == [
        ("r1", None, "", "", True, FIRST),
        ("r2", "r1", "", "", False, NOTHING),
        ("r3", "r1", "x", "", True, DRIFT),
        ("r4", "r3", "", "", False, NOTHING),
        ("r5", "r3", "", "test/accuracy", True, METRICS),
        ("r6", "r5", "x", "test/accuracy", True, f"{DRIFT}, {METRICS}"),
    ]
    assert {r["run_id"] for r in spark.table(state.profiles).select("run_id").distinct().collect()} == {"r1", "r3", "r5", "r6"}
    with pytest.raises(ValueError, match="already"):
        decide(df, names, state, "r2")


def test_the_job_fits_nothing_without_a_reason(spark, database, tmp_path):
    rows = [(f"k{i}", float(i % 50), "Yes" if i % 50 > 25 else "No") for i in range(400)]
    name = f"{database}.features"
    create_feature_table(name, "id", spark.createDataFrame(rows, "id string, x double, churn string"))
    state = RunState(database)
    settings = {"families": ["decision_tree"], "timeout_minutes": None}
    first, trained = retrain_if_needed(spark, name, "churn", str(tmp_path / "one"), state, "one", **settings)
    assert first.first()["reason"] == FIRST
    assert trained is not None
    second, again = retrain_if_needed(spark, name, "churn", str(tmp_path / "two"), state, "two", **settings)
    assert second.first()["reason"] == NOTHING
    assert again is None
    assert not (tmp_path / "two").exists()


def test_the_audit_lists_what_is_left(spark, database):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, None)], "k string, j int, v double")
    assert feature_table_audit(spark, database).collect() == []
    for name, keys in (("one", "k"), ("two", ["k", "j"]), ("gone", "k")):
        create_feature_table(f"{database}.{name}", keys, df, f"about {name}")
    save_table(df, f"{database}.plain")
    drop_feature_table(spark, f"{database}.gone")
    df.write.insertInto(f"{database}.one")
    assert [t.name for t in list_feature_tables(spark, database)] == [f"{database}.one", f"{database}.two"]
    found = {r["table"]: (r["primary_keys"], r["features"], r["description"], r["rows"], r["keys_hold"]) for r in feature_table_audit(spark, database).collect()}
    assert found == {"one": ("k", 2, "about one", 4, False), "two": ("k, j", 1, "about two", 2, True)}
