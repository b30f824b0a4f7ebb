"""What the queries' plans must and must not contain."""

import re

import pytest

from holdfast.plans.churn import churn_frame
from holdfast.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
MODELS = {"gbt_predictions", "auto_trials", "score_batch"}
# Their only unpartitioned window runs over one row per range of scores.
RANGE_TOTALS = {"roc_auc", "roc_curve", "pr_curve"}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_no_cross_join_no_python_no_global_window(spark, name):
    plan = physical(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas"):
        assert bad not in plan
    if name not in RANGE_TOTALS:
        assert "Window [" not in plan


def scanned(plan, table):
    return re.search(rf"{table}\.parquet.*?ReadSchema: struct<(.*?)>", plan, re.S).group(1)


def full_plan(df):
    modes = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return df._jdf.queryExecution().explainString(modes.fromString("formatted"))


def test_scans_read_only_what_is_asked_for(spark):
    labels = full_plan(churn_frame(spark, SF_DIR, ["customer_id", "churn"]))
    assert "nation.parquet" not in labels
    assert scanned(labels, "customer") == "c_custkey:bigint,c_name:string"
    assert scanned(labels, "orders") == "o_custkey:bigint,o_orderdate:timestamp_ntz"
    flags = full_plan(churn_frame(spark, SF_DIR, ["customer_id", "senior"]))
    assert "orders.parquet" not in flags and scanned(flags, "customer") == "c_name:string,c_nationkey:int"


def test_filters_reach_the_scan(spark):
    frame = churn_frame(spark, SF_DIR, ["customer_id", "segment"]).where("segment = 'BUILDING'")
    assert "EqualTo(c_mktsegment,BUILDING)" in full_plan(frame)


def test_orders_are_reduced_before_their_shuffle(spark):
    plan = physical(QUERIES["featurize"](spark, SF_DIR))
    shuffle, partial = plan.index("Exchange hashpartitioning(o_custkey"), plan.index("partial_max(o_orderdate")
    assert shuffle < partial


def test_a_preview_keeps_a_few_rows_per_task(spark):
    assert "TakeOrderedAndProject" in physical(QUERIES["input_example"](spark, SF_DIR))
