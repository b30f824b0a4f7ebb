"""Retraining by need: what a run leaves behind, the decision of the next one, and a job that does nothing without cause."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.drift import distribution_profile, metric_decay, profile_psi
from holdfast.operators.lookup import FeatureLookup, create_training_set
from holdfast.plans.jobs import Retrained, retrain
from holdfast.sources.feature_tables import get_feature_table, read_feature_table

PSI_LIMIT, TOLERANCE = 0.2, 0.05
FIRST, DRIFT, METRICS, NOTHING = "first run", "drift", "metrics", "nothing changed"

_DECISIONS = "place int, run_id string, reference_run string, drifted string, greatest_psi double, decayed string, retrain boolean, reason string"


@dataclass(frozen=True)
class RunState:
    """The tables in which runs are kept: a distribution profile per reference run, metrics, and a decision per run."""

    database: str

    @property
    def profiles(self) -> str:
        return f"{self.database}.run_profiles"

    @property
    def metrics(self) -> str:
        return f"{self.database}.run_metrics"

    @property
    def decisions(self) -> str:
        return f"{self.database}.run_decisions"


def decisions(spark: SparkSession, state: RunState) -> DataFrame:
    """One row per run, in the order of ``place``; a few short rows per month."""
    if not spark.catalog.tableExists(state.decisions):
        return spark.createDataFrame([], _DECISIONS)
    return spark.table(state.decisions)


def decide(
    df: DataFrame,
    columns: Sequence[str],
    state: RunState,
    run_id: str,
    metrics: DataFrame | None = None,
    psi_limit: float = PSI_LIMIT,
    tolerance: float = TOLERANCE,
    bins: int = 10,
) -> DataFrame:
    """Whether this run should train anew, as one row that is also appended to the state.

    The run is held against the last one that did train: its profile stands for the rows that the model was fitted
    on, which are not read again. A feature whose PSI is above the limit and a metric (rows of ``run_id``, ``split``,
    ``metric``, ``value``) that got worse by more than the tolerance are reasons; so is being the first run. Only a run
    that should train leaves its profile and metrics as the new reference, so that slow drift adds up
    against the rows of the model and not against last month. A run id can be used once.
    """
    spark = df.sparkSession
    earlier = sorted(decisions(spark, state).collect(), key=lambda row: row["place"])
    if any(row["run_id"] == run_id for row in earlier):
        raise ValueError(f"there is a run {run_id} already")
    reference = next((row["run_id"] for row in reversed(earlier) if row["retrain"]), None)
    drifted, greatest, decayed = [], None, []
    like = None
    if reference is not None:
        like = spark.table(state.profiles).where(F.col("run_id") == reference).drop("run_id")
        current = distribution_profile(df, columns, like=like)
        found = profile_psi(like, current).where(F.col("feature").isin(list(columns))).collect()
        drifted = sorted(row["feature"] for row in found if row["psi"] > psi_limit)
        greatest = max((row["psi"] for row in found), default=None)
        if metrics is not None and spark.catalog.tableExists(state.metrics):
            known = spark.table(state.metrics).where(F.col("run_id") == reference)
            both = known.unionByName(metrics.withColumn("run_id", F.lit(run_id)).select(known.columns))
            worse = metric_decay(both, reference, run_id, tolerance).where("decayed").collect()
            decayed = sorted(f"{row['split']}/{row['metric']}" for row in worse)
    reasons = [FIRST] * (reference is None) + [DRIFT] * bool(drifted) + [METRICS] * bool(decayed)
    row = (len(earlier) + 1, run_id, reference, ", ".join(drifted), greatest, ", ".join(decayed), bool(reasons), ", ".join(reasons) or NOTHING)
    if reasons:
        profile = distribution_profile(df, columns, bins)
        profile.withColumn("run_id", F.lit(run_id)).write.mode("append").saveAsTable(state.profiles)
        if metrics is not None:
            metrics.select(F.lit(run_id).alias("run_id"), "split", "metric", "value").write.mode("append").saveAsTable(state.metrics)
    decision = spark.createDataFrame([row], _DECISIONS)
    decision.write.mode("append").saveAsTable(state.decisions)
    return decision


def retrain_if_needed(
    spark: SparkSession,
    table: str,
    label: str,
    model_path: str,
    state: RunState,
    run_id: str,
    metrics: DataFrame | None = None,
    labels: DataFrame | None = None,
    psi_limit: float = PSI_LIMIT,
    tolerance: float = TOLERANCE,
    **settings,
) -> tuple[DataFrame, Retrained | None]:
    """The monthly job: decide over the feature table's columns, and search and save a model only for a reason.

    ``metrics`` are those of the model in use on the newest labels. ``settings`` go to ``retrain``. Without a reason no
    model is fitted and nothing but the decision is written.
    """
    keys = list(get_feature_table(spark, table).primary_keys)
    rows = read_feature_table(spark, table)
    if labels is not None:
        rows = create_training_set(labels, [FeatureLookup(table, keys)], label).load_df()
    columns = [c for c in rows.columns if c not in (*keys, label)]
    decision = decide(rows, columns, state, run_id, metrics, psi_limit, tolerance)
    if not decision.first()["retrain"]:
        return decision, None
    return decision, retrain(spark, table, label, model_path, labels=labels, **settings)
