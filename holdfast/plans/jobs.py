"""Whole jobs for spark-submit: ingest and featurize, train from a feature table, and the monthly retraining."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from holdfast.operators.aggregate import class_balance
from holdfast.operators.featurize import FeatureSpec, featurize
from holdfast.operators.lookup import FeatureLookup, create_training_set, leakage_scan
from holdfast.operators.metrics import append_metrics
from holdfast.operators.profile import profile_columns, summary_typed
from holdfast.operators.search import FAMILIES, TIMEOUT_MINUTES, Search, auto_classify
from holdfast.operators.training import Fit, fit_churn
from holdfast.sources.feature_tables import (
    FeatureTable,
    create_feature_table,
    get_feature_table,
    read_feature_table,
    refresh_feature_table,
)
from holdfast.sources.files import read_csv
from holdfast.sources.models import save_model
from holdfast.sources.tables import save_table


def ingest(spark: SparkSession, path: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV directory as a managed table."""
    save_table(read_csv(spark, path, schema), name)
    return spark.table(name)


def build_features(
    spark: SparkSession,
    source: str,
    spec: FeatureSpec,
    name: str,
    primary_keys: str | Sequence[str],
    description: str = "",
    buckets: int = 0,
) -> FeatureTable:
    """Type the columns of a table and keep the result as a feature table; a later run refreshes its rows.

    A refresh keeps the table's buckets, and its keys must be the given ones.
    """
    features = featurize(spark.table(source), spec)
    if not spark.catalog.tableExists(name):
        return create_feature_table(name, primary_keys, features, description, buckets)
    keys = [primary_keys] if isinstance(primary_keys, str) else list(primary_keys)
    stored = list(get_feature_table(spark, name).primary_keys)
    if stored != keys:
        raise ValueError(f"{name} has the primary keys {stored}, not {keys}")
    return refresh_feature_table(name, features, description or None)


def train(
    labels: DataFrame,
    lookups: Sequence[FeatureLookup],
    label: str,
    key: str | Sequence[str],
    model_path: str,
    metrics_table: str | None = None,
    run_id: str = "run",
    **settings,
) -> Fit:
    """Training set by lookup, boosted trees, metrics, and a model that can score bare keys.

    The stored training frame is deleted at the end; the model and the metrics stay.
    """
    training = create_training_set(labels, lookups, label).load_df()
    fit = fit_churn(training, label, key, run_id=run_id, **settings)
    if metrics_table:
        append_metrics(fit.metrics, metrics_table)
    save_model(fit.model, model_path, fit.prepared.rows, label, lookups)
    fit.prepared.release()
    return fit


def explore(df: DataFrame, label: str, positive: str) -> dict[str, DataFrame]:
    """The exploration report of a training table."""
    return {
        "summary": summary_typed(df),
        "profile": profile_columns(df, exact=False),
        "class_balance": class_balance(df, label),
        "correlations": leakage_scan(df, label, positive),
    }


@dataclass(frozen=True)
class Retrained:
    search: Search
    model_path: str


def retrain(
    spark: SparkSession,
    table: str,
    label: str,
    model_path: str,
    metrics_table: str | None = None,
    timeout_minutes: float | None = TIMEOUT_MINUTES,
    families: Sequence[str] = tuple(FAMILIES),
    labels: DataFrame | None = None,
) -> Retrained:
    """Read a feature table, search models, keep the best one. Scheduling is left to whoever submits the job.

    The stored training frame is deleted at the end. The label comes from the table or, where it is kept apart, from ``labels`` (keys and label).
    """
    keys = list(get_feature_table(spark, table).primary_keys)
    lookup = FeatureLookup(table, keys)
    if labels is None:
        rows = read_feature_table(spark, table)
    else:
        rows = create_training_set(labels, [lookup], label).load_df()
    search = auto_classify(rows, label, keys, timeout_minutes=timeout_minutes, families=families)
    if metrics_table:
        append_metrics(search.metrics, metrics_table)
    best_lookup = FeatureLookup(table, keys, list(search.prepared.features))
    rows_used = search.prepared.rows
    save_model(search.best_model, model_path, rows_used, label, [best_lookup], "best trial of the search")
    search.prepared.release()
    return Retrained(search, model_path)
