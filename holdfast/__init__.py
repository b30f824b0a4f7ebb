"""Holdfast: keyed features, training sets, models and batch scoring on Spark."""

# ruff: noqa: F401

from holdfast.operators.aggregate import class_balance, group_count, pivot_counts, sql_over, value_counts
from holdfast.operators.baseline import majority_baseline
from holdfast.operators.drift import drift_psi, metric_decay, needs_retraining
from holdfast.operators.encode import one_hot_wide
from holdfast.operators.featurize import FeatureSpec, assign_where, featurize
from holdfast.operators.lookup import (
    FeatureLookup,
    LabelLeakage,
    create_training_set,
    leakage_scan,
    lookup_features,
)
from holdfast.operators.metrics import (
    accuracy,
    append_metrics,
    confusion_matrix,
    log_loss,
    pr_curve,
    precision_recall_f1,
    roc_auc,
    roc_curve,
)
from holdfast.operators.profile import (
    cast_audit,
    describe_numeric,
    duplicate_keys,
    histogram,
    primary_key_audit,
    profile_columns,
    summary_typed,
)
from holdfast.operators.scoring import score_batch
from holdfast.operators.search import auto_classify, best_trial
from holdfast.operators.split import exact_split, hash_split
from holdfast.operators.training import fit_churn
from holdfast.sources.feature_tables import (
    create_feature_table,
    drop_feature_table,
    get_feature_table,
    read_feature_table,
)
from holdfast.sources.files import read_csv, read_csv_pandas
from holdfast.sources.models import load_model, save_model
from holdfast.sources.online import publish_table
from holdfast.sources.tables import ensure_database, preview, save_table, snapshot_table
from holdfast.streaming.scoring import score_arrivals, score_stream, write_stream
