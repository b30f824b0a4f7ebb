"""The registered queries: one per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import clean_numeric, map_category, sanitise, strip_whitespace, to_boolean
from holdfast.operators import aggregate, baseline, drift, encode, explore, lookup, metrics, profile, split
from holdfast.operators.featurize import assign_where
from holdfast.operators.scoring import score_batch
from holdfast.operators.search import auto_classify, best_trial
from holdfast.operators.training import fit_churn, positive_probability, predict
from holdfast.plans.churn import (
    CONTRACT_MONTHS,
    KEY,
    LABEL,
    POSITIVE,
    churn_features,
    churn_frame,
    churn_lookups,
    customer_features,
    label_frame,
    order_features,
    rule_frame,
    rule_prediction,
    table,
)
from holdfast.plans.retraining import RunState, decide, decisions
from holdfast.session import shared_path
from holdfast.sources.feature_tables import (
    create_feature_table,
    drop_feature_table,
    feature_table_audit,
    get_feature_table,
    read_feature_table,
    refresh_feature_table,
)
from holdfast.sources.files import read_csv, read_csv_pandas
from holdfast.sources.models import load_model, save_model
from holdfast.sources.tables import ensure_database, preview, save_table, snapshot_table
from holdfast.streaming.scoring import score_arrivals, score_stream, write_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
DRIFT_FEATURES = ("senior", "contract", "segment", "nation", "monthly_charges", "total_charges")


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Scans, tables and previews


@query("select_all")
def select_all(spark, sf_dir):
    return aggregate.sql_over("SELECT * FROM {churn}", churn=churn_frame(spark, sf_dir))


@query("input_example")
def input_example(spark, sf_dir):
    return preview(customer_features(spark, sf_dir), KEY)


@query("read_csv")
def csv_scan(spark, sf_dir):
    """The churn frame written as CSV files and read back with its schema."""
    frame = churn_frame(spark, sf_dir)
    path = shared_path(spark, "csv")
    frame.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_csv(spark, path, frame.schema)


def _database(spark: SparkSession) -> str:
    location = shared_path(spark, "db")
    name = location.rsplit("/", 1)[1].replace("-", "_")
    ensure_database(spark, name, location)
    return name


@query("save_table")
def overwrite_table(spark, sf_dir):
    """A table overwritten by a frame that reads it."""
    name = f"{_database(spark)}.churn"
    save_table(churn_frame(spark, sf_dir), name)
    save_table(spark.table(name).withColumn("monthly_charges", F.col("monthly_charges") * 2), name)
    return spark.table(name)


@query("snapshot_table")
def snapshot(spark, sf_dir):
    """A copy that keeps what the source held before it was overwritten."""
    database = _database(spark)
    save_table(churn_frame(spark, sf_dir), f"{database}.churn")
    snapshot_table(spark, f"{database}.churn", f"{database}.churn_copy")
    save_table(label_frame(spark, sf_dir), f"{database}.churn")
    return spark.table(f"{database}.churn_copy")


@query("read_csv_inferred")
def csv_inference(spark, sf_dir):
    """The same files with inferred types: a blank among the amounts keeps that column a string."""
    frame = churn_frame(spark, sf_dir)
    path = shared_path(spark, "csv")
    frame.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_csv(spark, path)


@query("read_csv_pandas")
def csv_pandas(spark, sf_dir):
    """The same files through the pandas API on Spark."""
    frame = churn_frame(spark, sf_dir)
    path = shared_path(spark, "csv")
    frame.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_csv_pandas(path).to_spark()


@query("feature_table_refresh")
def feature_table_refresh(spark, sf_dir):
    """A feature table refreshed by a frame that reads it: new rows, the same keys and description."""
    name = f"{_database(spark)}.churn_features"
    created = create_feature_table(name, KEY, customer_features(spark, sf_dir), "churn features", buckets=8)
    doubled = read_feature_table(spark, name).withColumn("monthly_charges", F.col("monthly_charges") * 2)
    refreshed = refresh_feature_table(name, doubled)
    same = F.lit(refreshed.primary_keys == created.primary_keys and refreshed.description == created.description)
    return read_feature_table(spark, name).withColumn("same_metadata", same)


@query("feature_table_metadata")
def feature_table_metadata(spark, sf_dir):
    """Keys, features and description of a stored feature table, a row per column."""
    name = f"{_database(spark)}.customers"
    create_feature_table(name, KEY, customer_features(spark, sf_dir), "customers by name")
    found = get_feature_table(spark, name)
    rows = [(i, c, c in found.primary_keys, found.description) for i, c in enumerate(found.features)]
    described = spark.createDataFrame(rows, "place int, name string, is_key boolean, description string")
    return described.withColumn("table_rows", F.lit(read_feature_table(spark, name).count()).cast("long"))


@query("feature_table")
def feature_table(spark, sf_dir):
    """Features stored as a bucketed feature table and read back."""
    name = f"{_database(spark)}.churn_features"
    create_feature_table(name, KEY, customer_features(spark, sf_dir), "churn features", buckets=8)
    return read_feature_table(spark, name)


@query("feature_table_drop")
def feature_table_drop(spark, sf_dir):
    """Three tables, of which one feature table is dropped and a plain one refused: what the audit then finds."""
    database = _database(spark)
    features = customer_features(spark, sf_dir)
    create_feature_table(f"{database}.customers", KEY, features, "customers by name", buckets=4)
    create_feature_table(f"{database}.spent", KEY, features.select(KEY, "monthly_charges"), "to be dropped")
    create_feature_table(f"{database}.orders", KEY, order_features(spark, sf_dir), "orders by customer")
    save_table(label_frame(spark, sf_dir), f"{database}.labels")
    drop_feature_table(spark, f"{database}.spent")
    drop_feature_table(spark, f"{database}.spent")
    try:
        drop_feature_table(spark, f"{database}.labels")
        refused = False
    except ValueError:
        refused = True
    left = feature_table_audit(spark, database)
    tables = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
    return left.withColumns({"tables_left": F.lit(", ".join(tables)), "plain_table_refused": F.lit(refused)})


# Projections and scalar functions


@query("label_frame")
def label_columns(spark, sf_dir):
    return label_frame(spark, sf_dir)


@query("flag_to_boolean")
def flag_to_boolean(spark, sf_dir):
    return churn_frame(spark, sf_dir, [KEY, "senior"]).withColumn("senior", to_boolean("senior"))


@query("map_category")
def category_to_number(spark, sf_dir):
    frame = churn_frame(spark, sf_dir, [KEY, "contract"])
    return frame.withColumn("months", map_category("contract", CONTRACT_MONTHS))


@query("assign_where")
def masked_assignment(spark, sf_dir):
    frame = churn_frame(spark, sf_dir, [KEY, "contract", "monthly_charges"])
    return assign_where(frame, F.col("contract") == "Month-to-month", "monthly_charges", 0.0)


@query("clean_numeric")
def numeric_cleaning(spark, sf_dir):
    frame = churn_frame(spark, sf_dir, [KEY, "total_charges"])
    return frame.withColumn("amount", clean_numeric("total_charges"))


@query("strip_whitespace")
def whitespace_stripping(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strip_whitespace("text").alias("text"))


@query("sanitise_names")
def name_sanitising(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sanitise("url").alias("name"))


@query("featurize")
def featurized(spark, sf_dir):
    return churn_features(spark, sf_dir)


# Lookups


@query("feature_lookup")
def feature_lookup(spark, sf_dir):
    keys = churn_frame(spark, sf_dir, [KEY])
    return lookup.lookup_features(keys, churn_lookups(spark, sf_dir))


@query("scoring_input")
def scoring_input(spark, sf_dir):
    """Events hold many rows per user and users that are no customers; every event is kept."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )
    return lookup.lookup_features(events, [lookup.FeatureLookup(customers, "user_id")])


@query("training_set")
def training_set(spark, sf_dir):
    labels = label_frame(spark, sf_dir)
    return lookup.create_training_set(labels, churn_lookups(spark, sf_dir), LABEL, exclude_columns=KEY).load_df()


@query("leakage_scan")
def label_leakage(spark, sf_dir):
    return _rounded(lookup.leakage_scan(churn_features(spark, sf_dir), LABEL, POSITIVE), "correlation")


# Aggregates and profiles


@query("value_counts")
def value_counts(spark, sf_dir):
    return aggregate.value_counts(label_frame(spark, sf_dir), LABEL)


@query("group_count")
def group_count(spark, sf_dir):
    return aggregate.sql_over(
        "SELECT churn, senior, COUNT(*) AS customers FROM {churn_rows} GROUP BY senior, churn",
        churn_rows=churn_frame(spark, sf_dir, ["senior", LABEL]),
    )


@query("pivot_counts")
def pivoted_counts(spark, sf_dir):
    counts = aggregate.group_count(churn_frame(spark, sf_dir, ["senior", LABEL]), [LABEL, "senior"], "customers")
    wide = aggregate.pivot_counts(counts, LABEL, "senior", "customers", [0, 1])
    return wide.withColumnsRenamed({"0": "not_senior", "1": "senior"})


@query("class_balance")
def class_balance(spark, sf_dir):
    return _rounded(aggregate.class_balance(label_frame(spark, sf_dir), LABEL), "share")


@query("describe_numeric")
def describe_numeric(spark, sf_dir):
    columns = ["contract", "monthly_charges", "total_charges"]
    return _rounded(profile.describe_numeric(churn_features(spark, sf_dir), columns), *columns)


@query("summary_typed")
def summary_typed(spark, sf_dir):
    return _rounded(profile.summary_typed(churn_features(spark, sf_dir)), "mean", "stddev")


@query("describe_lineitem")
def describe_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return _rounded(profile.describe_numeric(rows), *profile.numeric_columns(rows))


@query("profile_columns")
def profile_columns(spark, sf_dir):
    return profile.profile_columns(churn_frame(spark, sf_dir))


@query("profile_lineitem")
def profile_lineitem(spark, sf_dir):
    return profile.profile_columns(table(spark, sf_dir, "lineitem"))


@query("histogram")
def histogram(spark, sf_dir):
    return _rounded(profile.histogram(churn_features(spark, sf_dir)), "lower", "upper")


@query("histogram_lineitem")
def histogram_lineitem(spark, sf_dir):
    return _rounded(profile.histogram(table(spark, sf_dir, "lineitem"), bins=20), "lower", "upper")


@query("correlation_matrix")
def correlation_matrix(spark, sf_dir):
    return _rounded(explore.correlation_matrix(table(spark, sf_dir, "lineitem")), "correlation")


@query("exploration_report")
def exploration_report(spark, sf_dir):
    return _rounded(explore.exploration_report(churn_features(spark, sf_dir), LABEL, POSITIVE), "number")


@query("cast_audit")
def cast_audit(spark, sf_dir):
    return profile.cast_audit(churn_frame(spark, sf_dir))


@query("primary_key_audit")
def primary_key_audit(spark, sf_dir):
    return profile.primary_key_audit(churn_frame(spark, sf_dir, [KEY]), KEY)


@query("primary_key_audit_lineitem")
def primary_key_audit_lineitem(spark, sf_dir):
    return profile.primary_key_audit(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_keys")
def duplicate_keys(spark, sf_dir):
    return profile.duplicate_keys(table(spark, sf_dir, "orders"), "o_custkey")


# Splits and encoding


@query("hash_split")
def hash_split(spark, sf_dir):
    return split.hash_split(churn_frame(spark, sf_dir, [KEY]), KEY)


@query("exact_split")
def exact_split(spark, sf_dir):
    return split.exact_split(churn_frame(spark, sf_dir, [KEY]), KEY)


@query("one_hot_wide")
def one_hot_wide(spark, sf_dir):
    frame = churn_frame(spark, sf_dir, [KEY, "segment", "contract"])
    known = encode.categories(frame, ["segment"]) | {"contract": list(CONTRACT_MONTHS)}
    return encode.one_hot_wide(frame, known, keep=[KEY])


# Metrics


@query("accuracy")
def accuracy(spark, sf_dir):
    return _rounded(metrics.accuracy(rule_frame(spark, sf_dir), LABEL, "prediction"), "accuracy")


@query("confusion_matrix")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(rule_frame(spark, sf_dir), LABEL, "prediction")


@query("precision_recall_f1")
def precision_recall_f1(spark, sf_dir):
    report = metrics.precision_recall_f1(rule_frame(spark, sf_dir), LABEL, "prediction")
    return _rounded(report, "precision", "recall", "f1")


@query("log_loss")
def log_loss(spark, sf_dir):
    return _rounded(metrics.log_loss(rule_frame(spark, sf_dir), LABEL, "probability", POSITIVE), "log_loss")


@query("roc_auc")
def roc_auc(spark, sf_dir):
    return _rounded(metrics.roc_auc(rule_frame(spark, sf_dir), LABEL, "monthly_charges", POSITIVE), "roc_auc")


@query("roc_curve")
def roc_curve(spark, sf_dir):
    return _rounded(metrics.roc_curve(rule_frame(spark, sf_dir), LABEL, "monthly_charges", POSITIVE), "fpr", "tpr")


@query("pr_curve")
def pr_curve(spark, sf_dir):
    curve = metrics.pr_curve(rule_frame(spark, sf_dir), LABEL, "monthly_charges", POSITIVE)
    return _rounded(curve, "precision", "recall")


@query("metrics_table")
def metrics_table(spark, sf_dir):
    """The rule's accuracy and log loss on both sides of the split, appended to a metrics table run by run."""
    name = f"{_database(spark)}.metrics"
    for rows in _rule_metrics(spark, sf_dir):
        metrics.append_metrics(rows, name)
    return _rounded(spark.table(name), "value")


def _rule_metrics(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = split.hash_split(rule_frame(spark, sf_dir), KEY)
    sides = {side: rows.where(F.col("split") == side) for side in ("train", "test")}
    found = []
    for side, frame in sides.items():
        right = metrics.accuracy(frame, LABEL, "prediction").select("accuracy")
        loss = metrics.log_loss(frame, LABEL, "probability", POSITIVE).select("log_loss")
        both = [metrics.metric_rows(rows, f"{side}_run", "all") for rows in (right, loss)]
        found.append(both[0].unionByName(both[1]))
    return found


@query("majority_baseline")
def majority_baseline(spark, sf_dir):
    rows = split.hash_split(churn_frame(spark, sf_dir, [KEY, "segment", LABEL]), KEY)
    return baseline.majority_baseline(rows, rows.where(F.col("split") == "train"), ["segment"], LABEL)


@query("best_trial")
def trial_choice(spark, sf_dir):
    """Trials are one-threshold rules on the monthly charges, their metric is accuracy; the best one is kept."""
    rows = churn_frame(spark, sf_dir, ["monthly_charges", LABEL])
    trials = []
    for percent in range(0, 101, 5):
        guess = F.when(F.col("monthly_charges") < percent * 100, "Yes").otherwise("No")
        share = F.round(F.avg((guess == F.col(LABEL)).cast("int")), 6)
        trials.append(F.struct(F.lit(f"below_{percent:03d}").alias("trial_id"), share.alias("metric")).alias(f"t{percent}"))
    wide = rows.agg(*trials)
    return best_trial(wide.select(F.inline(F.array(*wide.columns))))


# Drift and decay


@query("drift_psi")
def drift_psi(spark, sf_dir):
    frame = churn_features(spark, sf_dir)
    return _rounded(drift.drift_psi(frame, F.col(LABEL) == "No", DRIFT_FEATURES, 10), "psi")


@query("metric_decay")
def metric_decay(spark, sf_dir):
    train, test = _rule_metrics(spark, sf_dir)
    decay = drift.metric_decay(train.unionByName(test), "train_run", "test_run", tolerance=0.01)
    return _rounded(decay, "reference", "current", "loss")


@query("stored_profile_psi")
def stored_profile_psi(spark, sf_dir):
    """Drift of one part of the customers against the stored profile of two others, which were profiled apart."""
    frame = churn_features(spark, sf_dir)
    staying = frame.where(F.col(LABEL) == "No")
    whole = drift.distribution_profile(staying, DRIFT_FEATURES)
    parts = [staying.where(F.col("senior") == flag) for flag in (True, False)]
    halves = [drift.distribution_profile(part, DRIFT_FEATURES, like=whole) for part in parts]
    name = f"{_database(spark)}.profile"
    save_table(drift.merge_profiles(*halves), name)
    known = spark.table(name)
    current = drift.distribution_profile(frame.where(F.col(LABEL) != "No"), DRIFT_FEATURES, like=known)
    return _rounded(drift.profile_psi(known, current), "psi")


@query("retrain_decision")
def retrain_decision(spark, sf_dir):
    """Three runs over stored state: the first, one over other customers, and one over rows like those last trained on."""
    state = RunState(_database(spark))
    frame = churn_features(spark, sf_dir)
    train, test = _rule_metrics(spark, sf_dir)
    staying, leaving = frame.where(F.col(LABEL) == "No"), frame.where(F.col(LABEL) != "No")
    settings = {"psi_limit": 0.01, "tolerance": 0.0}
    decide(staying, DRIFT_FEATURES, state, "first", train, **settings)
    decide(leaving, DRIFT_FEATURES, state, "second", test, **settings)
    decide(leaving, DRIFT_FEATURES, state, "third", test, **settings)
    return _rounded(decisions(spark, state), "greatest_psi")


# Models and scoring


@query("gbt_predictions")
def gbt_predictions(spark, sf_dir):
    """Boosted trees fitted on the training keys, applied to every customer; what any such model must satisfy."""
    rows = churn_features(spark, sf_dir)
    fit = fit_churn(rows, LABEL, KEY)
    fit.prepared.release()
    scored = positive_probability(fit.model.transform(split.hash_split(rows, KEY)))
    likelier = F.when(F.col("score") > 0.5, POSITIVE).when(F.col("score") < 0.5, "No").otherwise(F.col("prediction"))
    return scored.select(
        KEY,
        "split",
        LABEL,
        F.col("score").between(0, 1).alias("score_in_range"),
        (F.col("prediction") == likelier).alias("prediction_agrees"),
    )


@query("auto_trials")
def auto_trials(spark, sf_dir):
    """Every candidate of the search, fitted without a budget, with its status."""
    search = auto_classify(churn_features(spark, sf_dir), LABEL, KEY, timeout_minutes=None)
    search.prepared.release()
    measured = F.col("metric").between(0, 1)
    return search.trials.select("trial_id", "family", "status", measured.alias("metric_in_range"))


@query("score_batch")
def batch_scores(spark, sf_dir):
    """A model saved with its lookups, loaded, and applied to bare keys."""
    name = f"{_database(spark)}.churn_features"
    create_feature_table(name, KEY, customer_features(spark, sf_dir), "churn features")
    lookups = [lookup.FeatureLookup(name, KEY)]
    training = lookup.create_training_set(label_frame(spark, sf_dir), lookups, LABEL).load_df()
    path = shared_path(spark, "model")
    fit = fit_churn(training, LABEL, KEY)
    save_model(fit.model, path, fit.prepared.rows, LABEL, lookups)
    fit.prepared.release()
    scored = score_batch(path, churn_frame(spark, sf_dir, [KEY]))
    direct = predict(fit.model, lookup.lookup_features(churn_frame(spark, sf_dir, [KEY]), lookups))
    both = scored.join(direct.select(KEY, F.col("prediction").alias("direct")), KEY)
    known = F.col("prediction").isin("No", POSITIVE)
    return both.select(KEY, known.alias("known_label"), (F.col("prediction") == F.col("direct")).alias("as_fitted"))


@query("score_rule")
def score_rule(spark, sf_dir):
    """Batch scoring with the fixed rule in the model's place."""
    keys = churn_frame(spark, sf_dir, [KEY])
    return rule_prediction(lookup.lookup_features(keys, churn_lookups(spark, sf_dir)))


@query("score_stream")
def stream_scores(spark, sf_dir):
    """Keys read as a stream, scored by a saved model over its stored features, and held against the batch scores."""
    name = f"{_database(spark)}.churn_features"
    create_feature_table(name, KEY, customer_features(spark, sf_dir), "churn features", buckets=8)
    lookups = [lookup.FeatureLookup(name, KEY)]
    training = lookup.create_training_set(label_frame(spark, sf_dir), lookups, LABEL).load_df()
    search = auto_classify(training, LABEL, KEY, timeout_minutes=None, families=("logistic_regression",))
    path = shared_path(spark, "model")
    save_model(search.best_model, path, search.prepared.rows, LABEL, lookups)
    search.prepared.release()
    schema = table(spark, sf_dir, "customer").schema
    # A glob matches the table whether it is one file or a folder of files.
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/customer.parquet*")
    keys = arriving.select("c_custkey", F.col("c_name").alias(KEY))
    out = shared_path(spark, "scores")
    write_stream(score_stream(path, keys), out, shared_path(spark, "stream"), available_now=True).awaitTermination()
    batch = score_batch(path, churn_frame(spark, sf_dir, [KEY])).select(KEY, F.col("prediction").alias("batch"))
    both = spark.read.parquet(out).join(batch, KEY)
    known = F.col("prediction").isin("No", POSITIVE)
    return both.select(KEY, "c_custkey", known.alias("known_label"), (F.col("prediction") == F.col("batch")).alias("as_batch"))


@query("score_arrivals")
def arrivals_scored(spark, sf_dir):
    """Two deliveries of keys, with the feature table refreshed between them; the first run's version is scored again in batch."""
    name = f"{_database(spark)}.churn_features"
    create_feature_table(name, KEY, customer_features(spark, sf_dir), "churn features")
    lookups = [lookup.FeatureLookup(name, KEY)]
    fit = fit_churn(lookup.create_training_set(label_frame(spark, sf_dir), lookups, LABEL).load_df(), LABEL, KEY, trees=1)
    path, inbox, out, checkpoint = (shared_path(spark, purpose) for purpose in ("model", "inbox", "scores", "stream"))
    save_model(fit.model, path, fit.prepared.rows, LABEL, lookups)
    fit.prepared.release()
    keys = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias(KEY))
    runs = []
    for delivery in range(2):
        keys.where(F.col("c_custkey") % 2 == delivery).write.mode("append").parquet(inbox)
        if delivery:
            refresh_feature_table(name, spark.table(name).withColumn("monthly_charges", F.col("monthly_charges") + 1), keep=1)
        arriving = spark.readStream.schema(keys.schema).parquet(inbox)
        runs.append(score_arrivals(path, arriving, out, checkpoint))
    saved = load_model(spark, path)
    batch = None
    for run in runs:
        pinned = replace(saved, lookups=run.pinned(spark, saved.lookups))
        scored = score_batch(pinned, keys).select("c_custkey", F.lit(run.number).alias("run"), F.col("prediction").alias("batch"))
        batch = scored if batch is None else batch.union(scored)
    both = spark.read.parquet(out).join(batch, ["c_custkey", "run"])
    return both.select(KEY, "c_custkey", "run", "monthly_charges", (F.col("prediction") == F.col("batch")).alias("as_batch"))
