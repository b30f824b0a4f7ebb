import pytest
from pyspark.sql import functions as F

from holdfast.operators import training
from holdfast.operators.encode import TooManyCategories
from holdfast.operators.lookup import FeatureLookup, create_training_set
from holdfast.operators.scoring import score_batch
from holdfast.operators.search import auto_classify, best_trial
from holdfast.operators.split import hash_split
from holdfast.operators.training import FEATURES, encoder, fit_churn, predict, trees_by_patience
from holdfast.plans import jobs
from holdfast.plans.churn import CHURN_SPEC
from holdfast.session import discard, shared_path, shared_root
from holdfast.sources.feature_tables import create_feature_table
from holdfast.sources.models import load_model, save_model
from holdfast.streaming.scoring import score_stream, write_stream


@pytest.fixture(scope="module")
def planted(spark):
    """2,000 rows whose label follows from two features, 5 % of them flipped."""
    n = F.col("id")
    yes = (F.col("cat_a") == "x") & (F.col("num_a") > 0)
    flipped = F.pmod(F.xxhash64("id"), F.lit(100)) < 5
    return (
        spark.range(2000)
        .withColumn("cat_a", F.element_at(F.array(*map(F.lit, "xyxz")), (F.pmod(F.hash("id"), F.lit(4)) + 1).cast("int")))
        .withColumn("num_a", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2001)) - 1000) / 100)
        .withColumn("flag", n % 2 == 0)
        .withColumn("Churn", F.when(yes != flipped, "Yes").otherwise("No"))
        .withColumnRenamed("id", "customerID")
        .persist()
    )


def majority(df):
    total = df.count()
    return max(r["count"] for r in df.groupBy("Churn").count().collect()) / total


@pytest.fixture(scope="module")
def fit(planted):
    return fit_churn(planted, "Churn", "customerID", trees=20)


def metric(fit, name):
    return next(r["value"] for r in fit.metrics.collect() if r["metric"] == name)


def test_the_model_learns(planted, fit):
    assert metric(fit, "accuracy") > majority(planted) + 0.1
    assert metric(fit, "roc_auc") > 0.85 and metric(fit, "log_loss") < 0.5
    assert {r["split"] for r in fit.metrics.collect()} == {"test"}


def test_scoring_needs_no_label_and_takes_unseen_and_missing_values(spark, planted, fit):
    rows = spark.createDataFrame(
        [(1, "x", 5.0, True), (2, "new", None, None), (3, None, -5.0, False)],
        "customerID long, cat_a string, num_a double, flag boolean",
    )
    scored = predict(fit.model, rows)
    assert scored.columns == [*rows.columns, "prediction"] and scored.count() == 3
    assert scored.where("customerID = 1").first()["prediction"] == "Yes"


def test_remainder_drop_uses_only_string_columns(planted):
    dropped = encoder(planted, ["Churn", "customerID"], remainder="drop").fit(planted).transform(planted)
    passed = encoder(planted, ["Churn", "customerID"]).fit(planted).transform(planted)
    assert dropped.first()[FEATURES].size == 3 and passed.first()[FEATURES].size == 5
    with pytest.raises(ValueError):
        encoder(planted, planted.columns)


def test_the_key_and_excluded_columns_are_no_features(planted):
    fit = fit_churn(planted, "Churn", "customerID", exclude_cols="flag", trees=1)
    assert fit.prepared.features == ("cat_a", "num_a")


def test_empty_columns_and_missing_labels_are_left_out(planted):
    odd = planted.withColumn("empty", F.lit(None).cast("double")).withColumn("void", F.lit(None).cast("string"))
    odd = odd.withColumn("Churn", F.when(F.col("customerID") % 10 != 0, F.col("Churn")))
    fit = fit_churn(odd, "Churn", "customerID", trees=2)
    assert fit.prepared.frame.count() == 1800


def test_a_label_outside_the_training_part_is_not_lost(planted):
    rows = hash_split(planted, "customerID", {"test": 20, "validation": 20, "train": 60})
    rare = F.when((F.col("split") == "test") & (F.col("customerID") % 50 == 0), "Rare").otherwise(F.col("Churn"))
    odd = rows.withColumn("Churn", rare).drop("split")
    search = auto_classify(odd, "Churn", "customerID", families=("decision_tree",))
    assert search.prepared.labels == ("No", "Rare", "Yes") and search.prepared.frame.count() == 2000


def test_fit_wants_two_labels(planted):
    with pytest.raises(ValueError, match="two labels"):
        fit_churn(planted.withColumn("Churn", F.col("cat_a")), "Churn", "customerID")


def test_search_compares_families_and_picks_the_leader(planted):
    search = auto_classify(planted, "Churn", "customerID", families=("logistic_regression", "decision_tree"))
    trials = search.trials.collect()
    assert len(trials) == 4 and len({t["family"] for t in trials}) == 2
    assert best_trial(search.trials).first()["trial_id"] == search.best_trial_id
    assert search.best_trial_id.startswith("decision_tree")
    assert search.metrics.where("split = 'test'").count() == 3
    assert search.best_model.transform(planted).where("prediction = Churn").count() > 1700


def test_search_stops_at_its_budget_but_tries_once(planted):
    search = auto_classify(planted, "Churn", "customerID", timeout_minutes=0)
    trials = search.trials.collect()
    assert len(trials) == 6 and sorted(t["status"] for t in trials) == ["fitted"] + ["not run"] * 5
    assert all((t["metric"] is None) == (t["status"] == "not run") for t in trials)
    assert best_trial(search.trials).first()["status"] == "fitted"


def test_search_over_three_labels(planted):
    rows = planted.withColumn("Churn", F.col("cat_a")).withColumn("hint", F.col("cat_a"))
    search = auto_classify(rows, "Churn", "customerID", families=("decision_tree", "boosted_trees"))
    assert {t["family"] for t in search.trials.collect()} == {"decision_tree"}
    assert search.trials.agg(F.max("metric")).first()[0] == 1.0


@pytest.fixture
def stored(spark, database, planted):
    """Feature table, training set and saved model."""
    name = f"{database}.features"
    create_feature_table(name, "customerID", planted, "planted")
    labels = planted.select("customerID", "Churn")
    path = shared_path(spark, "model")
    jobs.train(labels, [FeatureLookup(name, "customerID")], "Churn", "customerID", path, f"{database}.metrics", trees=5)
    return name, path


def test_saved_model_scores_bare_keys(spark, database, planted, stored):
    name, path = stored
    saved = load_model(spark, path)
    assert saved.lookups[0].feature_names == ["cat_a", "num_a", "flag"]
    assert saved.signature.names == ["customerID", "cat_a", "num_a", "flag"] and saved.label == "Churn"
    assert spark.read.parquet(f"{path}/input_example").count() == 100
    keys = planted.select("customerID").union(spark.range(5000, 5003)).union(spark.range(1))
    scored = score_batch(path, keys)
    assert scored.columns == ["customerID", "cat_a", "num_a", "flag", "prediction"]
    assert scored.count() == 2004 and scored.where("prediction is null").count() == 0
    assert scored.join(planted.select("customerID", "Churn"), "customerID").where("Churn = prediction").count() > 1700
    assert spark.table(f"{database}.metrics").count() == 3


def test_release_deletes_the_stored_copies_and_nothing_else(spark, planted):
    fit = fit_churn(planted, "Churn", "customerID", trees=1)
    paths = [copy.path for copy in fit.prepared.stored]
    assert all(spark.read.parquet(path).count() == 2000 for path in paths)
    fit.prepared.release()
    for path in paths:
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(path)
    assert fit.model.transform(planted).count() == 2000 and fit.metrics.count() == 3
    for other in ("/tmp/other", shared_root(spark), f"{shared_root(spark)}/other"):
        with pytest.raises(ValueError):
            discard(spark, other)


def test_a_model_path_is_written_once(spark, planted, fit):
    path = shared_path(spark, "m")
    save_model(fit.model, path, planted, "Churn")
    with pytest.raises(Exception, match="exists"):
        save_model(fit.model, path, planted, "Churn")


def test_unnamed_tables_cannot_be_saved(spark, planted, fit):
    with pytest.raises(ValueError, match="named tables"):
        save_model(fit.model, shared_path(spark, "m"), planted, "Churn", [FeatureLookup(planted, "customerID")])


def test_stream_scores_equal_batch_scores(spark, planted, stored):
    _, path = stored
    inbox, out = shared_path(spark, "inbox"), shared_path(spark, "out")
    keys = planted.select("customerID")
    keys.repartition(5).write.parquet(inbox)
    stream = spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", 2).parquet(inbox)
    scored = score_stream(path, stream)
    place = shared_path(spark, "progress")
    write_stream(scored, out, place, available_now=True).awaitTermination()
    write_stream(score_stream(path, stream), out, place, available_now=True).awaitTermination()
    got, want = spark.read.parquet(out), score_batch(path, keys)
    assert got.count() == 2000 and got.exceptAll(want).isEmpty()
    with pytest.raises(ValueError):
        score_stream(path, keys)


def test_retrain_job(spark, database, planted):
    name, path = f"{database}.features", shared_path(spark, "retrained")
    create_feature_table(name, "customerID", planted.drop("Churn"))
    labels = planted.select("customerID", "Churn")
    done = jobs.retrain(
        spark, name, "Churn", path, f"{database}.metrics", families=("decision_tree",), labels=labels
    )
    assert done.search.trials.count() == 2
    assert score_batch(path, labels.select("customerID")).count() == 2000
    assert spark.table(f"{database}.metrics").where("split = 'validation'").count() == 6


def test_ingest_features_and_exploration(spark, database):
    path = shared_path(spark, "raw")
    rows = spark.range(200).select(
        F.col("id").alias("customer_id"),
        (F.col("id") % 2).alias("senior"),
        F.when(F.col("id") % 3 == 0, "One year").otherwise("Month-to-month").alias("contract"),
        F.when(F.col("id") % 5 == 0, "  ").otherwise(F.col("id").cast("string")).alias("total_charges"),
        F.when(F.col("id") % 4 == 0, "Yes").otherwise("No").alias("churn"),
    )
    rows.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    raw = jobs.ingest(spark, path, f"{database}.raw")
    assert dict(raw.dtypes)["total_charges"] == "string"
    name = f"{database}.typed"
    jobs.build_features(spark, f"{database}.raw", CHURN_SPEC, name, "customer_id", "typed", buckets=2)
    typed = spark.table(name)
    assert dict(typed.dtypes)["total_charges"] == "double" and typed.where("total_charges = 0").count() == 40
    report = jobs.explore(typed, "churn", "Yes")
    assert {k: v.count() for k, v in report.items()} == {
        "summary": 4, "profile": 5, "class_balance": 2, "correlations": 4,
    }


def test_excluding_the_label_is_refused(spark, planted):
    labels = planted.select("customerID", "Churn")
    with pytest.raises(ValueError):
        create_training_set(labels, [], "Churn", "Churn")


def test_patience_waits_for_a_later_gain():
    # The second loss gains little, later ones much: the first small gain is not the end.
    losses = [0.5, 0.49999, *(0.5 - 0.01 * i for i in range(1, 30)), *[0.3] * 20]
    assert trees_by_patience(losses) > 30
    assert trees_by_patience([0.5] * 40) == 11
    assert trees_by_patience([0.5 - 0.01 * i for i in range(40)]) == 40
    falling = [0.5 - 0.01 * i for i in range(15)]
    assert trees_by_patience([*falling, *[0.36] * 30], patience=10) == 15 + 10
    assert trees_by_patience([]) == 0


def test_fifty_thousand_categories_train(spark):
    df = spark.range(60_000).selectExpr(
        "id", "concat('c', id % 50000) AS city", "double(id % 10) AS x", "if(id % 10 > 4, 'Yes', 'No') AS churn"
    )
    fit = fit_churn(df, "churn", "id", trees=2)
    assert metric(fit, "accuracy") > 0.95
    assert fit.prepared.frame.first()[FEATURES].size > 30_000
    fit.prepared.release()
    with pytest.raises(TooManyCategories):
        fit_churn(df, "churn", "id", trees=1, max_categories=1000)


def test_the_first_trees_are_those_of_a_shorter_fit(planted):
    prepared = training.prepare(planted, "Churn", "customerID")
    train, test = prepared.part("train"), prepared.part("test")
    whole = training.boosted_trees(12).fit(train)
    cut, short = training.first_trees(whole, 5), training.boosted_trees(5).fit(train)
    assert (cut.getNumTrees, cut.treeWeights, cut.numFeatures, cut.uid) == (5, short.treeWeights, short.numFeatures, whole.uid)

    def scores(model):
        columns = ["customerID", training.RAW_PREDICTION, training.PROBABILITY]
        return [tuple(r) for r in model.transform(test).select(*columns).orderBy("customerID").collect()]

    assert scores(cut) == scores(short)
    with pytest.raises(ValueError, match="cannot be kept"):
        training.first_trees(whole, 13)
    prepared.release()


def test_trials_one_at_a_time_give_the_same(planted):
    row = lambda r: (r["trial_id"], r["status"], r["metric"])
    searches = [auto_classify(planted, "Churn", "customerID", families=["logistic_regression", "decision_tree"], timeout_minutes=None, at_once=n) for n in (1, 4)]
    found = [[row(r) for r in s.trials.collect()] for s in searches]
    assert found[0] == found[1]
    assert searches[0].best_trial_id == searches[1].best_trial_id
    for search in searches:
        search.prepared.release()
