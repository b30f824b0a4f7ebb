"""Fitting a classifier on a training set with Spark ML. Nothing is collected: split, encoding and fit run on executors."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import (
    Imputer,
    IndexToString,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.encode import check_categories, columns_by_type, distinct_counts
from holdfast.operators.metrics import METRICS_SCHEMA, model_metrics
from holdfast.operators.split import SEED, hash_split
from holdfast.session import Stored, materialise

FEATURES = "__features"
LABEL = "__label"
RAW_PREDICTION = "__prediction"
PREDICTION = "prediction"
PROBABILITY = "__probability"
RAW_SCORE = "__raw"

# The settings of the boosted trees.
TREES = 100
LEARNING_RATE = 0.1
DEPTH = 3
# A tenth of the training rows, which are 80 of 100.
VALIDATION_PERCENT = 8
PATIENCE = 10
STOP_TOLERANCE = 1e-4
TEST_PERCENT = 20
# Stored vectors that a task of a fit should have at least.
TASK_BYTES = 4 * 1024 * 1024


def _names(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def encoder(
    df: DataFrame,
    exclude: Sequence[str],
    remainder: str = "passthrough",
    counts: Mapping[str, int] | None = None,
    max_categories: int | None = None,
) -> Pipeline:
    """String columns one-hot, numbers and booleans as they are, in one vector.

    A category that was not seen in training, and NULL, encodes to zeros; a missing number or flag takes the median.
    ``remainder="drop"`` leaves everything but the string columns out. Columns may have any number of categories, each
    a place in a sparse vector; ``max_categories`` refuses columns with more.
    """
    if remainder not in ("passthrough", "drop"):
        raise ValueError("remainder is passthrough or drop")
    texts = columns_by_type(df, T.StringType, exclude=exclude)
    numbers = columns_by_type(df, T.NumericType, T.BooleanType, exclude=exclude) if remainder == "passthrough" else []
    if not texts and not numbers:
        raise ValueError("no column to train on")
    counts = counts or distinct_counts(df, [*texts, *numbers])
    check_categories({c: counts[c] for c in texts}, max_categories)
    # A column without a single value carries nothing and has no median.
    texts, numbers = [c for c in texts if counts[c]], [c for c in numbers if counts[c]]
    stages, vectors = [], []
    if numbers:
        casts = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `__num_{c}`" for c in numbers)
        as_doubles = [f"__num_{c}" for c in numbers]
        imputed = [f"__imp_{c}" for c in numbers]
        stages.append(SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"))
        stages.append(Imputer(strategy="median", inputCols=as_doubles, outputCols=imputed))
        vectors += imputed
    if texts:
        indexed, hot = [f"__idx_{c}" for c in texts], [f"__hot_{c}" for c in texts]
        stages.append(
            StringIndexer(inputCols=texts, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc")
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True))
        vectors += hot
    stages.append(VectorAssembler(inputCols=vectors, outputCol=FEATURES, handleInvalid="error"))
    return Pipeline(stages=stages)


@dataclass(frozen=True)
class Prepared:
    """A split training frame as it came and encoded, both stored so that every fit reads them and not their lineage."""

    stored: tuple[Stored, Stored]
    encoder: PipelineModel
    labels: tuple[str, ...]
    label: str
    features: tuple[str, ...]

    @property
    def rows(self) -> DataFrame:
        """The rows as they came."""
        return self.stored[0].frame.drop("split")

    @property
    def frame(self) -> DataFrame:
        """Key, label, split and feature vector per row."""
        return self.stored[1].frame

    def release(self) -> None:
        """Delete the stored copies, once models, metrics and examples are saved."""
        for copy in self.stored:
            copy.release()

    def part(self, *names: str) -> DataFrame:
        """The rows of some parts, in as few partitions as hold ``TASK_BYTES`` each: a fit runs hundreds of short stages."""
        rows = self.frame.where(F.col("split").isin(*names))
        stored = int(self.frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return rows.coalesce(max(math.ceil(stored / TASK_BYTES), 1))


def prepare(
    df: DataFrame,
    label: str,
    key: str | Sequence[str],
    exclude_cols: str | Sequence[str] = (),
    parts: dict[str, int] | None = None,
    remainder: str = "passthrough",
    seed: int = SEED,
    max_categories: int | None = None,
) -> Prepared:
    """Split by key hash, fit the encoder on the training part, and store vectors with labels.

    The key is never a feature. Rows without a label are of no use to a fit and are left out.
    """
    keys = _names(key)
    excluded = [label, "split", *keys, *_names(exclude_cols)]
    if "split" in df.columns:
        raise ValueError("the frame already has a column named split")
    shares = parts or {
        "test": TEST_PERCENT,
        "validation": VALIDATION_PERCENT,
        "train": 100 - TEST_PERCENT - VALIDATION_PERCENT,
    }
    kept = materialise(hash_split(df.where(F.col(label).isNotNull()), keys, shares, seed), "training-rows")
    rows = kept.frame
    train = rows.where(F.col("split") == "train")
    used = columns_by_type(df, T.StringType, T.NumericType, T.BooleanType, exclude=excluded)
    in_train = [F.when(F.col("split") == "train", F.col(c)).alias(c) for c in used]
    counts = distinct_counts(rows.select(*in_train), used)
    # Labels come from all parts, so a label that only the test part holds is scored and not lost.
    indexer = StringIndexer(inputCol=label, outputCol=LABEL, stringOrderType="alphabetAsc").fit(rows)
    encoded = encoder(train, excluded, remainder, counts, max_categories).fit(train)
    frame = indexer.transform(encoded.transform(rows)).select(*keys, label, "split", LABEL, FEATURES)
    vectors = materialise(frame, "training-vectors")
    return Prepared((kept, vectors), encoded, tuple(indexer.labels), label, tuple(used))


def assemble(prepared: Prepared, classifier: Transformer) -> PipelineModel:
    """Encoder, classifier and the way back to label strings as one model that needs no label column."""
    back = IndexToString(inputCol=RAW_PREDICTION, outputCol=PREDICTION, labels=list(prepared.labels))
    return PipelineModel(stages=[*prepared.encoder.stages, classifier, back])


def positive_probability(df: DataFrame) -> DataFrame:
    """The probability of the last label, alphabetically, as a plain column."""
    return df.withColumn("score", vector_to_array(F.col(PROBABILITY)).getItem(1))


def evaluate(prepared: Prepared, classifier: Transformer, part: str, run_id: str) -> DataFrame:
    """Accuracy, and for two labels log loss and ROC AUC, of one part as long metric rows."""
    back = IndexToString(inputCol=RAW_PREDICTION, outputCol=PREDICTION, labels=list(prepared.labels))
    predicted = back.transform(classifier.transform(prepared.part(part)))
    if len(prepared.labels) == 2:
        predicted = positive_probability(predicted)
        found = model_metrics(predicted, prepared.label, PREDICTION, "score", prepared.labels[1])
    else:
        found = model_metrics(predicted, prepared.label, PREDICTION, None, None)
    rows = [(run_id, part, name, value) for name, value in found.items()]
    return predicted.sparkSession.createDataFrame(rows, METRICS_SCHEMA)


@dataclass(frozen=True)
class Fit:
    """A fitted model with its hold-out metrics."""

    model: PipelineModel
    metrics: DataFrame
    prepared: Prepared


def wired(classifier: Estimator) -> Estimator:
    """The classifier with the column names the other stages use; they stay clear of the user's columns."""
    return (
        classifier.setFeaturesCol(FEATURES)
        .setLabelCol(LABEL)
        .setPredictionCol(RAW_PREDICTION)
        .setProbabilityCol(PROBABILITY)
        .setRawPredictionCol(RAW_SCORE)
    )


def boosted_trees(trees: int = TREES, rate: float = LEARNING_RATE, depth: int = DEPTH, seed: int = SEED) -> GBTClassifier:
    return wired(GBTClassifier(maxIter=trees, stepSize=rate, maxDepth=depth, seed=seed))


def trees_by_patience(losses: Sequence[float], patience: int = PATIENCE, tolerance: float = STOP_TOLERANCE) -> int:
    """How many trees are kept when training stops at the first one that improves on none of the last ``patience`` losses.

    ``losses`` holds the validation loss after each tree; an improvement is one by more than the tolerance.
    """
    recent = deque([math.inf] * patience, maxlen=patience)
    for number, loss in enumerate(losses, start=1):
        if not any(loss + tolerance < earlier for earlier in recent):
            return number
        recent.append(loss)
    return len(losses)


def first_trees(model: GBTClassificationModel, kept: int) -> GBTClassificationModel:
    """The model of the first trees of a boosted ensemble, as fitting only these would give; nothing is fitted.

    Trees follow from those before them and the seed, so the first ones of a long fit are those of a shorter one.
    """
    java = model._java_obj
    trees, weights = java.trees(), java.treeWeights()
    if not 1 <= kept <= len(trees):
        raise ValueError(f"the model has {len(trees)} trees, so {kept} cannot be kept")
    gateway = SparkContext._active_spark_context._gateway
    some = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, kept)
    shares = gateway.new_array(gateway.jvm.double, kept)
    for i in range(kept):
        some[i], shares[i] = trees[i], weights[i]
    made = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), some, shares, java.numFeatures(), java.numClasses())
    cut = GBTClassificationModel(java.copyValues(made, java.extractParamMap()))
    cut._resetUid(model.uid)
    cut._transfer_params_from_java()
    return cut


def fit_churn(
    df: DataFrame,
    label: str,
    key: str | Sequence[str],
    exclude_cols: str | Sequence[str] = (),
    remainder: str = "passthrough",
    trees: int = TREES,
    rate: float = LEARNING_RATE,
    depth: int = DEPTH,
    seed: int = SEED,
    run_id: str = "run",
    patience: int = PATIENCE,
    max_categories: int | None = None,
) -> Fit:
    """Boosted trees on 80 % of the keys, a tenth of them for early stopping, measured on the other 20 %.

    All ``trees`` are fitted once, the validation loss after each tells by ``trees_by_patience`` how many to keep, and the
    others are cut off.
    """
    prepared = prepare(df, label, key, exclude_cols, None, remainder, seed, max_categories)
    if len(prepared.labels) != 2:
        raise ValueError(f"boosted trees need two labels, found {prepared.labels}")
    train, validation = prepared.part("train"), prepared.part("validation")
    classifier = boosted_trees(trees, rate, depth, seed).fit(train)
    if not validation.isEmpty():
        kept = trees_by_patience(classifier.evaluateEachIteration(validation), patience)
        if kept < trees:
            classifier = first_trees(classifier, kept)
    metrics = evaluate(prepared, classifier, "test", run_id)
    return Fit(assemble(prepared, classifier), metrics, prepared)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The input columns plus ``prediction``."""
    return model.transform(df).select(*df.columns, PREDICTION)

