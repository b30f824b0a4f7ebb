"""A saved model: the Spark ML pipeline, the lookups that feed it, its signature and an input example."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from holdfast.operators.lookup import FeatureLookup

# Fixed value: rows in the stored input example.
EXAMPLE_ROWS = 100


@dataclass(frozen=True)
class SavedModel:
    model: PipelineModel
    lookups: tuple[FeatureLookup, ...]
    signature: StructType
    label: str
    description: str


def save_model(
    model: PipelineModel,
    path: str,
    training: DataFrame,
    label: str,
    lookups: Sequence[FeatureLookup] = (),
    description: str = "",
) -> None:
    """Write everything scoring needs below ``path``; lookups must name stored tables, and are saved resolved.

    A path holds one model for good: a retrained model takes a new path, so no reader meets half of each.
    """
    spark = training.sparkSession
    resolved = []
    for lookup in lookups:
        if not isinstance(lookup.table, str):
            raise ValueError("only lookups into named tables can be saved with a model")
        resolved.append(
            {"table": lookup.table, "keys": lookup.keys, "features": lookup.features(spark, without=[label])}
        )
    inputs = training.drop(label)
    spec = {
        "label": label,
        "lookups": resolved,
        "signature": json.loads(inputs.schema.json()),
        "description": description,
    }
    model.write().save(f"{path}/model")
    inputs.limit(EXAMPLE_ROWS).write.parquet(f"{path}/input_example")
    # The spec goes last: a path with a spec is a complete model.
    spec_row = spark.createDataFrame([(json.dumps(spec),)], "value string")
    spec_row.coalesce(1).write.text(f"{path}/spec")


def load_model(spark: SparkSession, path: str) -> SavedModel:
    spec = json.loads(spark.read.text(f"{path}/spec").first()["value"])
    lookups = tuple(FeatureLookup(s["table"], s["keys"], s["features"]) for s in spec["lookups"])
    return SavedModel(
        PipelineModel.load(f"{path}/model"),
        lookups,
        StructType.fromJson(spec["signature"]),
        spec["label"],
        spec["description"],
    )
