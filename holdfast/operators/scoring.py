"""Scoring frames that hold nothing but keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from holdfast.operators.lookup import HOT_ROWS, lookup_features
from holdfast.operators.training import PREDICTION, predict
from holdfast.sources.models import SavedModel, load_model


def score_batch(
    model: str | SavedModel,
    keys: DataFrame,
    result_type: str = "string",
    hot_rows: int | None = HOT_ROWS,
    prefilter: bool = False,
    known_hot: Mapping[tuple[str, ...], Sequence[int]] | None = None,
) -> DataFrame:
    """Look up the model's features by key and append ``prediction``; every input row and column is kept.

    ``prefilter`` spares the shuffle of a large feature table when only few of its keys are scored.
    ``known_hot`` are hashes of hot keys by lookup key, in place of a search for them.
    """
    saved = load_model(keys.sparkSession, model) if isinstance(model, str) else model
    looked_up = lookup_features(keys, saved.lookups, hot_rows=hot_rows, prefilter=prefilter, known_hot=known_hot)
    scored = predict(saved.model, looked_up)
    return scored.withColumn(PREDICTION, scored[PREDICTION].cast(result_type))
