"""Scoring keys that arrive as a stream: a stateless join with stored features, then the model.

``score_stream`` is one endless query over the feature tables as they were when it began. ``score_arrivals`` is for tables
that are refreshed meanwhile and for skewed keys: each run scores what has arrived since the last one, with the tables'
versions pinned and the hot keys known from earlier runs, both written beside the query's own checkpoint first.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdfast.operators.lookup import HOT_ITEMS, HOT_KEYS, HOT_ROWS, FeatureLookup, key_counts, lookup_key_columns
from holdfast.operators.scoring import score_batch
from holdfast.sources.feature_tables import feature_table_version, table_at
from holdfast.sources.models import SavedModel, load_model

# What a run leaves of the weight that a key had in the runs before.
DECAY = 0.5


def score_stream(model: str | SavedModel, keys: DataFrame, result_type: str = "string") -> DataFrame:
    """The streaming form of ``score_batch``; it keeps no state, so late and repeated keys are scored as they come."""
    if not keys.isStreaming:
        raise ValueError("score_stream takes a streaming frame, score_batch a static one")
    return score_batch(model, keys, result_type, hot_rows=None)


def write_stream(
    scored: DataFrame, path: str, checkpoint: str, available_now: bool = False, interval: str = "1 minute"
) -> StreamingQuery:
    """Append to a parquet folder; its commit log with the checkpoint makes each row arrive once."""
    writer = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start(path)


@dataclass(frozen=True)
class Run:
    """What one run of ``score_arrivals`` goes by: the version of each feature table, and per lookup key the weight of hashes."""

    number: int
    versions: Mapping[str, int]
    weights: Mapping[tuple[str, ...], Mapping[int, float]]

    def hot(self, rows: float) -> dict[tuple[str, ...], list[int]]:
        """The hashes of weight ``rows`` or more, the ``HOT_KEYS`` heaviest of them."""
        heavy = {keys: [h for h, w in weights.items() if w >= rows] for keys, weights in self.weights.items()}
        return {keys: sorted(found, key=lambda h: -self.weights[keys][h])[:HOT_KEYS] for keys, found in heavy.items()}

    def pinned(self, spark: SparkSession, lookups: Sequence[FeatureLookup]) -> tuple[FeatureLookup, ...]:
        return tuple(replace(lookup, table=table_at(spark, lookup.table, self.versions[lookup.table])) for lookup in lookups)

    def text(self) -> str:
        weights = [[list(keys), [[h, w] for h, w in found.items()]] for keys, found in self.weights.items()]
        return json.dumps({"versions": dict(self.versions), "weights": weights})

    @staticmethod
    def of(number: int, text: str) -> Run:
        said = json.loads(text)
        return Run(number, said["versions"], {tuple(keys): {h: w for h, w in found} for keys, found in said["weights"]})


class RunLog:
    """The runs of one checkpoint: a small file for each that was begun, and an empty one for each that was finished."""

    def __init__(self, spark: SparkSession, checkpoint: str) -> None:
        self.spark, self.root = spark, f"{checkpoint.rstrip('/')}/lookups"
        self.files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self) -> list[str]:
        root = self._path(self.root)
        return [f.getPath().getName() for f in self.files.listStatus(root)] if self.files.exists(root) else []

    def _write(self, name: str, text: str) -> None:
        """A file is there as a whole or not at all."""
        draft = self._path(f"{self.root}/.{name}.draft")
        out = self.files.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.files.rename(draft, self._path(f"{self.root}/{name}")):
            raise OSError(f"{self.root}/{name} exists: another run of this checkpoint is at work")

    def last(self) -> tuple[Run | None, bool]:
        """The last run that was begun, and whether it was finished."""
        names = self._names()
        begun = [int(name.removeprefix("run-")) for name in names if name.startswith("run-")]
        if not begun:
            return None, True
        number = max(begun)
        text = self.spark.read.text(f"{self.root}/run-{number}", wholetext=True).first()["value"]
        return Run.of(number, text), f"done-{number}" in names

    def begin(self, run: Run) -> None:
        self._write(f"run-{run.number}", run.text())

    def finish(self, run: Run) -> None:
        """Only the last run is needed to begin the next one, so those before it are deleted."""
        self._write(f"done-{run.number}", "")
        for name in self._names():
            if name.startswith(("run-", "done-")) and int(name.partition("-")[2]) < run.number:
                self.files.delete(self._path(f"{self.root}/{name}"), False)


def _next_run(spark: SparkSession, saved: SavedModel, last: Run | None, written: DataFrame | None, decay: float) -> Run:
    versions = {lookup.table: feature_table_version(spark, lookup.table) for lookup in saved.lookups}
    weights: dict[tuple[str, ...], dict[int, float]] = {}
    for lookup in saved.lookups:
        keys = tuple(lookup.keys)
        if keys in weights:
            continue
        found = {h: w * decay for h, w in (last.weights.get(keys, {}) if last else {}).items()}
        if written is not None:
            for h, n in key_counts(written, lookup_key_columns(written, lookup)).items():
                found[h] = found.get(h, 0.0) + n
        heaviest = sorted(found, key=lambda h: -found[h])[:HOT_ITEMS]
        weights[keys] = {h: found[h] for h in heaviest if found[h] >= 1}
    return Run(last.number + 1 if last else 0, versions, weights)


def score_arrivals(
    model: str | SavedModel,
    keys: DataFrame,
    path: str,
    checkpoint: str,
    result_type: str = "string",
    hot_rows: int = HOT_ROWS,
    decay: float = DECAY,
    run_column: str = "run",
) -> Run:
    """Score all keys that have arrived since the last run, append them to ``path`` in folders by run, and return the run.

    Every micro-batch of a run reads the same versions of the feature tables. A run that failed is taken up with the versions
    it began with, so rows scored before and after the failure agree; refresh tables with ``keep=1`` or more, else a pinned version may be
    gone, which is an error. Keys are weighed by their rows in earlier runs, each run counting ``decay`` times the one
    after it; those of weight ``hot_rows`` take the lookups' way for hot keys. NULL counts as a key, and unknown keys get
    NULL features. The weights decide only how rows are joined. One run at a time for a checkpoint.
    """
    if not keys.isStreaming:
        raise ValueError("score_arrivals takes a streaming frame, score_batch a static one")
    if run_column.lower() in (name.lower() for name in keys.columns):
        raise ValueError(f"the keys have a column {run_column} of their own; name another run_column")
    spark = keys.sparkSession
    saved = load_model(spark, model) if isinstance(model, str) else model
    log = RunLog(spark, checkpoint)
    run, finished = log.last()
    if run is None or finished:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        written = None
        if run is not None and target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            schema = keys.withColumn(run_column, F.lit(0)).schema
            written = spark.read.schema(schema).parquet(path).where(F.col(run_column) == run.number)
        run = _next_run(spark, saved, run, written, decay)
        log.begin(run)
    pinned = replace(saved, lookups=run.pinned(spark, saved.lookups))
    scored = score_batch(pinned, keys, result_type, known_hot=run.hot(hot_rows)).withColumn(run_column, F.lit(run.number))
    writer = scored.writeStream.format("parquet").outputMode("append").partitionBy(run_column)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    log.finish(run)
    return run
