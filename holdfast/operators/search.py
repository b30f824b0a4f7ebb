"""Searching several model families for the best classifier under a time budget."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.split import SEED
from holdfast.operators.training import Prepared, assemble, boosted_trees, evaluate, prepare, wired

# Fixed value: the time budget of a search, in minutes.
TIMEOUT_MINUTES = 5
# Trials that are fitted at a time.
AT_ONCE = 4
PARTS = {"test": 20, "validation": 20, "train": 60}
TRIALS_SCHEMA = "trial_id string, family string, params map<string,string>, status string, metric double"
FITTED, NOT_RUN = "fitted", "not run"


def _logistic(seed: int) -> tuple[Estimator, list]:
    model = wired(LogisticRegression(maxIter=100))
    return model, ParamGridBuilder().addGrid(model.regParam, [0.0, 0.1]).build()


def _tree(seed: int) -> tuple[Estimator, list]:
    model = wired(DecisionTreeClassifier(seed=seed))
    return model, ParamGridBuilder().addGrid(model.maxDepth, [3, 6]).build()


def _forest(seed: int) -> tuple[Estimator, list]:
    model = wired(RandomForestClassifier(seed=seed))
    return model, ParamGridBuilder().addGrid(model.numTrees, [100]).addGrid(model.maxDepth, [5]).build()


def _boosted(seed: int) -> tuple[Estimator, list]:
    model = boosted_trees(seed=seed)
    return model, ParamGridBuilder().addGrid(model.maxDepth, [3]).build()


FAMILIES: dict[str, Callable[[int], tuple[Estimator, list]]] = {
    "logistic_regression": _logistic,
    "decision_tree": _tree,
    "random_forest": _forest,
    "boosted_trees": _boosted,
}


@dataclass(frozen=True)
class Search:
    """All trials, their metrics, the best model, and the data they were fitted on."""

    trials: DataFrame
    metrics: DataFrame
    best_trial_id: str
    best_model: PipelineModel
    prepared: Prepared


def _candidates(families: Sequence[str], seed: int) -> Iterator[tuple[str, str, Estimator, Mapping]]:
    """Every family's first setting before any family's second, so a short budget still compares families."""
    grids = [(family, *FAMILIES[family](seed)) for family in families]
    for position in range(max(len(grid) for _, _, grid in grids)):
        for family, estimator, grid in grids:
            if position < len(grid):
                yield f"{family}_{position}", family, estimator, grid[position]


@dataclass(frozen=True)
class _Trial:
    """One candidate of a search, and what became of it."""

    trial_id: str
    family: str
    params: Mapping[str, str]
    status: str = NOT_RUN
    value: float | None = None
    metrics: tuple = ()
    model: Transformer | None = None

    @property
    def row(self) -> tuple:
        return (self.trial_id, self.family, dict(self.params), self.status, self.value)


def _run_trials(spark: SparkSession, candidates: Sequence[tuple[str, str, Estimator, Mapping]], fit: Callable[[str, Estimator], tuple[float | None, tuple, Transformer]], deadline: float | None, at_once: int) -> list[_Trial]:
    """Fit the candidates, ``at_once`` of them at a time, from driver threads that each submit their own jobs.

    Small fits leave most cores idle between their many short stages, which the other trials fill. The trials of a
    search share a job tag. When the deadline passes, trials that have not begun are left out, and if any has
    ended, the running ones are cancelled by their tag; else that is done after the first one.
    """
    context = spark.sparkContext
    if deadline is not None and time.monotonic() >= deadline:
        at_once = 1
    tag = f"holdfast-search-{uuid.uuid4().hex}"
    known = {trial_id: _Trial(trial_id, family, {p.name: str(v) for p, v in params.items()}) for trial_id, family, _, params in candidates}
    stop = threading.Event()

    def run(trial_id: str, estimator: Estimator, params: Mapping) -> _Trial:
        if stop.is_set():
            return known[trial_id]
        context.addJobTag(tag)
        try:
            value, metrics, model = fit(trial_id, estimator.copy(dict(params)))
        except Exception:
            if not stop.is_set():
                raise
            return known[trial_id]
        finally:
            context.removeJobTag(tag)
        if stop.is_set():
            return known[trial_id]
        return replace(known[trial_id], status=FITTED, value=value, metrics=metrics, model=model)

    ended: dict[str, _Trial] = {}
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        waiting = {pool.submit(inheritable_thread_target(spark)(run), trial_id, estimator, params) for trial_id, _, estimator, params in candidates}
        try:
            while waiting:
                over = deadline is not None and time.monotonic() >= deadline
                if over and any(trial.status == FITTED for trial in ended.values()):
                    # Again and again, as a trial may be between two of its jobs.
                    stop.set()
                    context.cancelJobsWithTag(tag)
                left = None if deadline is None else 0.1 if stop.is_set() else None if over else deadline - time.monotonic()
                done, waiting = wait(waiting, timeout=left, return_when=FIRST_COMPLETED)
                ended |= {trial.trial_id: trial for trial in (future.result() for future in done)}
        except BaseException:
            stop.set()
            context.cancelJobsWithTag(tag)
            raise
    return [ended[trial_id] for trial_id, *_ in candidates]


def auto_classify(
    df: DataFrame,
    target_col: str,
    key: str | Sequence[str],
    exclude_cols: str | Sequence[str] = (),
    timeout_minutes: float | None = TIMEOUT_MINUTES,
    families: Sequence[str] = tuple(FAMILIES),
    metric: str = "roc_auc",
    remainder: str = "passthrough",
    seed: int = SEED,
    at_once: int = AT_ONCE,
) -> Search:
    """Fit candidates until the budget is spent, at least one; the best is the one that leads on the validation part.

    The frame is split, encoded and stored once; each fit then reads the stored vectors. ``at_once`` candidates are fitted
    at a time, and None is no budget. Every candidate is a row of the trials; those that the budget left out or
    ended say so in ``status`` and have no metric. Boosted trees are skipped unless there are exactly two labels, and so is a
    metric other than accuracy.
    """
    started = time.monotonic()
    prepared = prepare(df, target_col, key, exclude_cols, PARTS, remainder, seed)
    binary = len(prepared.labels) == 2
    names = [f for f in families if binary or f != "boosted_trees"]
    measure = metric if binary else "accuracy"
    lower_is_better = measure == "log_loss"
    train = prepared.part("train")

    def fit(trial_id: str, estimator: Estimator) -> tuple[float | None, tuple, Transformer]:
        model = estimator.fit(train)
        values = evaluate(prepared, model, "validation", trial_id).collect()
        return next(row["value"] for row in values if row["metric"] == measure), tuple(values), model

    def rank(trial: _Trial) -> float:
        return float("-inf") if trial.value is None else (-trial.value if lower_is_better else trial.value)

    spark = df.sparkSession
    deadline = None if timeout_minutes is None else started + timeout_minutes * 60
    trials = _run_trials(spark, list(_candidates(names, seed)), fit, deadline, at_once)
    fitted = [trial for trial in trials if trial.status == FITTED]
    best = min(fitted, key=lambda trial: (-rank(trial), trial.trial_id))
    held_out = evaluate(prepared, best.model, "test", best.trial_id)
    validation = spark.createDataFrame([row for trial in fitted for row in trial.metrics], held_out.schema)
    return Search(
        trials=spark.createDataFrame([trial.row for trial in trials], TRIALS_SCHEMA),
        metrics=validation.unionByName(held_out),
        best_trial_id=best.trial_id,
        best_model=assemble(prepared, best.model),
        prepared=prepared,
    )


def best_trial(trials: DataFrame, metric: str = "metric", larger_is_better: bool = True) -> DataFrame:
    """The one leading trial; ties go to the first trial id, trials without a value never win."""
    order = F.desc(metric) if larger_is_better else F.asc(metric)
    return trials.where(F.col(metric).isNotNull()).orderBy(order, F.asc("trial_id")).limit(1)
