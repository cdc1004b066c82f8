"""Cross-validated search over the catalog, ranking, refit and feature importance."""

from __future__ import annotations

import json
import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import col_of
from ..functions.lineage import cut_lineage
from ..operators.metrics import classification_metrics, regression_metrics
from . import boost, gram
from .catalog import ModelSpec, TrainingFacts, first_rounds, gbt_regressor
from .neighbors import knn_classify, labelled_neighbors, vote

# Rows a task of a fit reads, on average.
TASK_ROWS = 25_000

RUN_SCHEMA = "model string, params string, cv_mean double, cv_std double, status string"
RANK_SCHEMA = "rank int, model string, best_params string, cv_mean double, cv_std double, n_combos int, seconds double, status string"


@dataclass
class KnnModel:
    """Nearest-neighbour classification has no parameters to fit: it keeps its training rows."""

    train: DataFrame
    key: str
    n_neighbors: int = 5
    weights: str = "uniform"

    def transform(self, df: DataFrame) -> DataFrame:
        base = self.train.select(self.key, "features", "label")
        found = knn_classify(df.drop("label"), base, self.key, "features", "label", self.n_neighbors, self.weights)
        return df.join(found.withColumnRenamed("key", self.key), self.key, "left")


@dataclass
class TrainedModel:
    name: str
    best_params: dict
    cv_mean: float | None
    cv_std: float | None
    runs: list[tuple] = field(default_factory=list)
    seconds: float = 0.0
    status: str = "ok"
    model: object = None


def _evaluator(task: str):
    if task == "regression":
        return RegressionEvaluator(metricName="r2")
    return MulticlassClassificationEvaluator(metricName="accuracy")


def _fit(spec: ModelSpec, point: dict, train: DataFrame, facts: TrainingFacts, key: str):
    if spec.make is None:
        return KnnModel(train, key, **point)
    return spec.make(facts, **point).fit(train)


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key over as many partitions as there are ``TASK_ROWS``: a scan of few files would leave the fits few, ever larger tasks.

    Tree learners sample by partition, so the layout depends on the rows alone.
    """
    return df.repartition(max(1, math.ceil(df.count() / TASK_ROWS)), F.xxhash64(col_of(key))).sortWithinPartitions(col_of(key))


def _groups(spec: ModelSpec, points: list[dict]) -> list[list[int]]:
    """Grid points that one fit of a fold answers: all of a nearest-neighbour model, and those of a boosted regressor that differ in their rounds only."""
    if spec.make is None:
        return [list(range(len(points)))] if points else []
    found: dict = {}
    for i, p in enumerate(points):
        rounds = p.get("n_estimators")
        shared = spec.make is gbt_regressor and isinstance(rounds, int) and rounds > 0
        found.setdefault(json.dumps({k: v for k, v in p.items() if k != "n_estimators"}) if shared else i, []).append(i)
    return list(found.values())


def _boost_scores(spec: ModelSpec, points: list[dict], train: DataFrame, test: DataFrame, facts: TrainingFacts, key: str, judge) -> list[float]:
    """Scores of points that differ in their rounds, from the longest boost: its first rounds are the shorter ones."""
    longest = _fit(spec, max(points, key=lambda p: p["n_estimators"]), train, facts, key)
    return [float(judge.evaluate(first_rounds(longest, p["n_estimators"]).transform(test))) for p in points]


def _vote_scores(points: list[dict], train: DataFrame, test: DataFrame, key: str, judge) -> list[float]:
    """Scores of all points on one fold, from one search for the most neighbours any of them asks."""
    models = [KnnModel(train, key, **p) for p in points]
    most = max(m.n_neighbors for m in models)
    near = cut_lineage(labelled_neighbors(test.drop("label"), train.select(key, "features", "label"), key, "features", "label", most))
    votes = [vote(near, m.n_neighbors, m.weights).withColumnRenamed("key", key) for m in models]
    return [float(judge.evaluate(test.join(found, key, "left"))) for found in votes]


def _facts(data: DataFrame, folds: int, weighted: bool, seed: int) -> tuple[dict[int, TrainingFacts], TrainingFacts]:
    """Facts of "all but fold f", and of all rows, from one aggregate per fold.

    The class count belongs to the whole table: a fold may miss the last class.
    """
    sums = gram.label_sums(data, F.col("weight") if weighted else F.lit(1.0))
    total = sum(s[:3] for s in sums.values()) if sums else np.zeros(3)
    classes = int(max((s[3] for s in sums.values()), default=-1)) + 1

    def facts(n: float, first: float, second: float) -> TrainingFacts:
        spread = max(second / n - (first / n) ** 2, 0.0) if n > 0 else 0.0
        return TrainingFacts(float(n), float(spread**0.5), classes, weighted, seed)

    return {f: facts(*(total - sums[f][:3] if f in sums else total)) for f in range(folds)}, facts(*total)


def cross_validate(
    df: DataFrame, models: list[ModelSpec], task: str, key: str, folds: int = 5, weight: str | None = None,
    parallelism: int = 4, seed: int = 42,
) -> list[TrainedModel]:
    """Mean and population deviation of the fold scores per grid point, then a refit of the best.

    ``df`` holds ``features``, ``label``, ``fold`` and optionally the weight. Linear models are solved
    for all points from the folds' sums of products, boosted regressors from their sums by bins, nearest neighbours vote for all points from one search
    a fold. Without such sums a boosted regressor is fitted for the most rounds and judged after fewer. Of the others every (fold, point) fit is an independent Spark job; up to ``parallelism`` of them run at once. A failing point is recorded in
    its status and leaves the ranking, it is not hidden.
    """
    judge, out = _evaluator(task), []
    data = df.withColumnRenamed(weight, "weight") if weight and weight != "weight" else df
    data = _spread(data, key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts = {f: (data.where(F.col("fold") != f), data.where(F.col("fold") == f)) for f in range(folds)}
        facts, overall = _facts(data, folds, weight is not None, seed)
        sums = gram.fold_sums(data, "weight" if weight else None) if any(gram.solvable(m, task) for m in models) else None
        for spec in models:
            start, points = time.time(), spec.points()

            def score(job, spec=spec, points=points):
                group, f = job
                here = [points[i] for i in group]
                if spec.make is None:
                    return _vote_scores(here, *parts[f], key, judge)
                if len(group) > 1:
                    return _boost_scores(spec, here, *parts[f], facts[f], key, judge)
                return [float(judge.evaluate(_fit(spec, here[0], parts[f][0], facts[f], key).transform(parts[f][1])))]

            solved = gram.fold_scores(sums, points, folds) if sums and gram.solvable(spec, task) else None
            if boost.solvable(spec, task):
                solved = boost.fold_scores(data, points, folds, "weight" if weight else None)
            scores, errors = dict(solved or {}), {}
            jobs = [(group, f) for group in _groups(spec, points) if scores.keys().isdisjoint(group) for f in range(folds)]
            with ThreadPoolExecutor(parallelism) as pool:
                started = [(job, pool.submit(inheritable_thread_target(df.sparkSession)(score), job)) for job in jobs]
                for (group, f), task_result in started:
                    try:
                        for at, value in zip(group, task_result.result()):
                            scores.setdefault(at, []).append(value)
                    except Exception as e:  # noqa: BLE001 - recorded in the run's status
                        errors |= {at: f"{type(e).__name__}: {str(e).splitlines()[0][:200]}" for at in group}
            runs = []
            for i, p in enumerate(points):
                if i in errors:
                    runs.append((spec.name, json.dumps(p), None, None, "failed: " + errors[i]))
                else:
                    runs.append((spec.name, json.dumps(p), float(np.mean(scores[i])), float(np.std(scores[i])), "ok"))
            good = [i for i, r in enumerate(runs) if r[4] == "ok"]
            if not good:
                out.append(TrainedModel(spec.name, {}, None, None, runs, time.time() - start, runs[0][4]))
                continue
            best = max(good, key=lambda i: (runs[i][2], -i))
            model = _fit(spec, points[best], data if spec.make else df, overall, key)
            out.append(TrainedModel(spec.name, points[best], runs[best][2], runs[best][3], runs, time.time() - start, "ok", model))
    finally:
        data.unpersist()
    return out


def cv_runs(spark, trained: list[TrainedModel]) -> DataFrame:
    return spark.createDataFrame([r for t in trained for r in t.runs], RUN_SCHEMA)


def ranked(trained: list[TrainedModel]) -> list[TrainedModel]:
    """Best mean score first; models without a score come last."""
    return sorted(trained, key=lambda t: (t.cv_mean is None, -(t.cv_mean or 0.0)))


def rank(spark, trained: list[TrainedModel]) -> DataFrame:
    rows = [
        (i + 1, t.name, json.dumps(t.best_params), t.cv_mean, t.cv_std, len(t.runs), round(t.seconds, 2), t.status)
        for i, t in enumerate(ranked(trained))
    ]
    return spark.createDataFrame(rows, RANK_SCHEMA).orderBy("rank")


def test_scores(model, df: DataFrame, task: str) -> dict:
    predicted = model.transform(df)
    table = regression_metrics if task == "regression" else classification_metrics
    return table(predicted, "label", "prediction").first().asDict()


def _importances(model) -> np.ndarray | None:
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        matrix = model.coefficientMatrix.toArray()
        return matrix[0] if len(matrix) == 1 else matrix.mean(axis=0)
    if hasattr(model, "coefficients"):
        return model.coefficients.toArray()
    if hasattr(model, "models"):
        return np.mean([_importances(m) for m in model.models], axis=0)
    return None


def feature_importance(spark, model, names: list[str]) -> DataFrame:
    """``(feature, importance)``, largest first; empty for models without one."""
    values = _importances(model)
    rows = [] if values is None else [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
