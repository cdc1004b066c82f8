"""Supervised estimators on ``pyspark.ml`` with their search grids.

Grids use the familiar names (``C``, ``alpha``, ``n_estimators``, …); each entry translates one
grid point into estimator parameters that minimise the same objective.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark import SparkContext
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# "No limit" on tree depth: the library rejects more than 30, and deep levels cost memory.
DEEPEST = 30

# Search grids.
FOREST_GRID = {"n_estimators": [50, 100, 200], "max_depth": [5, 10, None]}
BOOST_GRID = {"n_estimators": [50, 100], "learning_rate": [0.01, 0.1], "max_depth": [3, 5]}
GRIDS = {
    "LogisticRegression": {"C": [0.1, 1.0, 10.0]},
    "RandomForestClassifier": FOREST_GRID,
    "GradientBoostingClassifier": BOOST_GRID,
    "SVC": {"C": [0.1, 1.0]},
    "KNeighborsClassifier": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]},
    "LinearRegression": {},
    "Ridge": {"alpha": [0.1, 1.0, 10.0]},
    "RandomForestRegressor": FOREST_GRID,
    "GradientBoostingRegressor": BOOST_GRID,
    "robust_linear": {"C": [0.1, 1.0]},
}


@dataclass(frozen=True)
class TrainingFacts:
    """Totals of the training table the regularisation depends on."""

    n: float
    label_std: float
    classes: int
    weighted: bool = False
    seed: int = 42

    @classmethod
    def of(cls, df: DataFrame, label: str = "label", weight: str | None = None, seed: int = 42) -> TrainingFacts:
        w = F.col(weight) if weight else F.lit(1.0)
        y = F.col(label)
        row = df.agg(F.sum(w).alias("n"), F.sum(w * y).alias("s"), F.max(y).alias("top")).first()
        mean = row["s"] / row["n"]
        spread = df.agg(F.sum(w * (y - F.lit(mean)) * (y - F.lit(mean)))).first()[0]
        return cls(float(row["n"]), float((spread / row["n"]) ** 0.5), int(row["top"]) + 1, weight is not None, seed)


def _weighted(estimator, facts: TrainingFacts):
    return estimator.setWeightCol("weight") if facts.weighted else estimator


def logistic(facts: TrainingFacts, C: float = 1.0):
    """The mean loss of the library against a summed loss: the penalty is 1 / (C n)."""
    return _weighted(LogisticRegression(
        regParam=1.0 / (C * facts.n), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-5), facts)


def rf_classifier(facts: TrainingFacts, n_estimators: int = 100, max_depth: int | None = None):
    return _weighted(RandomForestClassifier(
        numTrees=n_estimators, maxDepth=DEEPEST if max_depth is None else max_depth, seed=facts.seed,
        cacheNodeIds=True), facts)


def gbt_classifier(facts: TrainingFacts, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3):
    boost = GBTClassifier(maxIter=n_estimators, stepSize=learning_rate, maxDepth=max_depth, seed=facts.seed)
    return _weighted(boost if facts.classes <= 2 else OneVsRest(classifier=boost), facts)


def linear_svc(facts: TrainingFacts, C: float = 1.0):
    svc = LinearSVC(regParam=1.0 / (C * facts.n), standardization=False, maxIter=50, tol=1e-3)
    return _weighted(svc if facts.classes <= 2 else OneVsRest(classifier=svc), facts)


def linear_regression(facts: TrainingFacts):
    return _weighted(LinearRegression(regParam=0.0, solver="normal"), facts)


def ridge(facts: TrainingFacts, alpha: float = 1.0):
    """The solver scales the label by its standard deviation, so the penalty is alpha σ / n."""
    return _weighted(LinearRegression(
        regParam=alpha * facts.label_std / facts.n, elasticNetParam=0.0, standardization=False, solver="normal"), facts)


def rf_regressor(facts: TrainingFacts, n_estimators: int = 100, max_depth: int | None = None):
    return _weighted(RandomForestRegressor(
        numTrees=n_estimators, maxDepth=DEEPEST if max_depth is None else max_depth, seed=facts.seed,
        cacheNodeIds=True), facts)


def gbt_regressor(facts: TrainingFacts, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3):
    return _weighted(GBTRegressor(maxIter=n_estimators, stepSize=learning_rate, maxDepth=max_depth, seed=facts.seed), facts)


def first_rounds(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The boosted regressor as it stood after ``n`` rounds: a round knows those before it only, so this is the fit of ``n`` rounds."""
    if n >= model.getNumTrees:
        return model
    java = model._java_obj
    make = SparkContext._active_spark_context._jvm.org.apache.spark.ml.regression.GBTRegressionModel
    return model._copyValues(GBTRegressionModel(make(java.uid(), java.trees()[:n], java.treeWeights()[:n], model.numFeatures)))


def robust_linear(facts: TrainingFacts, C: float = 1.0):
    """Linear model with the Huber loss, the scalable stand-in for a linear support-vector regressor."""
    return _weighted(LinearRegression(loss="huber", regParam=1.0 / (C * facts.n), elasticNetParam=0.0, maxIter=200), facts)


@dataclass(frozen=True)
class ModelSpec:
    name: str
    make: Callable | None
    grid: dict

    def points(self) -> list[dict]:
        return [dict(zip(self.grid, values)) for values in product(*self.grid.values())]


CLASSIFIERS = {
    "LogisticRegression": logistic,
    "RandomForestClassifier": rf_classifier,
    "GradientBoostingClassifier": gbt_classifier,
    "SVC": linear_svc,
    "KNeighborsClassifier": None,
}
REGRESSORS = {
    "LinearRegression": linear_regression,
    "Ridge": ridge,
    "RandomForestRegressor": rf_regressor,
    "GradientBoostingRegressor": gbt_regressor,
    "robust_linear": robust_linear,
}


def specs(task: str, names: list[str] | None = None, grids: dict | None = None) -> list[ModelSpec]:
    """The named models of a task, by default the first four of its catalog."""
    catalog = {"classification": CLASSIFIERS, "regression": REGRESSORS}.get(task)
    if catalog is None:
        raise ValueError(f"no supervised models for task {task!r}")
    names = list(catalog)[:4] if names is None else names
    return [ModelSpec(n, catalog[n], (grids or {}).get(n, GRIDS[n])) for n in names]
