"""Tasks without a target: clusters, components or outliers, searched over grids and judged by the task's metric."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..functions.lineage import cut_lineage
from ..functions.quantiles import exact_quantiles
from ..models.cluster import bisecting_kmeans, kmeans, pca
from ..models.dbscan import dbscan
from ..models.iforest import isolation_forest
from ..models.neighbors import lof
from ..models.train import TrainedModel, ranked
from ..operators.metrics import clustering_metrics

# Search grids.
GRIDS = {
    "KMeans": {"n_clusters": [3, 4, 5, 6, 7, 8]},
    "BisectingKMeans": {"n_clusters": [3, 4, 5, 6, 7, 8]},
    "DBSCAN": {"eps": [0.3, 0.5, 0.7, 1.0], "min_samples": [3, 5, 10]},
    "PCA": {"n_components": [0.85, 0.90, 0.95]},
    "IsolationForest": {"contamination": ["auto", 0.05, 0.1], "n_estimators": [100]},
    "LocalOutlierFactor": {"contamination": ["auto", 0.05, 0.1], "n_neighbors": [10, 20, 30]},
}
# A grouping that cannot be judged (one group, or none) ranks last.
NO_SCORE = -1.0


def _points(grid: dict) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _judged(table: DataFrame, key: str, features: list[str], found: DataFrame, group: str) -> float:
    """Silhouette of the groups; rows without one take no part."""
    score = clustering_metrics(table.join(found, key), features, group).first()["silhouette"]
    return NO_SCORE if score is None else float(score)


def _centroids(fit: Callable) -> Callable:
    def search(table, key, features, grid, seed):
        out, runs = fit(table, features, ks=grid["n_clusters"], seed=seed)
        return [({"n_clusters": k}, score, lambda: out.select(key, "cluster")) for k, score in runs]

    return search


def _dbscan(table, key, features, grid, seed):
    out = []
    for point in _points(grid):
        found = cut_lineage(dbscan(table, key, features, **point)).select(F.col("key").alias(key), "cluster")
        held = found.select(key, F.when(F.col("cluster") >= 0, F.col("cluster")).alias("cluster"))
        out.append((point, _judged(table, key, features, held, "cluster"), lambda found=found: found))
    return out


def _outliers(make: Callable, column: str, size: str) -> Callable:
    """One fit per size; its scores serve all shares of outliers."""

    def search(table, key, features, grid, seed):
        out, shares = [], [c for c in grid["contamination"] if c != "auto"]
        for n in grid[size]:
            scores = cut_lineage(make(table, key, features, n, seed).withColumnsRenamed({"key": key, column: "anomaly_score"}))
            limits = exact_quantiles(scores, ["anomaly_score"], [1 - float(c) for c in shares])["anomaly_score"] if shares else []
            limit = dict(zip(shares, limits))
            for c in grid["contamination"]:
                flag = F.col("is_outlier") if c == "auto" else F.col("anomaly_score") > F.lit(limit[c])
                found = scores.withColumn("is_outlier", flag)
                held = found.select(key, F.col("is_outlier").cast("int").alias("side"))
                out.append(({"contamination": c, size: n}, _judged(table, key, features, held, "side"), lambda found=found: found))
        return out

    return search


def _pca(table, key, features, grid, seed):
    """The shares explained are known from one decomposition, so only the best point is projected."""
    out, ratios = pca(table, features, max(grid["n_components"]))
    explained = np.cumsum(ratios)
    runs = []
    for share in grid["n_components"]:
        n = min(len(ratios), int(np.searchsorted(explained, share - 1e-12) + 1))
        axes = [vector_to_array("components")[i].alias(f"component_{i + 1}") for i in range(n)]
        runs.append(({"n_components": share}, float(explained[n - 1]), lambda axes=axes: out.select(key, *axes)))
    return runs


SEARCHES = {
    "KMeans": _centroids(kmeans),
    "BisectingKMeans": _centroids(bisecting_kmeans),
    "DBSCAN": _dbscan,
    "PCA": _pca,
    "IsolationForest": _outliers(
        lambda t, key, x, n, seed: isolation_forest(t, key, x, n, "auto", seed), "anomaly_score", "n_estimators"),
    "LocalOutlierFactor": _outliers(lambda t, key, x, n, seed: lof(t, key, x, n), "lof", "n_neighbors"),
}
# The first of each list run by default; density and neighbour methods, whose work can grow faster than the
# rows, run when named.
TASKS = {
    "clustering": (("KMeans", "BisectingKMeans"), ("DBSCAN",)),
    "dimensionality_reduction": (("PCA",), ()),
    "anomaly_detection": (("IsolationForest",), ("LocalOutlierFactor",)),
}


def search(
    table: DataFrame, key: str, features: list[str], task: str, models: list[str] | None = None, grids: dict | None = None,
    seed: int = 42,
) -> tuple[list[TrainedModel], DataFrame | None]:
    """Models of the task, best first, and the rows of the best: key and cluster, components, or score and flag.

    ``cv_mean`` is the silhouette of the groups, or the share of the variance explained. Ties go to the
    earlier grid point. A failing model keeps its message in ``status``.
    """
    if task not in TASKS:
        raise ValueError(f"no models without a target for task {task!r}")
    usual, others = TASKS[task]
    unknown = sorted(set(models or ()) - set(usual) - set(others))
    if unknown:
        raise ValueError(f"no models {unknown} for task {task!r}")
    table = table.select(key, *[col_of(f) for f in features if f != key])
    trained, rows = [], {}
    for name in usual if models is None else models:
        start = time.time()
        try:
            found = SEARCHES[name](table, key, features, {**GRIDS[name], **(grids or {}).get(name, {})}, seed)
        except Exception as e:  # noqa: BLE001 - recorded in the run's status
            status = f"failed: {type(e).__name__}: {str(e).splitlines()[0][:200]}"
            trained.append(TrainedModel(name, {}, None, None, [(name, "{}", None, None, status)], time.time() - start, status))
            continue
        params, score, rows[name] = max(found, key=lambda f: f[1])
        runs = [(name, json.dumps(p), s, 0.0, "ok") for p, s, _ in found]
        trained.append(TrainedModel(name, params, score, 0.0, runs, time.time() - start))
    trained = ranked(trained)
    best = trained[0].name
    return trained, rows[best]() if best in rows else None


def task_scores(table: DataFrame, key: str, features: list[str], task: str, trained: list[TrainedModel], found: DataFrame) -> dict:
    """The task's metrics of the best model."""
    if task == "dimensionality_reduction":
        return {"explained_variance_ratio": trained[0].cv_mean}
    if task == "anomaly_detection":
        return {"silhouette": trained[0].cv_mean}
    held = found.select(key, F.when(F.col("cluster") >= 0, F.col("cluster")).alias("cluster"))
    return clustering_metrics(table.join(held, key), features, "cluster").first().asDict()
