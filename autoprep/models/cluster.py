"""Centroid clustering and principal components on ``pyspark.ml``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators.vectors import as_array


def with_vector(df: DataFrame, features, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(as_array(df, features)))


def _best_k(df: DataFrame, features, make, ks) -> tuple[DataFrame, list[tuple]]:
    data = with_vector(df, features, "__features").persist(StorageLevel.MEMORY_AND_DISK)
    judge = ClusteringEvaluator(featuresCol="__features", predictionCol="cluster")
    try:
        runs, best = [], None
        for k in ks:
            model = make(k).setFeaturesCol("__features").setPredictionCol("cluster").fit(data)
            found = model.transform(data)
            score = float(judge.evaluate(found)) if found.select("cluster").distinct().limit(2).count() > 1 else -1.0
            runs.append((k, score))
            if best is None or score > best[0]:
                best = (score, model)
    finally:
        data.unpersist()
    out = best[1].transform(with_vector(df, features, "__features")).drop("__features")
    return out, runs


def kmeans(df: DataFrame, features, ks=range(3, 9), seed: int = 42, n_init: int = 10) -> tuple[DataFrame, list[tuple]]:
    """``(table with cluster, [(k, silhouette)])`` for the k with the best silhouette.

    The parallel k-means|| start replaces ``n_init`` restarts by ``n_init`` seeding rounds.
    """
    return _best_k(df, features, lambda k: KMeans(k=k, seed=seed, initSteps=max(2, n_init // 2)), ks)


def bisecting_kmeans(df: DataFrame, features, ks=range(3, 9), seed: int = 42) -> tuple[DataFrame, list[tuple]]:
    """Hierarchical alternative that scales, in place of agglomerative linkage."""
    return _best_k(df, features, lambda k: BisectingKMeans(k=k, seed=seed), ks)


def _covariance(x: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the arrays ``x``, summed around the mean; only d x d numbers reach the driver."""
    size = x.agg(F.max(F.size("x")).alias("d"), F.count("x").alias("n")).first()
    d, n = size["d"] or 0, size["n"]
    sums = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).collect()
    mean = np.zeros(d)
    for r in sums:
        mean[r["i"]] = r["v"]

    def products(frames):
        total = np.zeros((d, d))
        for frame in frames:
            if len(frame):
                v = np.stack(frame["x"].to_numpy()) - mean
                total += v.T @ v
        yield pd.DataFrame({"i": np.arange(d), "row": list(total)})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": group["i"].iloc[:1], "row": [np.sum(np.stack(group["row"].to_numpy()), axis=0)]})

    rows = x.mapInPandas(products, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>").collect()
    out = np.zeros((d, d))
    for r in rows:
        out[r["i"]] = r["row"]
    return mean, out / max(1, n - 1)


def pca(df: DataFrame, features, variance: float = 0.95) -> tuple[DataFrame, list[float]]:
    """``(table with components, explained variance ratios)`` for the fewest components that
    together explain ``variance``.

    The covariance is summed in Spark and decomposed as a symmetric matrix. A component's largest
    loading is positive.
    """
    data = df.withColumn("__x", as_array(df, features))
    mean, covariance = _covariance(data.where("__x is not null").select(F.col("__x").alias("x")))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    ratios = (values / values.sum() if values.sum() > 0 else np.zeros(len(values))).tolist()
    count = min(len(ratios), int(np.searchsorted(np.cumsum(ratios), variance - 1e-12) + 1))
    axes = vectors[:, :count]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(count)])

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        some = x.notna().to_numpy()
        out: list = [None] * len(x)
        if some.any():
            for i, row in zip(np.flatnonzero(some), (np.stack(x[some].to_numpy()) - mean) @ axes):
                out[i] = row
        return pd.Series(out, dtype=object)

    return data.withColumn("components", array_to_vector(project("__x"))).drop("__x"), ratios[:count]


def explained_variance(ratios: list[float], spark) -> DataFrame:
    rows, total = [], 0.0
    for i, r in enumerate(ratios):
        total += r
        rows.append((i + 1, r, total))
    return spark.createDataFrame(rows, "component int, explained_variance_ratio double, cumulative double")
