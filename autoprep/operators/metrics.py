"""Metric tables from label and prediction columns."""

from __future__ import annotations

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of
from .vectors import as_array, squared_distance

MAX_CLUSTERS = 2_000


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _side(cls: Column, support: Column, predicted: Column, hit: Column) -> Column:
    return F.struct(cls.alias("cls"), support.alias("support"), predicted.alias("predicted"), hit.alias("hit"))


def classification_metrics(df: DataFrame, label: str, pred: str, digits: int | None = 4) -> DataFrame:
    """Accuracy and support-weighted f1, precision, recall; an empty denominator counts as 0."""
    confusion = df.groupBy(col_of(label).cast("double").alias("y"), col_of(pred).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0).cast("bigint")
    per_class = (
        confusion.select(F.inline(F.array(
            _side(F.col("y"), F.col("n"), zero, F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero)),
            _side(F.col("p"), zero, F.col("n"), zero),
        )))
        .groupBy("cls").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    )
    s, p, h = F.col("support"), F.col("predicted"), F.col("hit")
    total = F.sum(s)
    values = {
        "accuracy": F.sum(h) / total,
        "f1_weighted": F.sum(s * _share(2.0 * h, s + p)) / total,
        "precision_weighted": F.sum(s * _share(h, p)) / total,
        "recall_weighted": F.sum(s * _share(h, s)) / total,
    }
    return per_class.agg(*[(F.bround(v, digits) if digits is not None else v).alias(k) for k, v in values.items()])


def binary_auc(df: DataFrame, label: str, pred: str, digits: int | None = 4) -> DataFrame:
    """ROC AUC of hard 0/1 predictions, which is the mean of both class recalls; null unless binary."""
    y, p = col_of(label).cast("double"), col_of(pred).cast("double")
    positive, negative = F.count_if(y == 1), F.count_if(y == 0)
    tpr = F.try_divide(F.count_if((y == 1) & (p == 1)), positive)
    tnr = F.try_divide(F.count_if((y == 0) & (p == 0)), negative)
    value = (tpr + tnr) / 2
    return df.agg((F.bround(value, digits) if digits is not None else value).alias("roc_auc"))


def probability_auc(df: DataFrame, label: str, score: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score).evaluate(df)


def regression_metrics(df: DataFrame, label: str, pred: str, digits: int | None = 4) -> DataFrame:
    y, e = col_of(label).cast("double"), col_of(label).cast("double") - col_of(pred).cast("double")
    mse = F.avg(e * e)
    values = {
        "r2": 1 - F.try_divide(mse, F.var_pop(F.when(e.isNotNull(), y))),
        "mse": mse,
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(mse),
    }
    return df.agg(*[(F.bround(v, digits) if digits is not None else v).alias(k) for k, v in values.items()])


def clustering_metrics(df: DataFrame, features: str, cluster: str, silhouette: bool = True) -> DataFrame:
    """Silhouette (squared Euclidean), Davies-Bouldin and Calinski-Harabasz in one row."""
    points = df.where(col_of(cluster).isNotNull()).select(as_array(df, features).alias("x"), col_of(cluster).alias("c"))
    summary = (
        points.groupBy("c")
        .agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(array_to_vector("x")).alias("center"))
        .limit(MAX_CLUSTERS + 1).collect()
    )
    if len(summary) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    spark = df.sparkSession
    schema = "silhouette double, davies_bouldin double, calinski_harabasz double"
    if len(summary) < 2:
        return spark.createDataFrame([(None, None, None)], schema)
    ids = [r["c"] for r in summary]
    n = np.array([r["n"] for r in summary], dtype=float)
    centers = np.array([r["center"].toArray() for r in summary])
    kind = points.schema["c"].dataType.simpleString()
    table = spark.createDataFrame([(i, c.tolist()) for i, c in zip(ids, centers)], f"c {kind}, center array<double>")
    spread = {
        r["c"]: r for r in points.join(F.broadcast(table), "c")
        .withColumn("d2", squared_distance(F.col("x"), F.col("center")))
        .groupBy("c").agg(F.avg(F.sqrt("d2")).alias("scatter"), F.sum("d2").alias("within")).collect()
    }
    scatter = np.array([spread[i]["scatter"] for i in ids])
    within = sum(spread[i]["within"] for i in ids)
    # Around the overall mean, so that the squared norms stay small; no k x k x d array.
    overall = (centers * n[:, None]).sum(0) / n.sum()
    moved = centers - overall
    squares = (moved ** 2).sum(1)
    apart = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * moved @ moved.T, 0))
    np.fill_diagonal(apart, np.inf)
    with np.errstate(divide="ignore"):
        db = float(((scatter[:, None] + scatter[None, :]) / apart).max(axis=1).mean())
    between = float((n * squares).sum())
    k, total = len(ids), n.sum()
    ch = between * (total - k) / (within * (k - 1)) if within > 0 else None
    sil = None
    if silhouette:
        codes = spark.createDataFrame([(v, float(i)) for i, v in enumerate(ids)], f"c {kind}, prediction double")
        vectors = points.join(F.broadcast(codes), "c").select(array_to_vector("x").alias("features"), "prediction")
        sil = float(ClusteringEvaluator().evaluate(vectors))
    return spark.createDataFrame([(sil, db, float(ch) if ch is not None else None)], schema)
