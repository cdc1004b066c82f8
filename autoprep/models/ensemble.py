"""Combine the prediction columns of several models row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of


def _normalised(weights: list[float]) -> list[float]:
    total = sum(weights)
    if total == 0:
        return [1.0 / len(weights)] * len(weights)
    return [w / total for w in weights]


def _weighted_sum(cols: list[str], weights: list[float]) -> Column:
    out = F.lit(0.0)
    for c, w in zip(cols, _normalised(weights)):
        out = out + F.lit(w) * col_of(c).cast("double")
    return out


def _vote(cols: list[str], weights: list[float]) -> Column:
    """Class with the largest total weight, the smallest class on ties."""
    ballots = []
    for c in cols:
        support = F.lit(0.0)
        for other, w in zip(cols, weights):
            support = support + F.when(col_of(other) == col_of(c), F.lit(float(w))).otherwise(F.lit(0.0))
        ballots.append(F.struct(support.alias("s"), (-col_of(c).cast("double")).alias("c")))
    return -F.array_max(F.array(*ballots)).getField("c")


def ensemble_mean(df: DataFrame, cols: list[str], weights: list[float], new: str = "ensemble") -> DataFrame:
    """Weighted mean for regression; weights are scores over their sum and may be negative."""
    return df.withColumn(new, _weighted_sum(cols, weights))


def ensemble_vote(
    df: DataFrame, cols: list[str], weights: list[float], method: str = "weighted", new: str = "ensemble"
) -> DataFrame:
    """Weighted class vote; ``code_mean`` rounds the weighted mean of the class codes instead."""
    if method == "code_mean":
        return df.withColumn(new, F.bround(_weighted_sum(cols, weights), 0))
    if method != "weighted":
        raise ValueError(f"unknown vote: {method!r}")
    return df.withColumn(new, _vote(cols, _normalised(weights)))


def ensemble_hard_vote(df: DataFrame, cols: list[str], new: str = "ensemble") -> DataFrame:
    return df.withColumn(new, _vote(cols, [1.0] * len(cols)))
