"""Splits and folds by key hash: the same rows on any partitioning, cluster size or rerun."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of, key_hash
from ..functions.lookup import lookup

# Hash buckets bound the exact-percentile buffer of one class at this many entries.
BUCKETS = 100_000


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hash_split(df: DataFrame, key, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    test = key_hash(_keys(key), seed, 10_000) < int(round(test_size * 10_000))
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def _class_cutoffs(df: DataFrame, key, label: str, probs: list[float], seed: int) -> DataFrame:
    return (
        df.where(col_of(label).isNotNull())
        .select(col_of(label).alias("__stratum"), key_hash(_keys(key), seed, BUCKETS).alias("__h"))
        .groupBy("__stratum")
        .agg(F.count(F.lit(1)).alias("__n"),
             F.percentile("__h", F.array(*[F.lit(float(p)) for p in probs])).alias("__cuts"))
    )


def _with_cutoffs(df: DataFrame, key, label: str, probs: list[float], seed: int) -> DataFrame:
    cuts = _class_cutoffs(df, key, label, probs, seed)
    return lookup(df.withColumn("__stratum", col_of(label)), ["__stratum"], cuts, ["__cuts"], weight="__n")


def stratified_split(df: DataFrame, key, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Each class gives its lowest ``test_size`` share of hashes to the test part."""
    h = key_hash(_keys(key), seed, BUCKETS)
    test = F.coalesce(h <= F.col("__cuts")[0], F.lit(False))
    out = _with_cutoffs(df, key, label, [test_size], seed)
    return out.withColumn("split", F.when(test, "test").otherwise("train")).drop("__cuts", "__stratum")


def assign_folds(df: DataFrame, key, label: str | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` in 0..k-1; with a label every class is spread evenly over the folds."""
    if label is None:
        return df.withColumn("fold", (key_hash(_keys(key), seed, BUCKETS) % k).cast("int"))
    h = key_hash(_keys(key), seed, BUCKETS)
    passed = F.size(F.filter(F.col("__cuts"), lambda cut: h > cut))
    out = _with_cutoffs(df, key, label, [i / k for i in range(1, k)], seed)
    return out.withColumn("fold", F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(passed).cast("int")).drop("__cuts", "__stratum")
