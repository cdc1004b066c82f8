"""Row weights against class imbalance and target concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..functions.lookup import lookup


def weight_table(df: DataFrame, label: str) -> DataFrame:
    """``n / (k * n_c)`` per value: every value gets the same total, the mean over rows is 1."""
    counts = df.where(col_of(label).isNotNull()).groupBy(col_of(label).alias("__weighed")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.withColumn("weight", totals.getField("n") / (totals.getField("k") * F.col("n")))


def class_weights(df: DataFrame, label: str, new: str = "weight") -> DataFrame:
    """Append the balanced weight of the row's class."""
    table = weight_table(df, label).withColumnRenamed("weight", new)
    return lookup(df.withColumn("__weighed", col_of(label)), ["__weighed"], table, [new], weight="n").drop("__weighed")


def inverse_frequency_weights(df: DataFrame, y: str, new: str = "weight") -> DataFrame:
    """Append ``1 / frequency`` of the row's target value, scaled to mean 1.

    Dividing by the mean of ``n / n_y`` over rows, which is the number of distinct values, gives
    the balanced formula; the target may have many values, so the lookup may shuffle.
    """
    return class_weights(df, y, new)


def balance_log(before: DataFrame, after: DataFrame, strategy: str) -> DataFrame:
    """Strategy and table sizes before and after balancing."""
    sizes = before.agg(F.count(F.lit(1)).alias("original_size"))
    balanced = after.agg(F.count(F.lit(1))).scalar()
    return sizes.select(F.lit(strategy).alias("strategy"), "original_size", balanced.alias("balanced_size"))


def balance_counts(balanced: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """``(split, <label>, is_synthetic, n)``: original and synthetic training rows, and test rows, per class."""
    made = F.coalesce(F.col("is_synthetic"), F.lit(False)) if "is_synthetic" in balanced.columns else F.lit(False)
    sides = balanced.select(F.lit("train").alias("split"), col_of(label), made.alias("is_synthetic")).unionByName(
        test.select(F.lit("test").alias("split"), col_of(label), F.lit(False).alias("is_synthetic")))
    return sides.groupBy("split", col_of(label), "is_synthetic").agg(F.count(F.lit(1)).alias("n"))
