"""Decision rules: profile rows in, one recommended action per column out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TASK_METRICS

SKEW_MEDIAN = 1.0
SKEW_ROBUST = 2.0
DROP_NULL_PCT = 50


def _skew():
    return F.abs(F.coalesce(F.col("skew_value"), F.lit(0.0)))


def _dropped():
    return F.col("is_high_null") & F.col("is_numeric_role")


def _impute():
    """Gaps: drop above half missing, median when skewed, else mean."""
    return (
        F.when(F.col("null_pct") == 0, "none")
        .when(F.col("null_pct") > DROP_NULL_PCT, "drop")
        .when(_skew() > SKEW_MEDIAN, "median")
        .otherwise("mean")
    )


def _encode():
    u = F.col("unique_count")
    return (
        F.when(F.col("is_high_cardinality") & (u > 50), "drop")
        .when(u <= 2, "label")
        .when(u <= 10, "onehot")
        .otherwise("target")
    )


def _log1p():
    return F.coalesce((_skew() > SKEW_ROBUST) & (F.col("min_value") >= 0) & ~_dropped(), F.lit(False))


def _scale():
    return F.when(_dropped(), "none").when(_skew() > SKEW_ROBUST, "robust").otherwise("standard")


def recommend_impute(columns: DataFrame) -> DataFrame:
    return columns.where("is_numeric_role").select("column", _impute().alias("impute"))


def recommend_encode(columns: DataFrame) -> DataFrame:
    return columns.where("is_categorical_role").select("column", _encode().alias("encode"))


def recommend_log1p(columns: DataFrame) -> DataFrame:
    return columns.where("is_numeric_role").select("column", _log1p().alias("log1p"))


def recommend_scale(columns: DataFrame) -> DataFrame:
    return columns.where("is_numeric_role").select("column", _scale().alias("scale"))


def recommend_columns(columns: DataFrame) -> DataFrame:
    """All four column decisions side by side, evaluated in one pass over the profile rows."""
    numeric, text = F.col("is_numeric_role"), F.col("is_categorical_role")
    return columns.select(
        "position", "column", "type", "null_pct", "unique_count", "skew_value", F.when(numeric, _impute()).alias("impute"),
        F.when(text, _encode()).alias("encode"), F.when(numeric, _log1p()).alias("log1p"), F.when(numeric, _scale()).alias("scale"),
    )


def _imbalanced():
    return F.coalesce(~F.col("balance_level").isin("balanced", "mild"), F.lit(False))


def recommend_task(target: DataFrame, forced: str | None = None) -> DataFrame:
    """Task of the run; a forced regression on few, imbalanced values becomes classification."""
    base = F.lit(forced) if forced else F.col("task_type")
    switch = (base == "regression") & (F.col("unique_count") <= 15) & _imbalanced()
    return target.withColumn("task", F.when(switch, "classification").otherwise(base))


def recommend_balance(target: DataFrame, forced: str | None = None) -> DataFrame:
    """Oversampling remedy by level, weakened when the smallest class is too small."""
    strategy = (
        F.when((F.col("task") != "classification") | ~_imbalanced(), "none")
        .when(F.col("minority_count") < 2, "class_weight")
        .when(F.col("minority_count") < 6, "smote")
        .when(F.col("balance_level") == "extreme", "adasyn")
        .when(F.col("balance_level") == "severe", "smote_enn")
        .otherwise("smote")
    )
    return recommend_task(target, forced).select(
        "name", "task", "balance_level", "minority_count", strategy.alias("balance"), _imbalanced().alias("imbalanced")
    )


def recommend_weighting(target: DataFrame, forced: str | None = None) -> DataFrame:
    heavy = (F.col("task") == "regression") & F.col("concentration_level").isin("severe", "extreme")
    return recommend_task(target, forced).select(
        "name", "task", "concentration_level", F.when(heavy, "inverse_frequency").otherwise("none").alias("weighting")
    )


def recommend_metrics(task: str, imbalanced: bool = False) -> tuple[str, ...]:
    """Names of the metrics that count for a task, the leading one first."""
    return TASK_METRICS["classification_imbalanced" if task == "classification" and imbalanced else task]
