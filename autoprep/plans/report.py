"""The run's findings as one ``(section, item, value)`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "section string, item string, value string"


def _rows(spark, section: str, items: dict) -> DataFrame:
    return spark.createDataFrame([(section, k, None if v is None else str(v)) for k, v in items.items()], SCHEMA)


def _balance_reason(decision: dict) -> str:
    if decision["balance"] == "none":
        return "classes are even enough" if decision["task"] == "classification" else "only classes are balanced"
    few = decision["minority_count"]
    size = f"{few} rows in the smallest class"
    return f"{decision['balance_level']} imbalance, {size}" + (": too few for the usual remedy" if few < 6 else "")


def _relevant(scores: dict, metrics: tuple) -> dict:
    """The scores that count for the task, the leading metric first."""
    return {name: v for m in metrics for name, v in scores.items() if name in (m, f"{m}_weighted")}


def report(result) -> DataFrame:
    """Data, cleaning, preprocessing, models, ensemble, comparison and recommendations of a run.

    Scores are those that count for the task: with uneven classes accuracy is left out.
    """
    spark, parts = result.spark, []
    sizes = [
        F.struct(F.lit("data").alias("section"), F.lit(item).alias("item"), F.col(c).cast("string").alias("value"))
        for item, c in (("rows", "n_rows"), ("columns", "n_columns"))
    ]
    parts.append(result.table.select(F.inline(F.array(*sizes))))
    parts.append(_rows(spark, "data", {
        "duplicates removed": result.duplicates_removed, "rows without a target removed": result.null_targets_removed,
    }))
    if result.target_row:
        t = result.target_row
        parts.append(_rows(spark, "data", {"target": t["name"], "task": result.task, "target values": t["unique_count"]}))
    else:
        parts.append(_rows(spark, "data", {"task": result.task}))
    cleaned = dict.fromkeys([*result.preparation.quick.log_rows, *result.preparation.cleaning.log_rows])
    entries = [("cleaning", c, rule) for c, rule in cleaned]
    entries += [("cleaning", c, f"outliers capped to {low} .. {high}") for c, (low, high) in result.preparation.bounds.items()]
    parts.append(spark.createDataFrame(entries, SCHEMA))
    parts.append(result.actions.select(
        F.lit("preprocessing").alias("section"), F.col("column").alias("item"), F.col("action").alias("value")))
    if result.decision:
        d = result.decision
        parts.append(_rows(spark, "preprocessing", {
            "balance strategy": d["balance"], "reason for the strategy": _balance_reason(d), "target weighting": d["weighting"]}))
    if result.balance_counts is not None:
        parts.append(result.balance_counts.select(
            F.lit("preprocessing").alias("section"),
            F.concat_ws(" ", F.lit("rows of class"), F.col("class").cast("string"), F.lit("in"), "split",
                        F.when(F.col("is_synthetic"), F.lit("(synthetic)"))).alias("item"),
            F.col("n").cast("string").alias("value")))
    if result.balance_log is not None:
        b = result.balance_log
        parts.append(b.select(F.lit("preprocessing").alias("section"), F.lit("balance").alias("item"),
                              F.concat_ws(" ", "strategy", "original_size", F.lit("->"), "balanced_size").alias("value")))
    if result.balance_error:
        parts.append(_rows(spark, "preprocessing", {"balance not applied": result.balance_error}))
    if result.ranking is not None:
        parts.append(result.ranking.select(
            F.lit("models").alias("section"), F.concat_ws(". ", "rank", "model").alias("item"),
            F.when(F.col("cv_mean").isNull(), F.col("status")).otherwise(
                F.concat_ws(" ", F.bround("cv_mean", 4), F.lit("±"), F.bround("cv_std", 4), "best_params",
                            F.concat(F.format_number("seconds", 1), F.lit(" s")))).alias("value"),
        ))
    if result.task_scores:
        parts.append(_rows(spark, "metrics", _relevant(result.task_scores, result.metrics)))
    if result.ensemble_scores:
        relevant = _relevant(result.ensemble_scores, result.metrics)
        parts.append(_rows(spark, "ensemble", {"method": result.ensemble_method, "models": result.ensemble_models, **relevant}))
        first = next(iter(relevant))
        best = result.best_test_scores or {}
        if best.get(first) is not None:
            parts.append(_rows(spark, "improvement", {
                "best model, cross-validation": result.best_score,
                f"best model, test {first}": best[first],
                f"ensemble, test {first}": result.ensemble_scores[first],
                f"ensemble minus best, test {first}": round(result.ensemble_scores[first] - best[first], 4),
            }))
    parts.append(_rows(spark, "run", {"seconds": round(result.seconds, 1)}))
    if result.target_row:
        advice = {"features": "review the most important features of the best model",
                  "validation": "validate on data from a later period"}
        if result.target_row["balance_level"] in ("severe", "extreme"):
            advice = {"balance": "severe imbalance: collect more rows of the minority class", **advice}
        parts.append(_rows(spark, "recommendations", advice))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
