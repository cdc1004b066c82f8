"""End to end: dirty table in, ranked models, ensemble, scored test rows and report out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.columns import col_of
from ..functions.lineage import cut_lineage
from ..models.catalog import specs
from ..models.train import cross_validate, cv_runs, feature_importance, rank, ranked, test_scores
from ..operators.balance import balance
from ..operators.clean import dedup, fit_quick_clean
from ..operators.metrics import binary_auc, classification_metrics, regression_metrics
from ..operators.profile import profile_columns, profile_table, target_profile
from ..operators.split import assign_folds, hash_split, stratified_split
from ..operators.transform import decode_target, encode_target, target_classes
from ..operators.weights import balance_counts, balance_log, class_weights, inverse_frequency_weights
from ..sources.tables import write_predictions
from .preprocess import Preparation, fit_preparation
from .recommend import recommend_balance, recommend_metrics, recommend_weighting
from .report import report
from .score import Artifact, assemble, scored
from .unsupervised import TASKS, search, task_scores


@dataclass
class RunResult:
    spark: SparkSession
    task: str
    table: DataFrame
    profile: DataFrame
    preparation: Preparation
    actions: DataFrame
    train: DataFrame
    test: DataFrame | None = None
    target_row: dict | None = None
    decision: dict = field(default_factory=dict)
    metrics: tuple = ()
    task_scores: dict = field(default_factory=dict)
    seconds: float = 0.0
    balance_log: DataFrame | None = None
    balance_counts: DataFrame | None = None
    balance_error: str | None = None
    trained: list = field(default_factory=list)
    rows_in: int = 0
    duplicates_removed: int = 0
    null_targets_removed: int = 0
    runs: DataFrame | None = None
    ranking: DataFrame | None = None
    importance: DataFrame | None = None
    artifact: Artifact | None = None
    ensemble_method: str = "none"
    ensemble_models: list = field(default_factory=list)
    ensemble_scores: dict = field(default_factory=dict)
    best_test_scores: dict | None = None
    best_score: float = 0.0
    scored: DataFrame | None = None
    report: DataFrame | None = None


def run(
    spark: SparkSession,
    df: DataFrame,
    key: str,
    target: str | None = None,
    force_task: str | None = None,
    config: RunConfig | None = None,
    models: list[str] | None = None,
    duplicate_columns: list[str] | None = None,
    features: list[dict] = (),
    plan: dict[str, dict] | None = None,
) -> RunResult:
    """The whole way for one table. ``key`` names the row; it takes no part in the features.

    Rows equal in all columns, the key's included, are one row; with ``duplicate_columns`` those
    equal in these columns are, and the one with the smallest key stays. What goes, and rows
    without a target, is counted in the result and the report. ``features`` adds derived columns and
    ``plan`` overrules decisions about columns, as in ``fit_preparation``. Every fitted value comes from
    training rows only, and balancing touches the training part only.

    Without a target, or with ``force_task`` one of "clustering", "dimensionality_reduction" and
    "anomaly_detection", every row is prepared and the task's models are searched (``plans.unsupervised``);
    a target that was named then takes no part, and rows without one stay.
    """
    started = time.time()
    config = config or RunConfig()
    if force_task not in (None, "classification", "regression", *TASKS):
        raise ValueError(f"unknown task {force_task!r}")
    if target is None and force_task in ("classification", "regression"):
        raise ValueError(f"{force_task} needs a target")
    if target is not None and target not in df.columns:
        raise KeyError(target)
    unique = cut_lineage(dedup(df, duplicate_columns, key))
    rows_in, distinct = df.count(), unique.count()
    if force_task in TASKS and target is not None:
        unique, target = unique.drop(target), None
    data = unique.where(col_of(target).isNotNull()) if target else unique
    removed = {"rows_in": rows_in, "duplicates_removed": rows_in - distinct, "null_targets_removed": distinct - data.count()}
    quick = fit_quick_clean(data, target).transform(data)
    profile = profile_columns(quick.drop(key), target)
    if target is None:
        return _without_target(spark, data, key, profile, config, removed, features, plan, force_task or "clustering", models, started)

    row = target_profile(data, target)
    facts = row.first().asDict()
    decision = recommend_balance(row, force_task).first()
    task, strategy = decision["task"], decision["balance"]
    weighting = recommend_weighting(row, force_task).first()["weighting"]
    metrics = recommend_metrics(task, task == "classification" and decision["imbalanced"])
    classes = None
    if task == "classification":
        classes = target_classes(data, target)
        data = encode_target(data, target, classes, "__label")
        smallest = facts["minority_count"]
        stratify = strategy != "none" and smallest >= 2
    else:
        data = data.withColumn("__label", col_of(target).cast("double"))
        stratify = False
    if stratify:
        data = stratified_split(data, key, "__label", config.test_size, config.seed)
    else:
        data = hash_split(data, key, config.test_size, config.seed)
    data = cut_lineage(data)
    train_raw = data.where(F.col("split") == "train").drop("split")
    test_raw = data.where(F.col("split") == "test").drop("split")

    prep = fit_preparation(train_raw, target, [key], "__label", config.feature_selection, features, plan)
    train = cut_lineage(prep.transform(train_raw, keep=[key, "__label"]))
    test = prep.transform(test_raw, keep=[key, "__label"])
    result = RunResult(
        spark, task, profile_table(df), profile, prep,
        spark.createDataFrame(prep.actions, "column string, action string"), train, test, facts, **removed,
        decision={**decision.asDict(), "weighting": weighting}, metrics=metrics,
    )

    balanced = train
    if strategy not in ("none", "class_weight"):
        try:
            balanced = cut_lineage(balance(train, key, prep.features, "__label", strategy, config.smote_k, config.seed))
            result.balance_log = balance_log(train, balanced, strategy)
            result.balance_counts = balance_counts(balanced, test, "__label").withColumnRenamed("__label", "class")
        except ValueError as e:
            result.balance_error = f"{strategy}: {e}"
    folds = assign_folds(balanced, key, "__label" if task == "classification" else None, config.cv_folds, config.seed)
    weight = None
    if task == "classification" and decision["imbalanced"]:
        folds, weight = class_weights(folds, "__label"), "weight"
    elif weighting == "inverse_frequency":
        folds, weight = inverse_frequency_weights(folds, "__label"), "weight"
    ready = assemble(folds.withColumnRenamed("__label", "label"), prep.features).select(
        key, "features", "label", "fold", *([weight] if weight else []))
    # Tree learners sample by partition: a layout fixed by the key makes reruns agree.
    ready = cut_lineage(ready.repartition(F.xxhash64(key)).sortWithinPartitions(key))

    chosen = specs(task, models, config.grids)[: config.max_models if models is None else None]
    result.trained = ranked(cross_validate(ready, chosen, task, key, config.cv_folds, weight, config.parallelism, config.seed))
    result.runs, result.ranking = cv_runs(spark, result.trained), rank(spark, result.trained)
    usable = [t for t in result.trained if t.model is not None]
    if not usable:
        result.seconds = time.time() - started
        result.report = report(result)
        _write(result, key, config)
        return result
    best = usable[0]
    result.best_score = best.cv_mean
    result.importance = feature_importance(spark, best.model, prep.features)

    tested = cut_lineage(assemble(test.withColumnRenamed("__label", "label"), prep.features).select(key, "features", "label"))
    members = usable[: config.n_top_ensemble]
    result.artifact = Artifact(
        prep, [t.model for t in members], [t.cv_mean for t in members], task, [key], classes,
        {"name": best.name, "cv_mean": best.cv_mean, "cv_std": best.cv_std, "members": [t.name for t in members],
         "ensemble_method": config.ensemble_method},
    )
    result.ensemble_models = [t.name for t in members]
    result.ensemble_method = config.ensemble_method if len(members) > 1 else "single"
    if tested.isEmpty():
        result.seconds = time.time() - started
        result.report = report(result)
        _write(result, key, config)
        return result
    result.best_test_scores = test_scores(best.model, tested, task)
    predicted = cut_lineage(result.artifact.predict(test_raw, keep=["__label"]))
    if task == "regression":
        result.ensemble_scores = regression_metrics(predicted, "__label", "prediction").first().asDict()
    else:
        result.ensemble_scores = classification_metrics(predicted, "__label", "prediction").first().asDict()
        if len(classes) == 2:
            result.ensemble_scores.update(binary_auc(predicted, "__label", "prediction").first().asDict())
    result.scored = _scored(predicted, key, task, classes)
    result.seconds = time.time() - started
    result.report = report(result)
    _write(result, key, config)
    return result


def _scored(predicted: DataFrame, key: str, task: str, classes: list | None) -> DataFrame:
    if task == "classification":
        predicted = decode_target(decode_target(predicted, "__label", classes, "__y"), "prediction", classes, "__p")
        return scored(predicted, "__y", "__p", task, [key])
    return scored(predicted, "__label", "prediction", task, [key])


def _without_target(
    spark, data: DataFrame, key: str, profile: DataFrame, config: RunConfig, removed: dict, features: list[dict],
    plan: dict | None, task: str, models: list[str] | None, started: float,
) -> RunResult:
    """No target: prepare every row, search the task's models, and keep the rows of the best."""
    prep = fit_preparation(data, None, [key], None, config.feature_selection, features, plan)
    train = cut_lineage(prep.transform(data, keep=[key]))
    result = RunResult(spark, task, profile_table(data), profile, prep,
                       spark.createDataFrame(prep.actions, "column string, action string"), train, **removed,
                       metrics=recommend_metrics(task))
    result.trained, result.scored = search(train, key, prep.features, task, models, config.grids, config.seed)
    result.runs, result.ranking = cv_runs(spark, result.trained), rank(spark, result.trained)
    if result.scored is not None:
        result.scored = cut_lineage(result.scored)
        result.best_score = result.trained[0].cv_mean
        result.task_scores = task_scores(train, key, prep.features, task, result.trained, result.scored)
    result.seconds = time.time() - started
    result.report = report(result)
    _write(result, key, config)
    return result


def _write(result: RunResult, key: str, config: RunConfig) -> None:
    if not config.output_dir:
        return
    folder = config.output_dir.rstrip("/")
    if result.scored is not None:
        write_predictions(result.scored, f"{folder}/predictions", "csv", [key], mode="overwrite")
    if config.save_report:
        result.report.write.mode("overwrite").parquet(f"{folder}/report")
    if config.save_model and result.artifact is not None:
        result.artifact.save(result.spark, f"{folder}/model")
