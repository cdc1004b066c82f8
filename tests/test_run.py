import pytest
from pyspark.sql import functions as F

from autoprep import RunConfig
from autoprep.plans import features
from autoprep.plans.preprocess import fit_preparation
from autoprep.plans.run import run
from autoprep.plans.score import Artifact, score
from autoprep.plans.unsupervised import search
from autoprep.streaming.scoring import score_stream, write_scores

GRIDS = {"LogisticRegression": {"C": [1.0]}, "RandomForestClassifier": {"n_estimators": [5], "max_depth": [4]},
         "LinearRegression": {}, "Ridge": {"alpha": [1.0]}}


@pytest.fixture(scope="module")
def people(spark):
    i = F.col("id")
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    income = F.bround(noise * 90 + 10, 2)
    df = spark.range(400).select(
        "id", F.concat(F.lit("$"), F.format_number(income * 10, 2)).alias("ingreso"),
        F.concat(F.format_number(noise * 100, 1), F.lit("%")).alias("tasa"),
        F.when(i % 4 == 0, "2024-01-15").when(i % 4 == 1, F.format_string("%02d/03/2023", i % 28 + 1)).otherwise(F.format_string("2022/05/%02d", i % 28 + 1)).alias("fecha"),
        F.when(i % 9 == 0, None).otherwise(noise * 5 + i % 3).alias("uso"),
        F.element_at(F.array(*[F.lit(x) for x in ("M", "female", "NB")]), (i % 3 + 1).cast("int")).alias("genero"),
        F.concat(F.lit("cli"), i).alias("codigo"),
        F.when(income > 80, "baja").otherwise("sigue").alias("estado"),
        (income * 3 + i % 3).alias("gasto"),
    )
    return df.unionByName(df.where("id < 20"))


def test_classification_from_dirty_table_to_stream(spark, people, tmp_path):
    table = people.drop("gasto")
    config = RunConfig(cv_folds=3, grids=GRIDS, output_dir=str(tmp_path), save_model=True)
    result = run(spark, table, "id", "estado", config=config, models=["LogisticRegression", "RandomForestClassifier"])
    assert result.task == "classification" and result.best_score > 0.8
    assert result.train.count() + result.test.count() == 400
    assert "codigo" in result.preparation.dropped and not any(c.startswith("codigo") for c in result.preparation.features)
    assert "estado" not in {c for c, _ in result.preparation.actions}
    assert result.balance_log.first()["balanced_size"] > 0 and result.balance_error is None
    assert set(result.ensemble_scores) == {"accuracy", "f1_weighted", "precision_weighted", "recall_weighted", "roc_auc"}
    row = result.scored.first()
    assert row["correcto"] == (row["actual"] == row["prediccion"])
    lines = result.report.collect()
    assert {"data", "cleaning", "preprocessing", "models", "ensemble", "improvement", "run", "recommendations"} <= {r["section"] for r in lines}
    # The classes are uneven, so the report leads with f1 and has no accuracy.
    assert result.decision["imbalanced"] and result.metrics[0] == "f1"
    shown = {r["item"] for r in lines if r["section"] == "ensemble"}
    assert "f1_weighted" in shown and "roc_auc" in shown and not any("accuracy" in r["item"] for r in lines)
    cleaning = {(r["item"], r["value"]) for r in lines if r["section"] == "cleaning"}
    assert cleaning >= {tuple(r) for r in result.preparation.quick.log_rows} and any(v.startswith("outliers capped") or c == "ingreso" for c, v in cleaning)
    counts = {(r["split"], r["class"], r["is_synthetic"]): r["n"] for r in result.balance_counts.collect()}
    before = {r["__label"]: r["count"] for r in result.train.groupBy("__label").count().collect()}
    after = result.balance_log.first()["balanced_size"]
    assert sum(n for (s, _, _), n in counts.items() if s == "train") == after
    assert all(counts.get(("train", c, False), 0) <= n for c, n in before.items())
    assert sum(n for (s, _, _), n in counts.items() if s == "test") == result.test.count()
    assert all(r["value"].endswith(" s") for r in lines if r["section"] == "models")

    new = table.drop("estado")
    batch = score(spark, f"{tmp_path}/model", new)
    assert batch.count() == 420 and {r[0] for r in batch.select("prediccion").distinct().collect()} <= {"baja", "sigue"}
    # The fitted values are replayed: one row alone gets the score it has among all.
    one = score(spark, f"{tmp_path}/model", new.where("id = 7")).first()
    assert one == batch.where("id = 7").first()
    with pytest.raises(Exception, match="lacks columns"):
        score(spark, f"{tmp_path}/model", new.drop("uso"))

    new.write.parquet(f"{tmp_path}/arriving")
    stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/arriving")
    query = write_scores(score_stream(spark, f"{tmp_path}/model", stream), f"{tmp_path}/scores", f"{tmp_path}/progress")
    query.awaitTermination(120)
    streamed = spark.read.parquet(f"{tmp_path}/scores")
    assert streamed.count() == 420 and streamed.exceptAll(batch).isEmpty()
    with pytest.raises(ValueError):
        score_stream(spark, f"{tmp_path}/model", new)


def test_regression(spark, people):
    result = run(spark, people.drop("estado"), "id", "gasto", config=RunConfig(cv_folds=3, grids=GRIDS), models=["LinearRegression", "Ridge"])
    assert result.task == "regression" and result.best_score > 0.9 and result.ensemble_scores["r2"] > 0.9
    assert result.scored.columns == ["id", "actual", "prediccion", "error_abs"]
    assert isinstance(result.artifact, Artifact)


def test_rare_class_falls_back_to_weights(spark):
    df = spark.range(50).select("id", (F.col("id") * 1.5).alias("a"), F.when(F.col("id") == 3, "x").otherwise("y").alias("target"))
    result = run(spark, df, "id", "target", config=RunConfig(cv_folds=2, grids=GRIDS), models=["RandomForestClassifier"])
    assert result.balance_log is None and result.trained[0].status == "ok"


def test_without_target(spark, people):
    result = run(spark, people.drop("estado", "gasto"), "id")
    assert result.task == "clustering" and result.scored.count() == 400 and result.test is None
    assert {t.name for t in result.trained} == {"KMeans", "BisectingKMeans"} and result.runs.count() == 12
    assert {r["item"] for r in result.report.where("section = 'metrics'").collect()} == {"silhouette", "davies_bouldin", "calinski_harabasz"}
    assert abs(result.task_scores["silhouette"] - result.best_score) < 1e-6
    with pytest.raises(KeyError):
        run(spark, people, "id", "nothing")
    with pytest.raises(ValueError, match="unknown task"):
        run(spark, people, "id", force_task="guess")
    with pytest.raises(ValueError, match="needs a target"):
        run(spark, people, "id", force_task="regression")


def test_forced_tasks_without_a_target(spark, tmp_path):
    """Two tight groups and ten rows far away; the named target takes no part."""
    far = F.col("id") >= 200
    df = spark.range(210).select(
        "id", F.when(far, 40 + F.col("id") % 7).otherwise((F.col("id") % 2) * 10 + (F.col("id") % 5) / 10).alias("a"),
        F.when(far, -30 - F.col("id") % 3).otherwise((F.col("id") % 2) * 10 + (F.col("id") % 11) / 20).alias("b"),
        F.when(F.col("id") % 3 == 0, None).otherwise("y").alias("target"))
    config = RunConfig(output_dir=str(tmp_path), grids={"DBSCAN": {"eps": [0.3], "min_samples": [3]}, "KMeans": {"n_clusters": [3, 4]}, "IsolationForest": {"n_estimators": [20]},
                                                          "LocalOutlierFactor": {"n_neighbors": [10], "contamination": [0.05]}})
    groups = run(spark, df, "id", "target", "clustering", config, ["DBSCAN", "KMeans"])
    assert groups.task == "clustering" and groups.scored.count() == 210 and groups.null_targets_removed == 0
    assert "target" not in groups.preparation.features and {t.status for t in groups.trained} == {"ok"}
    names = {r["model"]: r["n_combos"] for r in groups.ranking.collect()}
    assert names == {"DBSCAN": 1, "KMeans": 2}

    odd = run(spark, df, "id", "target", "anomaly_detection", config, ["IsolationForest", "LocalOutlierFactor"])
    assert odd.metrics == ("silhouette",) and odd.runs.count() == 4 and odd.scored.columns == ["id", "anomaly_score", "is_outlier"]
    best = odd.trained[0]
    assert best.cv_mean == max(r[2] for t in odd.trained for r in t.runs)

    axes = run(spark, df.drop("target"), "id", None, "dimensionality_reduction", config)
    assert axes.scored.columns[:2] == ["id", "component_1"] and axes.task_scores["explained_variance_ratio"] >= 0.95 - 1e-9
    assert axes.runs.count() == 3 and spark.read.option("header", True).csv(f"{tmp_path}/predictions").count() == 210
    wrong, rows = search(df.select("id", "a", "b"), "id", ["a", "b"], "clustering", ["DBSCAN"], {"DBSCAN": {"eps": [-1.0]}})
    assert wrong[0].status.startswith("failed") and rows is None
    with pytest.raises(ValueError, match="no models"):
        search(df, "id", ["a", "b"], "clustering", ["PCA"])


def test_nearest_neighbours_are_stored(spark, people, tmp_path):
    table = people.drop("gasto", "codigo")
    config = RunConfig(cv_folds=2, grids={**GRIDS, "KNeighborsClassifier": {"n_neighbors": [3], "weights": ["distance"]}},
                       output_dir=str(tmp_path), save_model=True)
    result = run(spark, table, "id", "estado", config=config, models=["KNeighborsClassifier", "LogisticRegression"])
    assert {t.status for t in result.trained} == {"ok"}
    new = table.where("id % 5 = 1").drop("estado").withColumn("id", F.col("id") + 5000)
    loaded, direct = score(spark, f"{tmp_path}/model", new), result.artifact.score(new)
    assert loaded.count() == new.count() and loaded.exceptAll(direct).isEmpty()


def test_rows_that_differ_in_their_key_stay_and_what_goes_is_counted(spark):
    df = spark.range(400).select("id", (F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 3).alias("b"), F.when(F.col("id") % 12 < 6, "x").otherwise("y").alias("target"))
    dirty = df.unionByName(df.where("id < 10")).unionByName(df.where("id < 5").withColumn("id", F.col("id") + 900).withColumn("target", F.lit(None)))
    config = RunConfig(cv_folds=2, grids=GRIDS)
    result = run(spark, dirty, "id", "target", config=config, models=["LogisticRegression"])
    assert (result.rows_in, result.duplicates_removed, result.null_targets_removed) == (415, 10, 5)
    assert result.train.where("id is not null").count() + result.test.count() == 400
    items = {r["item"]: r["value"] for r in result.report.collect() if r["section"] == "data"}
    assert items["duplicates removed"] == "10" and items["rows without a target removed"] == "5"
    few = run(spark, df, "id", "target", config=config, models=["LogisticRegression"], duplicate_columns=["a", "b", "target"])
    assert few.duplicates_removed == 388 and few.train.count() + few.test.count() == 12


def test_features_and_plan_are_stored_and_replayed(spark, people, tmp_path):
    """Derived columns and overruled decisions reach the model, the loaded artifact and the stream alike."""
    table = people.drop("estado")
    features.register("twice", lambda df, new, source, params: df.withColumn(new, 2 * F.col(source[0])))
    wanted = [
        {"new": "per_genero", "method": "ratio", "source": ["uso"], "params": {"group_col": "genero"}},
        {"new": "uso_bin", "method": "bin", "source": ["uso"], "params": {"n_bins": 3}},
        {"new": "largo", "method": "str_len", "source": ["codigo"]},
        {"new": "con_9", "method": "keyword", "source": ["codigo"], "params": {"pattern": "CLI9"}},
        {"new": "doble", "method": "twice", "source": ["uso"]},
        {"new": "cruce", "method": "interact", "source": ["doble", "uso_bin"]},
    ]
    plan = {"genero": {"encode": "label"}, "uso": {"impute": "zero", "scale": "none"}, "doble": {"scale": "minmax"}}
    config = RunConfig(cv_folds=2, grids=GRIDS, output_dir=str(tmp_path), save_model=True, feature_selection=False)
    result = run(spark, table, "id", "gasto", config=config, models=["Ridge"], features=wanted, plan=plan)
    actions = set(map(tuple, result.preparation.actions))
    assert {("doble", "derive twice"), ("genero", "encode label"), ("uso", "impute zero"), ("doble", "scale minmax")} <= actions
    assert {"per_genero", "uso_bin", "con_9", "doble", "cruce", "genero"} <= set(result.preparation.features)
    gaps = result.preparation.transform(table.where("uso is null"), keep=["id"])
    assert gaps.where("uso <> 0").isEmpty()

    new = table.drop("gasto")
    batch = score(spark, f"{tmp_path}/model", new)
    direct = result.artifact.score(new)
    assert batch.exceptAll(direct).isEmpty() and batch.count() == 420
    new.write.parquet(f"{tmp_path}/arriving")
    stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/arriving")
    query = write_scores(score_stream(spark, f"{tmp_path}/model", stream), f"{tmp_path}/scores", f"{tmp_path}/progress")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/scores").exceptAll(batch).isEmpty()
    with pytest.raises(ValueError, match="lacks columns"):
        score(spark, f"{tmp_path}/model", new.drop("codigo"))


@pytest.mark.parametrize("wish", [
    {"new": "x", "method": "nothing", "source": ["a"]}, {"new": "x", "method": "interact", "source": ["a"]},
    {"new": "a", "method": "str_len", "source": ["a"]}, {"new": "x", "method": "keyword", "source": ["a"]},
    {"new": "x", "method": "str_len", "source": ["z"]}, {"new": "x", "method": "ratio", "source": ["a"], "params": {"group_col": "z"}},
])
def test_wrong_wishes_are_named(spark, wish):
    with pytest.raises(ValueError, match="feature"):
        features.fit_features(spark.range(3).selectExpr("id as a", "id as b"), [wish])


@pytest.mark.parametrize("plan", [{"a": {"impute": "guess"}}, {"z": {"impute": "mean"}}, {"a": {"colour": "red"}}, {"t": {"scale": "robust"}}])
def test_wrong_plans_are_named(spark, plan):
    df = spark.range(60).selectExpr("id", "id * 1.5 as a", "element_at(array('x', 'y', 'z'), int(id % 3 + 1)) as t")
    with pytest.raises(ValueError, match="plan"):
        fit_preparation(df, None, ["id"], plan=plan)
