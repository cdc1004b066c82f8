import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from autoprep.models import boost, catalog, gram, train
from autoprep.models.cluster import bisecting_kmeans, kmeans, pca
from autoprep.operators.metrics import classification_metrics, clustering_metrics, regression_metrics
from autoprep.operators.split import assign_folds
from autoprep.workload import models as workload


def ready(spark, x, y, weight=None, folds=3, stratify=True):
    cols = [f"f{i}" for i in range(x.shape[1])]
    w = weight if weight is not None else np.ones(len(x))
    df = spark.createDataFrame(
        [(i, *map(float, row), float(y[i]), float(w[i])) for i, row in enumerate(x)],
        "id bigint, " + ", ".join(f"{c} double" for c in cols) + ", label double, weight double")
    df = assign_folds(df.coalesce(1), "id", "label" if stratify else None, folds)
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df).select("id", "features", "label", "weight", "fold").cache()


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(300, 3))
    return ready(spark, x, (1.5 * x[:, 0] + 1.2 * x[:, 1] - 0.5 * x[:, 2] > 0).astype(float))


def test_forest_learns_the_signal(spark, signal):
    grid = {"RandomForestClassifier": {"n_estimators": [30], "max_depth": [5, None]}, "LogisticRegression": {"C": [1.0]}}
    found = train.ranked(train.cross_validate(signal, catalog.specs("classification", list(grid), grid), "classification", "id", 3))
    scores = {t.name: t.cv_mean for t in found}
    assert scores["LogisticRegression"] > 0.9 and scores["RandomForestClassifier"] > 0.85
    table = train.rank(spark, found).collect()
    assert [r["cv_mean"] for r in table] == sorted((r["cv_mean"] for r in table), reverse=True)
    assert max(r[2] for t in found for r in t.runs) == table[0]["cv_mean"]
    importance = train.feature_importance(spark, found[0].model, ["f0", "f1", "f2"]).collect()
    assert len(importance) == 3 and importance[0]["importance"] >= importance[-1]["importance"]


def test_neighbour_vote_in_the_search(signal):
    grid = {"KNeighborsClassifier": {"n_neighbors": [5], "weights": ["uniform"]}}
    found = train.cross_validate(signal, catalog.specs("classification", ["KNeighborsClassifier"], grid), "classification", "id", 3)
    assert found[0].cv_mean > 0.8


def test_one_search_a_fold_answers_all_points(signal, monkeypatch):
    searches, search = [], train.labelled_neighbors
    monkeypatch.setattr(train, "labelled_neighbors", lambda *a: searches.append(a) or search(*a))
    found = train.cross_validate(signal, catalog.specs("classification", ["KNeighborsClassifier"]), "classification", "id", 3)[0]
    assert len(searches) == 3 and len(found.runs) == 6 and found.status == "ok"
    one, two = signal.where("fold <> 1"), signal.where("fold = 1")
    points = catalog.specs("classification", ["KNeighborsClassifier"])[0].points()
    alone = [train._evaluator("classification").evaluate(train.KnnModel(one, "id", **p).transform(two)) for p in points]
    assert train._vote_scores(points, one, two, "id", train._evaluator("classification")) == pytest.approx(alone)


def test_fits_read_rows_dealt_over_tasks(signal, monkeypatch):
    """The signal comes as one partition; a fit sees even ones that do not depend on where the rows lay."""
    monkeypatch.setattr(train, "TASK_ROWS", 50)
    seen = []
    monkeypatch.setattr(train, "_facts", lambda data, *a, facts=train._facts: seen.append(data) or facts(data, *a))
    grid = {"RandomForestClassifier": {"n_estimators": [3], "max_depth": [3]}}
    scores = []
    for df in (signal, signal.repartition(7)):
        scores.append(train.cross_validate(df, catalog.specs("classification", list(grid), grid), "classification", "id", 3)[0].cv_mean)
        sizes = [r["count"] for r in seen[-1].groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 6 and max(sizes) < 100
    assert scores[0] == scores[1]


def test_a_failing_point_is_reported(signal):
    grid = {"RandomForestClassifier": {"n_estimators": [5], "max_depth": [99]}, "LogisticRegression": {"C": [1.0]}}
    found = train.ranked(train.cross_validate(signal, catalog.specs("classification", list(grid), grid), "classification", "id", 3))
    assert found[0].name == "LogisticRegression" and found[1].status.startswith("failed") and found[1].model is None


def test_noise_has_no_fit(spark):
    rng = np.random.default_rng(0)
    df = ready(spark, rng.normal(size=(200, 2)), rng.normal(size=200), stratify=False)
    grid = {"LinearRegression": {}, "Ridge": {"alpha": [1.0]}, "GradientBoostingRegressor": {"n_estimators": [5], "learning_rate": [0.1], "max_depth": [3]},
            "robust_linear": {"C": [1.0]}}
    for t in train.cross_validate(df, catalog.specs("regression", list(grid), grid), "regression", "id", 3):
        assert t.status == "ok" and -1 < t.cv_mean < 0.1


def test_three_classes(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, (40, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    df = ready(spark, x, np.repeat([0, 1, 2], 40))
    for make, point in ((catalog.gbt_classifier, {"n_estimators": 2, "max_depth": 2}), (catalog.linear_svc, {"C": 1.0})):
        model = make(catalog.TrainingFacts.of(df), **point).fit(df)
        assert train.test_scores(model, df, "classification")["accuracy"] > 0.9
        assert train.feature_importance(spark, model, ["f0", "f1"]).count() == 2


@pytest.mark.parametrize("weighted", [False, True])
def test_ridge_solves_the_normal_equations(spark, weighted):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(80, 3)) * [1, 5, 0.2], rng.uniform(0.5, 3, 80) if weighted else np.ones(80)
    y = x @ [2.0, -1.0, 4.0] + 3 + rng.normal(size=80)
    df = ready(spark, x, y, w, stratify=False)
    model = catalog.ridge(catalog.TrainingFacts.of(df, weight="weight" if weighted else None), alpha=10.0).fit(df)
    xc, yc = x - (w @ x) / w.sum(), y - (w @ y) / w.sum()
    exact = np.linalg.solve((xc * w[:, None]).T @ xc + 10 * np.eye(3), (xc * w[:, None]).T @ yc)
    assert model.coefficients.toArray() == pytest.approx(exact, rel=1e-6)


@pytest.mark.parametrize("weighted", [False, True])
def test_sums_score_like_refits(spark, weighted, monkeypatch):
    """Solved and refitted searches agree."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3)) * [3, 1, 0.2] + [5, 0, -1]
    y = x @ [0.7, -1.0, 4.0] + rng.normal(size=150) + 50
    df = ready(spark, x, y, rng.uniform(0.5, 3, 150), stratify=False)
    models = catalog.specs("regression", ["LinearRegression", "Ridge"])
    weight = "weight" if weighted else None
    solved = train.cross_validate(df, models, "regression", "id", 3, weight)
    monkeypatch.setattr(gram, "solvable", lambda *a: False)
    refitted = train.cross_validate(df, models, "regression", "id", 3, weight)
    for a, b in zip(solved, refitted):
        assert a.best_params == b.best_params and len(a.runs) == len(b.runs)
        assert [r[2] for r in a.runs] == pytest.approx([r[2] for r in b.runs], abs=1e-6)
        assert [r[3] for r in a.runs] == pytest.approx([r[3] for r in b.runs], abs=1e-6)


def test_sums_solve_the_normal_equations(spark):
    """Features of very different sizes far from zero, one of them constant, and weights."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=200) * 1e4 + 1e6, rng.normal(size=200) * 1e-3, np.full(200, 7.0)])
    y, w = 2e-4 * x[:, 0] + 900 * x[:, 1] + rng.normal(size=200), rng.uniform(0.5, 3, 200)
    df = ready(spark, x, y, w, stratify=False)
    fold = np.array([r["fold"] for r in df.orderBy("id").select("fold").collect()])
    got = gram.fold_scores(gram.fold_sums(df, "weight"), [{"alpha": a} for a in (0.0, 0.1, 10.0)], 3)
    for i, alpha in enumerate((0.0, 0.1, 10.0)):
        for f in range(3):
            a, b = fold != f, fold == f
            v = w[a] / w[a].sum()
            xc, yc = x[a][:, :2] - v @ x[a][:, :2], y[a] - v @ y[a]
            beta = np.linalg.solve((xc * w[a, None]).T @ xc + alpha * np.eye(2), (xc * w[a, None]).T @ yc)
            error = y[b] - (v @ y[a] + (x[b][:, :2] - v @ x[a][:, :2]) @ beta)
            assert got[i][f] == pytest.approx(1 - (error @ error) / ((y[b] - y[b].mean()) ** 2).sum(), abs=1e-8)


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup())


def test_points_of_linear_models_cost_no_jobs(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(100, 2))
    df, spent = ready(spark, x, x[:, 0] + rng.normal(size=100), stratify=False), []
    for alphas in ([1.0], [0.1, 1.0, 10.0, 100.0]):
        before = jobs(spark)
        train.cross_validate(df, catalog.specs("regression", ["Ridge"], {"Ridge": {"alpha": alphas}}), "regression", "id", 3)
        spent.append(jobs(spark) - before)
    assert spent[0] == spent[1] < 12


def test_sums_of_odd_folds(spark):
    df = ready(spark, np.zeros((6, 1)), np.arange(6.0), stratify=False).withColumn("fold", F.lit(0)).cache()
    assert gram.fold_scores(gram.fold_sums(df), [{}], 2) is None and gram.fold_sums(df.limit(0)) is None
    assert gram.r2(gram.fold_sums(df)[0][1], gram.solve(gram.fold_sums(df)[0][0])) == pytest.approx(0.0)


@pytest.mark.parametrize("weighted", [False, True])
def test_logistic_penalty(spark, weighted):
    """The gradient of the summed loss plus half the squared norm vanishes at the fit."""
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(120, 2)), rng.uniform(0.5, 3, 120) if weighted else np.ones(120)
    y = (x[:, 0] + rng.normal(size=120) > 0).astype(float)
    df = ready(spark, x, y, w)
    model = catalog.logistic(catalog.TrainingFacts.of(df, weight="weight" if weighted else None), C=0.5).fit(df)
    beta = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ beta + model.intercept)))
    assert np.abs(beta + 0.5 * x.T @ (w * (p - y))).max() < 1e-2


def test_components_match_the_covariance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) * [4, 2, 1, 0.1] + 5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    out, ratios = pca(df, "x", 0.9)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1] / np.trace(np.cov(x.T))
    assert len(ratios) == np.argmax(np.cumsum(values) >= 0.9) + 1 and ratios == pytest.approx(values[: len(ratios)].tolist())
    first = np.array([r["components"][0] for r in out.orderBy("id").collect()])
    assert abs(first.mean()) < 1e-9 and first.var(ddof=1) == pytest.approx(np.linalg.eigvalsh(np.cov(x.T))[-1])


def test_clusterings_pick_k(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.2, (30, 2)) for c in ((0, 0), (4, 0), (0, 4), (4, 4))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    for make in (kmeans, bisecting_kmeans):
        out, runs = make(df, "x", [3, 4, 5])
        assert max(runs, key=lambda r: r[1])[0] == 4 and out.select("cluster").distinct().count() == 4
    row = clustering_metrics(kmeans(df, "x", [4])[0], "x", "cluster").first()
    assert row["silhouette"] > 0.9 and row["davies_bouldin"] < 0.3 and row["calinski_harabasz"] > 500


def test_metric_tables(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 1), (2, 0)], "y int, p int")
    row = classification_metrics(df, "y", "p").first()
    assert (row["accuracy"], row["recall_weighted"]) == (0.6, 0.6)
    assert row["precision_weighted"] == pytest.approx(0.6) and row["f1_weighted"] == pytest.approx(0.5333)
    exact = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    row = regression_metrics(exact, "y", "p").first()
    assert row["mse"] == pytest.approx(0.4167) and row["r2"] == pytest.approx(0.7321) and row["mae"] == 0.5
    assert regression_metrics(exact.withColumn("y", F.lit(1.0)), "y", "p").first()["r2"] is None


def test_first_rounds_score_like_fits_of_their_own(signal, monkeypatch):
    """One boost a fold answers all numbers of rounds, exactly as separate fits do; a number that cannot be fitted fails alone."""
    grid = {"GradientBoostingRegressor": {"n_estimators": [3, 0, 6], "learning_rate": [0.1, 0.5], "max_depth": [2]}}
    models, fits, fit = catalog.specs("regression", list(grid), grid), [], train._fit
    monkeypatch.setattr(boost, "VALUES", 10)
    monkeypatch.setattr(train, "_fit", lambda spec, point, *a: fits.append(point) or fit(spec, point, *a))
    shared = train.cross_validate(signal, models, "regression", "id", 3, "weight")[0]
    assert [p["n_estimators"] for p in fits].count(6) >= 6 and 3 not in [p["n_estimators"] for p in fits[:-1]]
    monkeypatch.setattr(train, "_groups", lambda spec, points: [[i] for i in range(len(points))])
    alone = train.cross_validate(signal, models, "regression", "id", 3, "weight")[0]
    assert shared.best_params == alone.best_params and len(shared.runs) == 6
    assert [r[:4] for r in shared.runs] == [r[:4] for r in alone.runs]
    assert [r[4][:6] for r in shared.runs] == [r[4][:6] for r in alone.runs] == ["ok", "ok", "failed", "failed", "ok", "ok"]


def test_model_ranking_searches_whole_grids(spark, data, monkeypatch):
    seen = []
    monkeypatch.setattr(train, "cross_validate", lambda df, models, task, key, folds: seen.append((df.count(), models, folds)) or [])
    workload.model_ranking(spark, data)
    rows, models, folds = seen[0]
    assert rows == spark.read.parquet(f"{data}/part.parquet").count() and folds == 5
    assert {m.name: m.grid for m in models} == {n: catalog.GRIDS[n] for n in list(catalog.REGRESSORS)[:4]}
    assert [len(m.points()) for m in models] == [1, 3, 9, 8]


@pytest.mark.parametrize("weighted", [False, True])
def test_boosts_of_sums_score_like_refits(spark, weighted, monkeypatch):
    """Few values, many values, zeros and a constant; a point that cannot be fitted fails alone."""
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.integers(-3, 4, 1500), rng.normal(size=1500) * 100, rng.integers(0, 60, 1500), np.full(1500, 2.0)]).astype(float)
    y = np.sin(x[:, 0]) + x[:, 1] / 80 + (x[:, 2] > 30) + rng.normal(size=1500) * 0.3 + 20
    df = ready(spark, x, y, rng.uniform(0.5, 3, 1500), stratify=False)
    grid = {"GradientBoostingRegressor": {"n_estimators": [1, 8, 0], "learning_rate": [0.1, 0.4], "max_depth": [0, 1, 3]}}
    models, weight = catalog.specs("regression", list(grid), grid), "weight" if weighted else None
    solved = train.cross_validate(df, models, "regression", "id", 3, weight)[0]
    monkeypatch.setattr(boost, "solvable", lambda *a: False)
    refitted = train.cross_validate(df, models, "regression", "id", 3, weight)[0]
    assert solved.best_params == refitted.best_params and len(solved.runs) == 18 and solved.cv_mean > 0.8
    for a, b in zip(solved.runs, refitted.runs):
        assert a[:2] == b[:2] and a[4][:6] == b[4][:6] == ("failed" if '"n_estimators": 0' in a[1] else "ok")
        assert a[2:4] == (None, None) == b[2:4] or a[2:4] == pytest.approx(b[2:4], abs=1e-9)


def test_boosted_points_cost_no_jobs(spark, signal):
    spent = []
    for rounds in ([2], [2, 4, 40]):
        before = jobs(spark)
        got = boost.fold_scores(signal, [{"n_estimators": n, "max_depth": d} for n in rounds for d in (2, 3)], 3)
        spent.append(jobs(spark) - before)
        assert len(got) == 2 * len(rounds) and all(len(s) == 3 for s in got.values())
    assert max(spent) < 20 and abs(spent[0] - spent[1]) < 3
    assert boost.fold_scores(signal, [{"n_estimators": 2}], 4) == {} == boost.fold_scores(signal.limit(0), [{}], 3)
