"""Neighbour, balancing, model and end-to-end queries."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.lineage import cut_lineage, shared_folder
from ..models import catalog, train
from ..models.cluster import bisecting_kmeans, explained_variance, kmeans, pca
from ..models.dbscan import dbscan
from ..models.iforest import isolation_forest
from ..models.neighbors import knn_classify, lof
from ..operators import balance as b
from ..operators import weights as w
from ..operators.knn import knn, recall_at
from ..operators.metrics import clustering_metrics
from ..operators.split import assign_folds, hash_split
from ..operators.vectors import squared_distance
from ..plans.preprocess import fit_preparation
from ..plans.run import run
from ..plans.score import score
from .base import duck_hash, labelled_documents, rounded, table

NUMBERS = ["n_chars", "n_blanks", "n_digits"]

# Forests and boosting are registered on one grid point outside model_ranking, which keeps the runs short; all
# other models run their whole grids, and every row takes part.
SHORT_GRIDS = {
    "RandomForestClassifier": {"n_estimators": [10], "max_depth": [5]},
    "GradientBoostingClassifier": {"n_estimators": [5], "learning_rate": [0.1], "max_depth": [3]},
    "RandomForestRegressor": {"n_estimators": [10], "max_depth": [5]},
    "GradientBoostingRegressor": {"n_estimators": [5], "learning_rate": [0.1], "max_depth": [3]},
}
FOLDS = 5


def _scaled_documents(spark, d):
    df = cut_lineage(labelled_documents(spark, d).select("doc_id", "toxic", *NUMBERS))
    prep = fit_preparation(df, "toxic", ["doc_id"], "toxic")
    return prep.transform(df, keep=["doc_id", "toxic"]), prep.features


def _training_table(spark, d, task: str):
    if task == "classification":
        df, features = _scaled_documents(spark, d)
        df = df.withColumn("label", F.col("toxic").cast("double"))
        df, key = assign_folds(df, "doc_id", "label", FOLDS), "doc_id"
    else:
        df, features = table(spark, d, "part").withColumn("name_length", F.length("p_name").cast("double")), ["p_size", "name_length"]
        df = assign_folds(df.withColumn("label", F.col("p_retailprice")), "p_partkey", None, FOLDS)
        key = "p_partkey"
    return VectorAssembler(inputCols=features, outputCol="features").transform(df).select(key, "features", "label", "fold"), key, features


def _trained(name: str, task: str):
    def query(spark, d):
        df, key, _ = _training_table(spark, d, task)
        found = train.cross_validate(df, catalog.specs(task, [name], SHORT_GRIDS), task, key, FOLDS)
        return train.cv_runs(spark, found).select("model", "params", "status", F.round("cv_mean", 3).alias("cv_mean"))

    return query


def linear_search(spark, d):
    """Fold scores of least squares and ridge over their grids, price on size, folds by key."""
    df = table(spark, d, "part").selectExpr("p_partkey", "double(p_size) as x", "double(p_retailprice) as label", "int(p_partkey % 5) as fold")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    found = train.cross_validate(df, catalog.specs("regression", ["LinearRegression", "Ridge"]), "regression", "p_partkey", FOLDS)
    return rounded(train.cv_runs(spark, found), 6)


def model_ranking(spark, d):
    df, key, _ = _training_table(spark, d, "regression")
    found = train.cross_validate(df, catalog.specs("regression"), "regression", key, FOLDS)
    return train.rank(spark, found).select("rank", "model", "best_params", "n_combos", "status")


def model_importance(spark, d):
    df, key, features = _training_table(spark, d, "classification")
    found = train.cross_validate(df, catalog.specs("classification", ["RandomForestClassifier"], SHORT_GRIDS), "classification", key, FOLDS)
    return train.feature_importance(spark, found[0].model, features)


def linear_fit(spark, d):
    """Least squares of the price on the quantity, against the closed form."""
    df = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("label"), F.col("l_quantity").alias("x"))
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    model = catalog.linear_regression(catalog.TrainingFacts.of(df)).fit(df)
    return spark.createDataFrame([(round(float(model.coefficients[0]), 5), round(float(model.intercept), 3))], "slope double, intercept double")


def ridge_fit(spark, d):
    df = table(spark, d, "part").select(F.col("p_retailprice").alias("label"), F.col("p_size").cast("double").alias("x"))
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    model = catalog.ridge(catalog.TrainingFacts.of(df), alpha=10.0).fit(df)
    return spark.createDataFrame([(round(float(model.coefficients[0]), 6), round(float(model.intercept), 4))], "slope double, intercept double")


def knn_exact(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(knn(e, e, "vec_id", "embedding", 5), 5).withColumnsRenamed({"key": "vec_id", "rank": "place"})


def knn_tags(spark, d):
    e = table(spark, d, "embeddings")
    near = knn(e, e, "vec_id", "embedding", 3, tag="label")
    return near.groupBy(F.col("key").alias("vec_id")).agg(F.count_if(F.col("tag") == F.col("neighbor_tag")).alias("same_label"))


def knn_approximate(spark, d):
    """The approximate search against the exact one: five rows a vector, their distances true, nine of ten found."""
    e = table(spark, d, "embeddings")
    near = cut_lineage(knn(e, e, "vec_id", "embedding", 5, vectors=True, exact=False))
    true = F.sqrt(squared_distance(F.col("x"), F.col("neighbor_x")))
    wrong = F.count_if(F.abs(F.col("distance") - true) > 1e-9)
    found = near.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key", "neighbor").alias("pairs"), wrong.alias("wrong"))
    return found.crossJoin(recall_at(near, e, e, "vec_id", "embedding", 5)).select("n", "pairs", "wrong", "queries", (F.col("recall") >= 0.9).alias("enough"))


def knn_vote(spark, d):
    e = table(spark, d, "embeddings")
    return knn_classify(e, e, "vec_id", "embedding", "label", 5, exclude_self=True).withColumnRenamed("key", "vec_id")


def knn_vote_distance(spark, d):
    e = table(spark, d, "embeddings")
    return knn_classify(e, e, "vec_id", "embedding", "label", 5, "distance", exclude_self=True).withColumnRenamed("key", "vec_id")


def lof_scores(spark, d):
    return rounded(lof(table(spark, d, "embeddings"), "vec_id", "embedding", 20), 5).withColumnRenamed("key", "vec_id")


def tomek_links(spark, d):
    return b.tomek_links(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


def enn_keep(spark, d):
    """Two uneven classes, so that some neighbourhoods agree."""
    e = table(spark, d, "embeddings").withColumn("side", (F.col("label") >= 2).cast("int"))
    return b.enn_keep(e, "vec_id", "embedding", "side").select("vec_id", "side")


def _balanced(sampler):
    def query(spark, d):
        df, features = _scaled_documents(spark, d)
        grown = sampler(df, "doc_id", features, "toxic")
        return grown.groupBy("toxic", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))

    return query


def balance_counts(spark, d):
    """Training rows by class, original and synthetic, and test rows, after oversampling the training part."""
    df, features = _scaled_documents(spark, d)
    df = cut_lineage(hash_split(df, "doc_id"))
    grown = b.smote(df.where("split = 'train'").drop("split"), "doc_id", features, "toxic")
    return w.balance_counts(grown, df.where("split = 'test'"), "toxic")


def kmeans_clusters(spark, d):
    return kmeans(table(spark, d, "embeddings"), "embedding")[0].select("vec_id", "cluster")


def bisecting_clusters(spark, d):
    return bisecting_kmeans(table(spark, d, "embeddings"), "embedding")[0].select("vec_id", "cluster")


def cluster_silhouette(spark, d):
    return clustering_metrics(table(spark, d, "embeddings"), "embedding", "label")


def dbscan_clusters(spark, d):
    """Clusters of part size and price."""
    df = table(spark, d, "part").selectExpr("p_partkey", "p_size / 50.0D as size", "(p_retailprice - 900) / 100 as price")
    return dbscan(df, "p_partkey", ["size", "price"], 0.05, 5)


def dbscan_embeddings(spark, d):
    return dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", EPS, 4).select(F.col("key").alias("vec_id"), "cluster")


def isolation_scores(spark, d):
    df = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("line"), "l_quantity", "l_extendedprice", "l_discount")
    return isolation_forest(df, "line", ["l_quantity", "l_extendedprice", "l_discount"], 100, 0.05)


def pca_variance(spark, d):
    return explained_variance(pca(table(spark, d, "embeddings"), "embedding", 0.9)[1], spark)


def pca_total(spark, d):
    """All components together carry the whole variance, and each carries its ratio of it."""
    out, ratios = pca(table(spark, d, "embeddings"), "embedding", 1.0)
    parts = out.select(F.posexplode(vector_to_array("components")).alias("i", "v")).groupBy("i").agg(F.var_samp("v").alias("v"))
    ratio = F.array(*[F.lit(r) for r in ratios])[F.col("i")]
    total = parts.agg(F.sum("v").alias("total_variance")).first()["total_variance"]
    return parts.agg(
        F.round(F.sum("v"), 6).alias("total_variance"), F.count_if(F.abs(F.col("v") - ratio * total) > 1e-9).alias("off")
    )


def silhouette(spark, d):
    found = clustering_metrics(table(spark, d, "embeddings"), "embedding", "label")
    return found.select(F.round("silhouette", 6).alias("silhouette"))


def _features(spark, d):
    return labelled_documents(spark, d).drop("quality")


def run_report(spark, d):
    """Dirty table to report."""
    config = RunConfig(grids=SHORT_GRIDS)
    return run(spark, _features(spark, d), "doc_id", "toxic", config=config, models=["LogisticRegression", "RandomForestClassifier"]).report


def run_scored(spark, d):
    config = RunConfig(grids=SHORT_GRIDS)
    return run(spark, table(spark, d, "part"), "p_partkey", "p_retailprice", config=config, models=["LinearRegression", "Ridge"]).scored


def run_dedup(spark, d):
    """What a run counts as removed: equal rows and rows without a target; rows that differ in their key stay."""
    part = table(spark, d, "part").withColumn("p_retailprice", F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")))
    dirty = part.unionByName(part.where("p_partkey % 7 = 0")).drop("p_name")
    result = run(spark, dirty, "p_partkey", "p_retailprice", config=RunConfig(), models=["LinearRegression"])
    kept = result.train.count() + result.test.count()
    return spark.createDataFrame(
        [(result.rows_in, result.duplicates_removed, result.null_targets_removed, kept)],
        "rows_in bigint, duplicates_removed bigint, null_targets_removed bigint, kept bigint",
    )


def score_saved(spark, d):
    """Train, store, load and score every document."""
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    config = RunConfig(grids=SHORT_GRIDS, output_dir=folder, save_model=True)
    df = _features(spark, d)
    run(spark, df, "doc_id", "toxic", config=config, models=["LogisticRegression", "RandomForestClassifier"])
    return score(spark, f"{folder}/model", df.drop("toxic"))


_D = "round(list_distance(a.embedding::double[], z.embedding::double[]), 9)"
NEAR = f"""(select a.vec_id, a.label, z.vec_id as neighbor, z.label as neighbor_label, list_distance(a.embedding::double[], z.embedding::double[]) as distance,
    row_number() over (partition by a.vec_id order by {_D}, z.vec_id) as place from embeddings a join embeddings z on a.vec_id <> z.vec_id)"""

EPS = 1.12

QUERIES = {
    "knn_exact": (knn_exact, f"select vec_id, neighbor, round(distance, 5) as distance, place::int as place from {NEAR} where place <= 5"),
    "knn_approximate": (knn_approximate, """select 5 * count(*) as n, 5 * count(*) as pairs, 0 as wrong, count(*) as queries, true as enough from embeddings"""),
    "knn_tags": (knn_tags, f"select vec_id, count(*) filter (where label = neighbor_label) as same_label from {NEAR} where place <= 3 group by 1"),
    "knn_vote": (knn_vote, f"""select vec_id, arg_min(c, (-n, c)) as prediction from (select vec_id, neighbor_label as c, count(*) as n from {NEAR}
      where place <= 5 group by 1, 2) group by 1"""),
    "knn_vote_distance": (knn_vote_distance, f"""select vec_id, arg_min(c, (-s, c)) as prediction from (select vec_id, neighbor_label as c, round(sum(1 / distance), 9) as s
      from {NEAR} where place <= 5 group by 1, 2) group by 1"""),
    "lof_scores": (lof_scores, f"""with n as materialized (select * from {NEAR} where place <= 20), k as (select vec_id, max(distance) as kd from n group by 1),
      r as (select n.vec_id, 1 / (avg(greatest(n.distance, k.kd)) + 1e-10) as lrd from n join k on k.vec_id = n.neighbor group by 1)
      select n.vec_id, round(avg(z.lrd) / any_value(r.lrd), 5) as lof, avg(z.lrd) / any_value(r.lrd) > 1.5 as is_outlier
      from n join r on r.vec_id = n.vec_id join r z on z.vec_id = n.neighbor group by 1"""),
    "tomek_links": (tomek_links, f"""with n as materialized (select a.vec_id, any_value(a.label) as label, min({{'d': {_D}, 'id': z.vec_id, 'label': z.label}}) as near
        from embeddings a join embeddings z on a.vec_id <> z.vec_id group by a.vec_id)
      select x.vec_id as a, x.near.id as b from n x join n y on y.vec_id = x.near.id and y.near.id = x.vec_id where x.label <> x.near.label and x.vec_id < x.near.id"""),
    "enn_keep": (enn_keep, f"""select vec_id, any_value((label >= 2)::int) as side from {NEAR} where place <= 3 group by 1
      having count(*) filter (where (label >= 2) <> (neighbor_label >= 2)) = 0"""),
    "linear_fit": (linear_fit, "select round(regr_slope(l_extendedprice, l_quantity), 5) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem"),
    "ridge_fit": (ridge_fit, """select round(s, 6) as slope, round(my - s * mx, 4) as intercept from (select avg(p_retailprice) as my, avg(p_size) as mx,
      covar_pop(p_retailprice, p_size) * count(*) / (var_pop(p_size) * count(*) + 10) as s from part)"""),
    **{f"train_{n}": (_trained(n, "classification"), None) for n in catalog.CLASSIFIERS},
    **{f"train_{n}": (_trained(n, "regression"), None) for n in catalog.REGRESSORS},
    "linear_search": (linear_search, """with s as (select p_partkey % 5 as f, count(*)::double as n, sum(x) as x, sum(y) as y, sum(x * x) as xx, sum(x * y) as xy, sum(y * y) as yy
        from (select p_partkey, p_size::double as x, p_retailprice::double as y from part) group by 1),
      p as (select 'LinearRegression' as model, '{}' as params, 0.0::double as alpha union all
        select 'Ridge', '{"alpha": ' || a || '}', a::double from (select unnest(['0.1', '1.0', '10.0']) as a)),
      r as (select f, (select sum(n) from s) - n as n, (select sum(x) from s) - x as x, (select sum(y) from s) - y as y,
        (select sum(xx) from s) - xx as xx, (select sum(xy) from s) - xy as xy from s),
      b as (select f, model, params, (xy - x * y / n) / (xx - x * x / n + alpha) as b, r.n, r.x, r.y from r cross join p),
      c as (select f, model, params, b, (y - b * x) / n as c from b),
      e as (select model, params, 1 - (yy + n * c * c + b * b * xx - 2 * c * y - 2 * b * xy + 2 * b * c * x) / (yy - y * y / n) as r2 from c join s using (f))
      select model, params, round(avg(r2), 6) as cv_mean, round(stddev_pop(r2), 6) as cv_std, 'ok' as status from e group by 1, 2"""),
    "model_ranking": (model_ranking, None),
    "model_importance": (model_importance, None),
    "smote": (_balanced(b.smote), """select toxic, is_synthetic, n from (select toxic, false as is_synthetic, count(*) as n from labels group by 1
      union all select toxic, true, (select max(n) from (select count(*) as n from labels group by toxic)) - count(*) from labels group by 1) where n > 0"""),
    "balance_counts": (balance_counts, f"""with a as (select toxic, {duck_hash('doc_id')} >= 2000 as train from labels),
      t as (select toxic, count(*) as n from a where train group by 1)
      select 'train' as split, toxic, false as is_synthetic, n from t
      union all select 'train', toxic, true, (select max(n) from t) - n from t where n < (select max(n) from t)
      union all select 'test', toxic, false, count(*) from a where not train group by toxic"""),
    "adasyn": (_balanced(b.adasyn), None),
    "smote_enn": (_balanced(b.smote_enn), None),
    "smote_tomek": (_balanced(b.smote_tomek), None),
    "kmeans_clusters": (kmeans_clusters, None),
    "bisecting_clusters": (bisecting_clusters, None),
    "cluster_silhouette": (cluster_silhouette, None),
    "dbscan_clusters": (dbscan_clusters, None),
    "dbscan_embeddings": (dbscan_embeddings, f"""with recursive near as materialized (select a.vec_id as a, z.vec_id as b from embeddings a join embeddings z on {_D} <= {EPS}),
      core as materialized (select a as id from near group by a having count(*) >= 4),
      reach(id, root) as (select id, id from core union select n.b, r.root from reach r join near n on n.a = r.id join core c on c.id = n.b where r.root < n.b),
      lowest as (select id, min(root) as root from reach group by id),
      numbered as (select root, row_number() over (order by root) - 1 as cluster from (select distinct root from lowest)),
      found as (select e.vec_id, coalesce(min(l.root) filter (l.id = e.vec_id), min(l.root)) as root from embeddings e
        left join near n on n.a = e.vec_id left join lowest l on l.id = n.b group by e.vec_id)
      select vec_id, coalesce(cluster, -1) as cluster from found left join numbered using (root)"""),
    "isolation_scores": (isolation_scores, None),
    "pca_variance": (pca_variance, None),
    "pca_total": (pca_total, """select round(sum(v), 6) as total_variance, 0 as off from (select i, var_samp(x) as v from (
      select unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings) group by i)"""),
    "silhouette": (silhouette, f"""with p as (select a.vec_id, a.label = z.label as same, z.label as other, count(*) as n,
      sum(list_distance(a.embedding::double[], z.embedding::double[]) ** 2) as s from embeddings a cross join embeddings z group by all),
      own as (select vec_id, s / (n - 1) as a, n from p where same), far as (select vec_id, min(s / n) as b from p where not same group by 1)
      select round(avg(case when n = 1 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from own join far using (vec_id)"""),
    "run_dedup": (run_dedup, """select count(*) + count(*) filter (where p_partkey % 7 = 0) as rows_in, count(*) filter (where p_partkey % 7 = 0) as duplicates_removed,
      count(*) filter (where p_partkey % 11 = 0) as null_targets_removed, count(*) filter (where p_partkey % 11 <> 0) as kept from part"""),
    "run_report": (run_report, None),
    "run_scored": (run_scored, None),
    "score_saved": (score_saved, None),
}
