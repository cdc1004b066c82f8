"""Split, fold, weight, ensemble and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models.ensemble import ensemble_hard_vote, ensemble_mean, ensemble_vote
from ..operators import metrics as m
from ..operators import split as sp
from ..operators import weights as w
from ..operators.transform import decode_target
from ..plans.score import scored
from .base import duck_hash, labelled_documents, rounded, table

# Deterministic predictions of three simple rules, so that every metric has an exact answer.
CLASS_RULES = {
    "p0": "cast(n_chars > 1200 as int)", "p1": "cast(doc_id % 5 = 0 as int)",
    "p2": "cast(doc_id % 3 = 0 or n_chars > 4000 as int)",
}
PRICE_RULES = {"p0": "l_quantity * 2000.0", "p1": "l_quantity * 1500.0 + 12000.0", "p2": "53000.0 + l_discount * 100"}
LEVEL_RULES = {"p0": "doc_id % 3", "p1": "cast(n_chars as bigint) % 3", "p2": "cast(n_chars > 1500 as int) * 2"}
DUCK_DOCS = "(select doc_id, quality, toxic, lang, source, n_chars::double as n_chars from labels join documents using (doc_id))"


def _predicted(spark, d):
    df = labelled_documents(spark, d)
    return df.select("doc_id", "quality", "toxic", *[F.expr(e).cast("double").alias(k) for k, e in CLASS_RULES.items()])


def _priced(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", *[F.expr(e).alias(k) for k, e in PRICE_RULES.items()])


def _levels(spark, d):
    return labelled_documents(spark, d).select("doc_id", *[F.expr(e).cast("double").alias(k) for k, e in LEVEL_RULES.items()])


def split_hash(spark, d):
    return sp.hash_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


def split_stratified(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return sp.stratified_split(df, "o_orderkey", "o_orderstatus")


def split_shares(spark, d):
    """Rows per class and part of the rare toxic label."""
    out = sp.stratified_split(table(spark, d, "labels"), "doc_id", "toxic")
    return out.groupBy("toxic", "split").agg(F.count(F.lit(1)).alias("n"))


def fold_stratified(spark, d):
    return sp.assign_folds(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


def fold_plain(spark, d):
    return sp.assign_folds(table(spark, d, "part").select("p_partkey"), "p_partkey")


def class_weights(spark, d):
    return rounded(w.class_weights(table(spark, d, "labels").select("doc_id", "toxic"), "toxic"))


def inverse_frequency_weights(spark, d):
    return rounded(w.inverse_frequency_weights(table(spark, d, "part").select("p_partkey", "p_size"), "p_size"))


def balance_log(spark, d):
    df = sp.hash_split(table(spark, d, "orders"), "o_orderkey")
    return w.balance_log(df, df.where("split = 'train'"), "class_weight")


def ensemble_regression(spark, d):
    out = ensemble_mean(_priced(spark, d), ["p0", "p1", "p2"], [0.6, 0.3, -0.1])
    return rounded(out.select("l_orderkey", "l_linenumber", "ensemble"), 4)


def ensemble_weighted_vote(spark, d):
    return ensemble_vote(_levels(spark, d), ["p0", "p1", "p2"], [0.9, 0.8, 0.5]).select("doc_id", "ensemble")


def ensemble_code_mean(spark, d):
    return ensemble_vote(_predicted(spark, d), ["p0", "p1", "p2"], [0.9, 0.8, 0.5], "code_mean").select("doc_id", "ensemble")


def ensemble_majority(spark, d):
    return ensemble_hard_vote(_levels(spark, d), ["p0", "p1", "p2"]).select("doc_id", "ensemble")


def metrics_classification(spark, d):
    return rounded(m.classification_metrics(_predicted(spark, d), "toxic", "p0", None))


def metrics_multiclass(spark, d):
    return rounded(m.classification_metrics(_levels(spark, d), "p0", "p1", None))


def metrics_auc(spark, d):
    return rounded(m.binary_auc(_predicted(spark, d), "toxic", "p0", None))


def metrics_regression(spark, d):
    return rounded(m.regression_metrics(_priced(spark, d), "l_extendedprice", "p1", None), 4)


def metrics_clustering(spark, d):
    """Davies-Bouldin and Calinski-Harabasz of the given embedding labels."""
    return rounded(m.clustering_metrics(table(spark, d, "embeddings"), "embedding", "label", silhouette=False).drop("silhouette"))


def scored_classes(spark, d):
    df = _predicted(spark, d)
    names = ["clean", "toxic"]
    df = decode_target(decode_target(df, "toxic", names, "y"), "p0", names, "p")
    return scored(df, "y", "p", "classification", ["doc_id"])


def scored_regression(spark, d):
    return rounded(scored(_priced(spark, d), "l_extendedprice", "p1", "regression", ["l_orderkey", "l_linenumber"]), 4)


def _class_sql(source: str, y: str, p: str) -> str:
    return f"""with c as (select y, p, count(*) as n from (select ({y})::double as y, ({p})::double as p from {source}) group by 1, 2),
      k as (select distinct y as cls from c union select distinct p from c),
      s as (select cls, coalesce((select sum(n) from c where y = cls), 0) as support, coalesce((select sum(n) from c where p = cls), 0) as predicted,
        coalesce((select sum(n) from c where y = cls and p = cls), 0) as hit from k)
      select round(sum(hit) / sum(support), 6) as accuracy,
        round(sum(support * case when support + predicted > 0 then 2.0::double * hit / (support + predicted) else 0 end) / sum(support), 6) as f1_weighted,
        round(sum(support * case when predicted > 0 then hit / predicted else 0 end) / sum(support), 6) as precision_weighted,
        round(sum(support * case when support > 0 then hit / support else 0 end) / sum(support), 6) as recall_weighted from s"""


def _cuts_sql(t: str, key: str, label: str, k: int) -> str:
    h = duck_hash(key, buckets=sp.BUCKETS)
    probs = ", ".join(f"quantile_cont(h, {i / k}) as q{i}" for i in range(1, k))
    passed = " + ".join(f"(h > q{i})::int" for i in range(1, k))
    return f"""with a as (select {key}, {label}, {h} as h from {t}), q as (select {label}, {probs} from a group by 1)
      select {key}, {label}, ({passed})::int as fold from a join q using ({label})"""


_STRATA = f"""with a as (select *, {{h}} as h from {{t}}), q as (select {{y}} as y, quantile_cont(h, 0.2) as cut from a group by 1)"""


def _strata(t: str, key: str, y: str) -> str:
    return _STRATA.format(h=duck_hash(key, buckets=sp.BUCKETS), t=t, y=y)


VOTES = """(select doc_id, c, sum(w) as s from (select doc_id, (doc_id % 3)::double as c, {0} as w from {docs}
      union all select doc_id, (n_chars::bigint % 3)::double, {1} from {docs}
      union all select doc_id, ((n_chars > 1500)::int * 2)::double, {2} from {docs}) group by 1, 2)"""
PICK = "select doc_id, arg_min(c, (-round(s, 9), c)) as ensemble from {votes} group by doc_id"

QUERIES = {
    "split_hash": (split_hash, f"select o_orderkey, case when {duck_hash('o_orderkey')} < 2000 then 'test' else 'train' end as split from orders"),
    "split_stratified": (split_stratified, _strata("orders", "o_orderkey", "o_orderstatus")
      + " select o_orderkey, o_orderstatus, case when h <= cut then 'test' else 'train' end as split from a join q on y = o_orderstatus"),
    "split_shares": (split_shares, _strata("labels", "doc_id", "toxic")
      + " select toxic, case when h <= cut then 'test' else 'train' end as split, count(*) as n from a join q on y = toxic group by 1, 2"),
    "fold_stratified": (fold_stratified, _cuts_sql("labels", "doc_id", "toxic", 5)),
    "fold_plain": (fold_plain, f"select p_partkey, ({duck_hash('p_partkey', buckets=sp.BUCKETS)} % 5)::int as fold from part"),
    "class_weights": (class_weights, """select doc_id, toxic, round((select count(*) from labels) /
      ((select count(distinct toxic) from labels) * (count(*) over (partition by toxic)))::double, 6) as weight from labels"""),
    "inverse_frequency_weights": (inverse_frequency_weights, """select p_partkey, p_size, round(x / avg(x) over (), 6) as weight
      from (select *, 1.0::double / (count(*) over (partition by p_size)) as x from part)"""),
    "balance_log": (balance_log, f"""select 'class_weight' as strategy, count(*) as original_size,
      count(*) filter (where {duck_hash('o_orderkey')} >= 2000) as balanced_size from orders"""),
    "ensemble_regression": (ensemble_regression, """select l_orderkey, l_linenumber, round(0.6 / 0.8 * (l_quantity * 2000) + 0.3 / 0.8 * (l_quantity * 1500 + 12000)
      - 0.1 / 0.8 * (53000 + l_discount * 100), 4) as ensemble from lineitem"""),
    "ensemble_weighted_vote": (ensemble_weighted_vote, PICK.format(votes=VOTES.format(0.9, 0.8, 0.5, docs=DUCK_DOCS))),
    "ensemble_code_mean": (ensemble_code_mean, f"""select doc_id, round_even((0.9 * (n_chars > 1200)::int + 0.8 * (doc_id % 5 = 0)::int
      + 0.5 * (doc_id % 3 = 0 or n_chars > 4000)::int)::double / 2.2, 0)::double as ensemble from {DUCK_DOCS}"""),
    "ensemble_majority": (ensemble_majority, PICK.format(votes=VOTES.format(1, 1, 1, docs=DUCK_DOCS))),
    "metrics_classification": (metrics_classification, _class_sql(DUCK_DOCS, "toxic", "(n_chars > 1200)::int")),
    "metrics_multiclass": (metrics_multiclass, _class_sql(DUCK_DOCS, "doc_id % 3", "n_chars::bigint % 3")),
    "metrics_auc": (metrics_auc, f"""select round((count(*) filter (where toxic = 1 and n_chars > 1200) / count(*) filter (where toxic = 1)
      + count(*) filter (where toxic = 0 and n_chars <= 1200) / count(*) filter (where toxic = 0)) / 2, 6) as roc_auc from {DUCK_DOCS}"""),
    "metrics_regression": (metrics_regression, """select round(1 - avg(e * e) / var_pop(y), 4) as r2, round(avg(e * e), 4) as mse,
      round(avg(abs(e)), 4) as mae, round(sqrt(avg(e * e)), 4) as rmse
      from (select l_extendedprice as y, l_extendedprice - (l_quantity * 1500 + 12000) as e from lineitem)"""),
    "metrics_clustering": (metrics_clustering, """with p as (select vec_id, label, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings),
      c as (select label, i, avg(x) as m from p group by 1, 2), g as (select i, avg(x) as m from p group by 1),
      d as (select vec_id, label, sum((x - m) ** 2) as d2 from p join c using (label, i) group by 1, 2),
      s as (select label, avg(sqrt(d2)) as scatter, sum(d2) as within, count(*) as n from d group by 1),
      b as (select label, sum((c.m - g.m) ** 2) as far from c join g using (i) group by 1),
      r as (select a.label, max((sa.scatter + sz.scatter) / dist) as worst from (
          select x.label, z.label as other, sqrt(sum((x.m - z.m) ** 2)) as dist from c x join c z on x.i = z.i and x.label <> z.label group by 1, 2) a
        join s sa on sa.label = a.label join s sz on sz.label = a.other group by 1)
      select (select round(avg(worst), 6) from r) as davies_bouldin,
        round((sum(n * far) * (sum(n) - count(*))) / (sum(within) * (count(*) - 1)), 6) as calinski_harabasz from s join b using (label)"""),
    "scored_classes": (scored_classes, f"""select doc_id, (['clean', 'toxic'])[toxic + 1] as actual, (['clean', 'toxic'])[(n_chars > 1200)::int + 1] as prediccion,
      toxic = (n_chars > 1200)::int as correcto from {DUCK_DOCS}"""),
    "scored_regression": (scored_regression, """select l_orderkey, l_linenumber, round(l_extendedprice, 4) as actual, round(l_quantity * 1500 + 12000, 4) as prediccion,
      round(abs(l_extendedprice - (l_quantity * 1500 + 12000)), 4) as error_abs from lineitem"""),
}
