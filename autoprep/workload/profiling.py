"""Profiling and decision-rule queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import profile as p
from ..plans import recommend as rec
from ..sources.tables import describe_schema
from .base import DUCK_GAPPY_EVENTS, gappy_events, labelled_documents, rounded, share_sql, table

# Column names and kinds of the profiled tables, as the SQL side needs them.
LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
DOCUMENTS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
EVENTS = {"event_id": "bigint", "user_id": "bigint", "value": "double", "event_type": "string"}
PART = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")
TARGETS = (("labels", "toxic"), ("labels", "quality"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"),
           ("customer", "c_mktsegment"), ("events", "event_type"), ("part", "p_size"))


def _profile(df, target=None):
    """Means are decimal fractions that may lie midway between two roundings, where the engines
    differ; a nudge takes them off the midpoint."""
    out = p.profile_columns(df, target).withColumnRenamed("column", "column_name")
    out = rounded(out.withColumns({"mean_value": F.col("mean_value") + F.lit(1e-9)}))
    return out.drop("is_target", "min_ts", "max_ts", "position")


def profile_lineitem(spark, d):
    return _profile(table(spark, d, "lineitem"))


def profile_documents(spark, d):
    return _profile(table(spark, d, "documents"))


def profile_events(spark, d):
    """With gaps in two columns."""
    return _profile(gappy_events(spark, d))


def profile_part(spark, d):
    return _profile(table(spark, d, "part"), "p_retailprice")


def profile_tables(spark, d):
    rows = [p.profile_table(table(spark, d, t)).withColumn("table_name", F.lit(t)) for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), rows).select("table_name", "n_rows", "n_columns")


def profile_nulls(spark, d):
    out = p.profile_columns(gappy_events(spark, d))
    return out.select(F.col("column").alias("column_name"), "nulls", "null_pct")


def profile_dates(spark, d):
    out = p.profile_columns(table(spark, d, "orders").select("o_orderdate"))
    return out.select(F.col("column").alias("column_name"), "min_ts", "max_ts")


def schema_listing(spark, d):
    return describe_schema(gappy_events(spark, d)).withColumnRenamed("column", "column_name")


def role_flags(spark, d):
    out = p.profile_columns(gappy_events(spark, d), "event_type")
    return out.select(F.col("column").alias("column_name"), "is_numeric_role", "is_categorical_role", "is_high_cardinality", "is_high_null")


def value_counts_top(spark, d):
    return p.value_counts(table(spark, d, "lineitem")).withColumnRenamed("column", "column_name")


def value_counts_chosen(spark, d):
    """The 20 most frequent values of named columns, however many there are."""
    return p.value_counts(table(spark, d, "part"), ["p_name", "p_brand"]).withColumnRenamed("column", "column_name")


def _pair_table(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("n_chars", F.length("text").alias("text_length"), "doc_id")


def corr_matrix(spark, d):
    return rounded(p.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]))


def corr_matrix_gaps(spark, d):
    """Every pair uses the rows where both of its columns are filled."""
    return rounded(p.correlations(gappy_events(spark, d).withColumn("double_value", F.col("value") * 2 + F.col("user_id")),
                                  ["user_id", "value", "double_value"]))


def corr_high_pairs(spark, d):
    return p.high_corr_pairs(p.correlations(_pair_table(spark, d), ["n_chars", "text_length", "doc_id"]))


def corr_low_pairs(spark, d):
    """Key and price correlate by one half, below the limit: no rows."""
    return p.high_corr_pairs(p.correlations(table(spark, d, "part"), ["p_partkey", "p_retailprice"]))


def target_profiles(spark, d):
    """Majority, concentration, balance and remedy of class targets."""
    rows = [p.target_profile(table(spark, d, t), c).select(
        "name", "n_rows", "unique_count", "majority_value", "majority_count", "minority_count", "majority_pct",
        "concentration_level", "task_type", "high_cardinality_warning", "balance_ratio", "balance_level",
        "balance_strategy", "use_weighted_metrics", "sentinel_majority") for t, c in TARGETS]
    return reduce(lambda a, b: a.unionByName(b), rows)


def target_regression(spark, d):
    return rounded(p.target_profile(table(spark, d, "lineitem"), "l_extendedprice").select(
        "name", "unique_count", "task_type", "min_value", "max_value", "mean_value", "std_value", "p25", "p50", "p75"))


def target_distribution(spark, d):
    rows = [p.target_distribution(table(spark, d, t), c).withColumn("name", F.lit(c)) for t, c in TARGETS]
    return reduce(lambda a, b: a.unionByName(b), rows)


def target_top_values(spark, d):
    return p.target_top_values(table(spark, d, "lineitem"), "l_extendedprice")


def target_from_features(spark, d):
    """The target analysed on the joined training table."""
    return p.target_profile(labelled_documents(spark, d), "toxic").select("name", "n_rows", "balance_ratio", "balance_level")


def plan_columns(spark, d):
    """All column decisions of the documents table in one query."""
    return rounded(rec.recommend_columns(p.profile_columns(table(spark, d, "documents")))).withColumnRenamed("column", "column_name").drop("position")


def plan_impute(spark, d):
    return rec.recommend_impute(p.profile_columns(gappy_events(spark, d))).withColumnRenamed("column", "column_name")


def plan_encode(spark, d):
    parts = [rec.recommend_encode(p.profile_columns(table(spark, d, t))).withColumn("table_name", F.lit(t)) for t in ("part", "documents", "customer")]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumnRenamed("column", "column_name")


def plan_log1p(spark, d):
    return rec.recommend_log1p(p.profile_columns(table(spark, d, "documents"))).withColumnRenamed("column", "column_name")


def plan_scale(spark, d):
    return rec.recommend_scale(p.profile_columns(table(spark, d, "documents"))).withColumnRenamed("column", "column_name")


def plan_task(spark, d):
    """A forced regression on an imbalanced two-value target becomes classification."""
    rows = [rec.recommend_task(p.target_profile(table(spark, d, t), c), "regression").select("name", "task") for t, c in TARGETS]
    return reduce(lambda a, b: a.unionByName(b), rows)


def plan_balance(spark, d):
    rows = [rec.recommend_balance(p.target_profile(table(spark, d, t), c)).select("name", "task", "minority_count", "balance") for t, c in TARGETS]
    return reduce(lambda a, b: a.unionByName(b), rows)


def plan_weighting(spark, d):
    """A regression target of which 90 percent are zero gets inverse-frequency weights."""
    sparse = table(spark, d, "lineitem").selectExpr("case when l_orderkey % 10 < 9 then 0 else l_extendedprice end as amount")
    return rec.recommend_weighting(p.target_profile(sparse, "amount"))


def _column_sql(source: str, name: str, kind: str, target: str = "") -> str:
    """Profile of one column: the same formulas, written for the SQL engine."""
    number = kind in ("bigint", "int", "double")
    base = "numeric" if number else "categorical" if kind == "string" else "datetime"
    stats = (f"""min({name})::double as min_value, max({name})::double as max_value, round(avg({name}) + 1e-9, 6) as mean_value,
        round(stddev_samp({name}), 6) as std_value, case when count({name}) >= 3 then round(skewness({name}), 6) end as skew_value"""
             if number else ", ".join(f"null::double as {c}" for c in ("min_value", "max_value", "mean_value", "std_value", "skew_value")))
    free = "false" if name == target else "true"
    return f"""select '{name}' as column_name, '{kind}' as dtype, n_rows, nulls, unique_count, min_value, max_value, mean_value, std_value, skew_value,
        null_pct, cardinality_ratio, type, {free} and type in ('numeric', 'categorical_numeric') as is_numeric_role,
        {free} and type = 'categorical' as is_categorical_role, {free} and cardinality_ratio > 0.5 as is_high_cardinality,
        {free} and null_pct > 50 as is_high_null
      from (select *, {share_sql("nulls", "n_rows", 2, 100)} as null_pct, {share_sql("unique_count", "n_rows", 4)} as cardinality_ratio,
          case when '{base}' = 'numeric' and unique_count <= 10 then 'categorical_numeric' else '{base}' end as type
        from (select count(*) as n_rows, count(*) - count({name}) as nulls, count(distinct {name}) as unique_count, {stats} from {source}))"""


def _profile_sql(source: str, columns: dict, target: str = "") -> str:
    return " union all ".join(_column_sql(source, c, k, target) for c, k in columns.items())


GAPPY = f"({DUCK_GAPPY_EVENTS})"
EVENTS_SQL = _profile_sql(GAPPY, EVENTS)
DOCUMENTS_SQL = _profile_sql("documents", DOCUMENTS)


def _target_sql(t: str, c: str) -> str:
    numeric = c in ("toxic", "quality", "p_size")
    return f"""select '{c}' as name, *, case when ratio is null then null when ratio >= 0.8 then 'balanced' when ratio >= 0.5 then 'mild'
        when ratio >= 0.2 then 'moderate' when ratio >= 0.1 then 'severe' else 'extreme' end as balance_level
      from (select *, case when task_type = 'classification' then minority_count / majority_count end as ratio
        from (select sum(n)::bigint as n_rows, count(v) as unique_count, max(n) filter (where v is not null) as majority_count,
            min(n) filter (where v is not null) as minority_count, arg_min(v, (-n, v))::varchar as majority_value,
            case when {str(numeric).lower()} and count(v) > 15 then 'regression' else 'classification' end as task_type
          from (select {c} as v, count(*) as n from {t} group by 1)))"""


TARGET_SQL = " union all ".join(f"select * from ({_target_sql(t, c)})" for t, c in TARGETS)
IMBALANCED = "(balance_level is not null and balance_level not in ('balanced', 'mild'))"


def _corr_sql(source: str, cols: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return " union all ".join(f"select '{a}' as col1, '{b}' as col2, round(corr({a}, {b}), 6) as r from {source}" for a, b in pairs)


def _high_sql(source: str, cols: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    body = " union all ".join(f"select '{a}' as col1, '{b}' as col2, corr({a}, {b}) as r from {source}" for a, b in pairs)
    return f"select col1, col2, round_even(abs(r), 3)::double as correlation from ({body}) where abs(r) > 0.8"


def _counts_sql(source: str, cols: list[str]) -> str:
    body = " union all ".join(f"select '{c}' as column_name, {c}::varchar as value, count(*) as n from {source} where {c} is not null group by 2" for c in cols)
    return f"""select column_name, value, n, rank::int as rank from (select *, row_number() over (partition by column_name order by n desc, value) as rank
      from ({body})) where rank <= 20"""


def _few_values_sql(source: str, columns: dict) -> str:
    """Value counts of the columns with at most 10 (numeric) or 20 (text) values."""
    body = " union all ".join(
        f"select '{c}' as column_name, {c}::varchar as value, count(*) as n, {20 if kind == 'string' else 10} as most from {source} where {c} is not null group by 2"
        for c, kind in columns.items())
    return f"""select column_name, value, n, (row_number() over (partition by column_name order by n desc, value))::int as rank
      from (select *, count(*) over (partition by column_name) as k from ({body})) where k <= most"""


QUERIES = {
    "profile_lineitem": (profile_lineitem, _profile_sql("lineitem", LINEITEM)),
    "profile_documents": (profile_documents, DOCUMENTS_SQL),
    "profile_events": (profile_events, EVENTS_SQL),
    "profile_part": (profile_part, _profile_sql("part", PART, "p_retailprice")),
    "profile_tables": (profile_tables, " union all ".join(
        f"select '{t}' as table_name, count(*) as n_rows, (select count(*) from (describe {t}))::int as n_columns from {t}" for t in TABLES)),
    "profile_nulls": (profile_nulls, f"select column_name, nulls, null_pct from ({EVENTS_SQL})"),
    "profile_dates": (profile_dates, """select 'o_orderdate' as column_name, min(o_orderdate)::varchar as min_ts,
      max(o_orderdate)::varchar as max_ts from orders"""),
    "schema_listing": (schema_listing, f"""select column_name, dtype, n_rows - nulls as non_null, nulls, null_pct, unique_count
      from ({EVENTS_SQL})"""),
    "role_flags": (role_flags, f"""select column_name, is_numeric_role, is_categorical_role, is_high_cardinality, is_high_null
      from ({_profile_sql(GAPPY, EVENTS, 'event_type')})"""),
    "value_counts_top": (value_counts_top, _few_values_sql(
        "lineitem", {c: k for c, k in LINEITEM.items() if k != "timestamp_ntz"})),
    "value_counts_chosen": (value_counts_chosen, _counts_sql("part", ["p_name", "p_brand"])),
    "corr_matrix": (corr_matrix, _corr_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])),
    "corr_matrix_gaps": (corr_matrix_gaps, _corr_sql(
        f"(select *, value * 2 + user_id as double_value from {GAPPY})", ["user_id", "value", "double_value"])),
    "corr_high_pairs": (corr_high_pairs, _high_sql("(select n_chars, length(text) as text_length, doc_id from documents)", ["n_chars", "text_length", "doc_id"])),
    "corr_low_pairs": (corr_low_pairs, _high_sql("part", ["p_partkey", "p_retailprice"])),
    "target_profiles": (target_profiles, f"""select name, n_rows, unique_count, majority_value, majority_count, minority_count,
        pct as majority_pct, case when pct > 80 then 'extreme' when pct > 60 then 'severe' when pct > 40 then 'moderate' else 'normal' end
          as concentration_level, task_type, task_type = 'classification' and unique_count >= 15 as high_cardinality_warning,
        case when ratio is not null then {share_sql("minority_count", "majority_count", 4)} end as balance_ratio, balance_level, case balance_level when 'balanced' then 'none' when 'mild' then 'class_weight'
          when 'moderate' then 'smote' when 'severe' then 'smote_enn' when 'extreme' then 'adasyn' end as balance_strategy,
        balance_level <> 'balanced' as use_weighted_metrics,
        pct > 60 and majority_value in ('0', '0.0', '-1', 'NaN', 'None', '') as sentinel_majority
      from (select *, {share_sql("majority_count", "n_rows", 2, 100)} as pct from ({TARGET_SQL}))"""),
    "target_regression": (target_regression, """select 'l_extendedprice' as name, count(distinct l_extendedprice) as unique_count, 'regression' as task_type,
      min(l_extendedprice) as min_value, max(l_extendedprice) as max_value, round(avg(l_extendedprice), 6) as mean_value,
      round(stddev_samp(l_extendedprice), 6) as std_value, round(quantile_cont(l_extendedprice, 0.25), 6) as p25,
      round(quantile_cont(l_extendedprice, 0.5), 6) as p50, round(quantile_cont(l_extendedprice, 0.75), 6) as p75 from lineitem"""),
    "target_distribution": (target_distribution, " union all ".join(
        f"""select '{c}' as name, {c}::varchar as value, count(*) as n, {share_sql('count(*)', f'select count(*) from {t}', 2, 100)} as pct
          from {t} where {c} is not null group by 2""" for t, c in TARGETS)),
    "target_top_values": (target_top_values, """select l_extendedprice::varchar as value, count(*) as n from lineitem
      group by l_extendedprice order by n desc, l_extendedprice limit 5"""),
    "target_from_features": (target_from_features, f"""select name, n_rows, case when ratio is not null then {share_sql("minority_count", "majority_count", 4)} end as balance_ratio, balance_level
      from ({_target_sql('labels join documents using (doc_id)', 'toxic')})"""),
    "plan_columns": (plan_columns, f"""select column_name, type, null_pct, unique_count, skew_value,
        case when is_numeric_role then case when null_pct = 0 then 'none' when null_pct > 50 then 'drop'
          when abs(coalesce(skew_value, 0)) > 1 then 'median' else 'mean' end end as impute,
        case when is_categorical_role then case when is_high_cardinality and unique_count > 50 then 'drop' when unique_count <= 2 then 'label'
          when unique_count <= 10 then 'onehot' else 'target' end end as encode,
        case when is_numeric_role then abs(coalesce(skew_value, 0)) > 2 and min_value >= 0 and not is_high_null end as log1p,
        case when is_numeric_role then case when is_high_null then 'none' when abs(coalesce(skew_value, 0)) > 2 then 'robust' else 'standard' end end
          as scale from ({DOCUMENTS_SQL})"""),
    "plan_impute": (plan_impute, f"""select column_name, case when null_pct = 0 then 'none' when null_pct > 50 then 'drop'
      when abs(coalesce(skew_value, 0)) > 1 then 'median' else 'mean' end as impute from ({EVENTS_SQL}) where is_numeric_role"""),
    "plan_encode": (plan_encode, f"""select table_name, column_name, case when is_high_cardinality and unique_count > 50 then 'drop'
      when unique_count <= 2 then 'label' when unique_count <= 10 then 'onehot' else 'target' end as encode from (
        select 'part' as table_name, * from ({_profile_sql('part', PART)}) union all select 'documents', * from ({DOCUMENTS_SQL})
        union all select 'customer', * from ({_profile_sql('customer', {'c_name': 'string', 'c_mktsegment': 'string'})})) where is_categorical_role"""),
    "plan_log1p": (plan_log1p, f"""select column_name, abs(coalesce(skew_value, 0)) > 2 and min_value >= 0 and not is_high_null as log1p
      from ({DOCUMENTS_SQL}) where is_numeric_role"""),
    "plan_scale": (plan_scale, f"""select column_name, case when is_high_null then 'none' when abs(coalesce(skew_value, 0)) > 2 then 'robust'
      else 'standard' end as scale from ({DOCUMENTS_SQL}) where is_numeric_role"""),
    "plan_task": (plan_task, f"""select name, case when unique_count <= 15 and {IMBALANCED} then 'classification' else 'regression' end as task
      from ({TARGET_SQL})"""),
    "plan_balance": (plan_balance, f"""select name, task_type as task, minority_count, case when task_type <> 'classification' or not {IMBALANCED} then 'none'
      when minority_count < 2 then 'class_weight' when minority_count < 6 then 'smote' when balance_level = 'extreme' then 'adasyn'
      when balance_level = 'severe' then 'smote_enn' else 'smote' end as balance from ({TARGET_SQL})"""),
    "plan_weighting": (plan_weighting, """select 'amount' as name, 'regression' as task, case when pct > 80 then 'extreme' when pct > 60 then 'severe'
        when pct > 40 then 'moderate' else 'normal' end as concentration_level, case when pct > 60 then 'inverse_frequency' else 'none' end as weighting
      from (select max(n) * 100.0 / sum(n) as pct from (select case when l_orderkey % 10 < 9 then 0 else l_extendedprice end as v, count(*) as n
        from lineitem group by 1))"""),
}
