"""Fitted-transform queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..functions.lookup import lookup
from ..operators import transform as tf
from ..operators.split import hash_split
from ..plans.features import apply_features, fit_features, load_features, save_features
from .base import DUCK_GAPPY_EVENTS, duck_hash, gappy_events, rounded, table

SCALED = ["l_quantity", "l_extendedprice", "l_discount"]
DAYS = ["l_orderkey", "l_linenumber", "cast(l_shipdate as timestamp) as shipped",
        "cast(l_shipdate as timestamp) + make_dt_interval(l_linenumber, 7, 30) as received",
        "case when l_orderkey % 17 = 0 then null else cast(l_shipdate as timestamp) end as promised"]
DUCK_DAYS = """select l_orderkey, l_linenumber, l_shipdate as shipped,
  l_shipdate + l_linenumber * interval 1 day + interval 7 hour + interval 30 minute as received,
  case when l_orderkey % 17 = 0 then null else l_shipdate end as promised from lineitem"""


def _impute(method, col="value"):
    def query(spark, d):
        df = gappy_events(spark, d).select("event_id", col)
        return rounded(tf.Imputer.fit(df, {col: method}).transform(df))

    return query


def encode_large_keys(spark, d):
    """Frequencies of two large keys, by the lookup that shuffles."""
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    for key, name in (("l_orderkey", "n_order"), ("l_partkey", "n_part")):
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        df = lookup(df, [key], counts, [name], weight=name, small_rows=0)
    return df


def missing_flags(spark, d):
    return tf.missing_flags(gappy_events(spark, d), ["value", "user_id", "event_type"]).drop("value")


def encode_label(spark, d):
    """A null takes part as the text ``nan``."""
    df = gappy_events(spark, d).select("event_id", "event_type")
    return tf.LabelEncode.fit(df, ["event_type"]).transform(df)


def encode_onehot(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return tf.OneHot.fit(df, ["c_mktsegment"]).transform(df)


def encode_target(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_retailprice")
    return rounded(tf.TargetEncode.fit(df, ["p_brand", "p_name"], "p_retailprice").transform(df).drop("p_retailprice"))


def encode_target_gaps(spark, d):
    """Events without a type get the global mean."""
    df = table(spark, d, "events").selectExpr("event_id", "case when event_id % 11 = 0 then null else event_type end as event_type", "value")
    return rounded(tf.TargetEncode.fit(df, ["event_type"], "value").transform(df).drop("value"))


def encode_frequency(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return tf.FrequencyEncode.fit(df, ["o_custkey"]).transform(df)


def _scale(method):
    def query(spark, d):
        df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *SCALED).withColumn("flat", F.lit(3.0))
        return rounded(tf.Scale.fit(df, [*SCALED, "flat"], method).transform(df))

    return query


def feat_log1p(spark, d):
    return rounded(tf.log1p_feature(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal"))


def feat_ratio(spark, d):
    """Event value over the mean of its user; a gap becomes 1."""
    df = gappy_events(spark, d).select("event_id", "user_id", "value")
    return rounded(tf.Ratio.fit(df, "value", "user_id", "value_ratio").transform(df).drop("value"))


def feat_interact(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return rounded(tf.interact(df, "l_extendedprice", "l_discount", "rebate").drop("l_extendedprice", "l_discount"))


def feat_str_len(spark, d):
    return tf.str_len(table(spark, d, "documents"), "text", "text_length").select("doc_id", "text_length")


def feat_keyword(spark, d):
    return tf.keyword(table(spark, d, "documents"), "text", "copyright|licen[cs]e", "legal").select("doc_id", "legal")


def feat_date_diff(spark, d):
    df = table(spark, d, "lineitem").selectExpr(*DAYS)
    late = tf.date_diff(df, "received", "promised", "days_late")
    return tf.date_diff(late, "shipped", "received", "days_back").select("l_orderkey", "l_linenumber", "days_late", "days_back")


def feat_bin(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    df = tf.Bin.fit(df, "p_size", 4, new="size_bin").transform(df)
    return tf.Bin.fit(df, "p_retailprice", 3, ["low", "middle", "high"], "price_bin").transform(df).drop("p_size", "p_retailprice")


def drop_columns(spark, d):
    return tf.drop_columns(table(spark, d, "customer"), ["c_name", "c_nationkey"])


def drop_near_zero_variance(spark, d):
    df = table(spark, d, "supplier").withColumn("flat", F.lit(7.0)).withColumn("tiny", F.col("s_suppkey") * 1e-9)
    return tf.drop_near_zero_variance(df)


def drop_constant(spark, d):
    df = table(spark, d, "supplier").withColumns({"same_text": F.lit("x"), "all_null": F.lit(None).cast("double")})
    return tf.drop_constant(df)


def encode_classes(spark, d):
    """Target classes to sorted codes and back."""
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    classes = tf.target_classes(df, "o_orderpriority")
    coded = tf.encode_target(df, "o_orderpriority", classes)
    return tf.decode_target(coded, "label", classes, "decoded")


def replay_fitted(spark, d):
    """Values fitted on the training part are replayed on the test part."""
    df = hash_split(gappy_events(spark, d), "event_id")
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    fill = tf.Imputer.fit(train, {"value": "mean"})
    scale = tf.Scale.fit(fill.transform(train), ["value"], "standard")
    freq = tf.FrequencyEncode.fit(train, ["event_type"])
    out = freq.transform(scale.transform(fill.transform(test)))
    return rounded(out.select("event_id", "value", "value_is_missing", "event_type"))


def replay_features(spark, d):
    """Derived columns fitted on the training part, stored, loaded and replayed on the test part."""
    df = hash_split(table(spark, d, "part"), "p_partkey")
    wanted = [
        {"new": "to_brand", "method": "ratio", "source": ["p_retailprice"], "params": {"group_col": "p_brand"}},
        {"new": "price_bin", "method": "bin", "source": ["p_retailprice"], "params": {"n_bins": 4}},
        {"new": "name_length", "method": "str_len", "source": ["p_name"]},
        {"new": "is_ring", "method": "keyword", "source": ["p_name"], "params": {"pattern": "RING"}},
        {"new": "weight", "method": "interact", "source": ["p_size", "price_bin"]},
        {"new": "log_price", "method": "log1p", "source": ["p_retailprice"]},
    ]
    made, _ = fit_features(df.where("split = 'train'"), wanted)
    folder = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    loaded = load_features(spark, save_features(made, folder), folder)
    out = apply_features(df.where("split = 'test'"), loaded)
    return rounded(out.select("p_partkey", *[f.new for f in loaded]))


def missing_totals(spark, d):
    """Share of gaps left after imputation, over several tables: none."""
    parts = []
    for method in ("mean", "median", "zero", "mode"):
        df = gappy_events(spark, d).select("event_id", "value")
        parts.append(tf.Imputer.fit(df, {"value": method}, flags=False).transform(df).agg(
            F.lit(method).alias("method"), F.count_if(F.col("value").isNull()).alias("gaps"), F.avg("value").alias("mean_value")))
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


GAPPY = f"({DUCK_GAPPY_EVENTS})"


def _impute_sql(value: str, col: str = "value", digits: str = "round({x}, 6)") -> str:
    filled = digits.format(x=f"coalesce({col}, {value})")
    return f"select event_id, {filled} as {col}, ({col} is null)::int as {col}_is_missing from {GAPPY}"


MODE = f"(select value from {GAPPY} where value is not null group by value order by count(*) desc, value limit 1)"
TYPE_MODE = f"(select event_type from {GAPPY} where event_type is not null group by event_type order by count(*) desc, event_type limit 1)"


def _scale_sql(center: str, width: str) -> str:
    fits = ", ".join(f"{center.format(c=c)} as a_{c}, {width.format(c=c)} as b_{c}" for c in SCALED)
    cols = ", ".join(f"round(({c} - a_{c}) / b_{c}, 6) as {c}" for c in SCALED)
    return f"select l_orderkey, l_linenumber, {cols}, 0.0::double as flat from lineitem, (select {fits} from lineitem)"


def _bin_sql(col: str, n: int) -> str:
    return (f"least({n - 1}, greatest(0, ceil(({col} - (select min({col}) from part)) / "
            f"(((select max({col}) from part) - (select min({col}) from part))::double / {n})) - 1))::int")


SEGMENTS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

QUERIES = {
    "impute_median": (_impute("median"), _impute_sql(f"(select quantile_cont(value, 0.5) from {GAPPY})")),
    "impute_mean": (_impute("mean"), _impute_sql(f"(select avg(value) from {GAPPY})")),
    "impute_zero": (_impute("zero"), _impute_sql("0")),
    "impute_mode": (_impute("mode"), _impute_sql(MODE)),
    "impute_mode_text": (_impute("mode", "event_type"), _impute_sql(TYPE_MODE, "event_type", "{x}")),
    "impute_drop": (_impute("drop"), f"select event_id, round(value, 6) as value from {GAPPY} where value is not null"),
    "impute_totals": (missing_totals, " union all ".join(
        f"select '{m}' as method, 0::bigint as gaps, round(avg(coalesce(value, {v})), 6) as mean_value from {GAPPY}" for m, v in (
            ("mean", f"(select avg(value) from {GAPPY})"), ("median", f"(select quantile_cont(value, 0.5) from {GAPPY})"),
            ("zero", "0"), ("mode", MODE)))),
    "missing_flags": (missing_flags, f"""select event_id, user_id, event_type, (value is null)::int as value_is_missing,
      (event_type is null)::int as event_type_is_missing from {GAPPY}"""),
    "encode_label": (encode_label, f"""select event_id, code::double as event_type from {GAPPY} e join (
      select v, row_number() over (order by v) - 1 as code from (select distinct coalesce(event_type, 'nan') as v from {GAPPY}))
      on v = coalesce(e.event_type, 'nan')"""),
    "encode_onehot": (encode_onehot, "select c_custkey, " + ", ".join(
        f"(c_mktsegment = '{s}')::int::double as \"c_mktsegment_{s}\"" for s in SEGMENTS) + " from customer"),
    "encode_target": (encode_target, """select p_partkey, round(b, 6) as p_brand, round(n, 6) as p_name from part
      join (select p_brand, avg(p_retailprice) as b from part group by 1) using (p_brand)
      join (select p_name, avg(p_retailprice) as n from part group by 1) using (p_name)"""),
    "encode_target_gaps": (encode_target_gaps, """with e as (select event_id, case when event_id % 11 = 0 then null else event_type end as event_type, value from events)
      select event_id, round(coalesce(m, (select avg(value) from e)), 6) as event_type from e
      left join (select event_type, avg(value) as m from e group by 1) using (event_type)"""),
    "encode_frequency": (encode_frequency, "select o_orderkey, (count(*) over (partition by o_custkey))::double as o_custkey from orders"),
    "encode_large_keys": (encode_large_keys, """select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_orderkey) as n_order,
      count(*) over (partition by l_partkey) as n_part from lineitem"""),
    "scale_standard": (_scale("standard"), _scale_sql("avg({c})", "stddev_pop({c})")),
    "scale_minmax": (_scale("minmax"), _scale_sql("min({c})", "(max({c}) - min({c}))")),
    "scale_robust": (_scale("robust"), _scale_sql("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))")),
    "feat_log1p": (feat_log1p, "select c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) as c_acctbal_log from customer"),
    "feat_ratio": (feat_ratio, f"""select event_id, user_id, round(coalesce(value / nullif(avg(value) over (partition by user_id), 0), 1), 6) as value_ratio
      from {GAPPY}"""),
    "feat_interact": (feat_interact, "select l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 6) as rebate from lineitem"),
    "feat_str_len": (feat_str_len, "select doc_id, length(text)::int as text_length from documents"),
    "feat_keyword": (feat_keyword, "select doc_id, regexp_matches(text, 'copyright|licen[cs]e', 'i')::int as legal from documents"),
    "feat_date_diff": (feat_date_diff, f"""select l_orderkey, l_linenumber,
      coalesce(floor((epoch_us(received) - epoch_us(promised)) / 86400000000.0), 0)::int as days_late,
      coalesce(floor((epoch_us(shipped) - epoch_us(received)) / 86400000000.0), 0)::int as days_back from ({DUCK_DAYS})"""),
    "feat_bin": (feat_bin, f"""select p_partkey, {_bin_sql('p_size', 4)} as size_bin,
      (['low', 'middle', 'high'])[{_bin_sql('p_retailprice', 3)} + 1] as price_bin from part"""),
    "drop_columns": (drop_columns, "select c_custkey, c_acctbal, c_mktsegment from customer"),
    "drop_near_zero_variance": (drop_near_zero_variance, "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier"),
    "drop_constant": (drop_constant, "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier"),
    "encode_classes": (encode_classes, """select o_orderkey, o_orderpriority, (dense_rank() over (order by o_orderpriority) - 1)::double as label,
      o_orderpriority as decoded from orders"""),
    "replay_features": (replay_features, f"""with p as (select *, {duck_hash('p_partkey')} < 2000 as test from part),
      m as (select p_brand, avg(p_retailprice) as mean from p where not test group by 1),
      b as (select min(p_retailprice) as low, (max(p_retailprice) - min(p_retailprice)) / 4 as width from p where not test),
      f as (select p_partkey, p_size, p_name, p_retailprice, p_brand, least(3, greatest(0, ceil((p_retailprice - low) / width)::int - 1)) as price_bin from p cross join b where test)
      select p_partkey, round(coalesce(p_retailprice / mean, 1), 6) as to_brand, price_bin, length(p_name) as name_length,
        (p_name ilike '%ring%')::int as is_ring, p_size * price_bin as weight, round(ln(1 + p_retailprice), 6) as log_price
      from f left join m using (p_brand)"""),
    "replay_fitted": (replay_fitted, f"""with e as (select *, {duck_hash('event_id')} < 2000 as test from {GAPPY}),
      m as (select avg(value) as mean from e where not test),
      s as (select avg(coalesce(value, mean)) as a, stddev_pop(coalesce(value, mean)) as b from e, m where not test),
      f as (select event_type as t, count(*)::double as n from e where not test and event_type is not null group by 1)
      select event_id, round((coalesce(value, mean) - a) / b, 6) as value, (value is null)::int as value_is_missing,
        coalesce(n, 0) as event_type from e cross join m cross join s left join f on t = event_type where test"""),
}
