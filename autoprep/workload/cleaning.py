"""Cleaning queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import clean as c
from ..operators.detect import detection_table
from ..operators.profile import duplicate_rows
from ..sources.tables import preview, read_table, write_predictions
from .base import (
    DUCK_DIRTY_ORDERS,
    dirty_orders,
    duck_date,
    duck_nulls,
    duck_number,
    rounded,
    table,
)

CURRENCY = duck_number(r"regexp_replace(money, '[$,]', '', 'g')")
GENDER = """case lower(trim(gender)) when 'm' then 'masculino' when 'male' then 'masculino' when 'h' then 'masculino'
    when 'masculino' then 'masculino' when 'f' then 'femenino' when 'female' then 'femenino'
    when 'mujer' then 'femenino' when 'femenino' then 'femenino' when 'nb' then 'otro'
    when 'no binario' then 'otro' when 'prefiero no decirlo' then 'otro' else gender end"""
FINITE = "case when isfinite(amount) then amount end"


def _percent_lines(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "case when l_orderkey % 10 < 7 then concat(format_number(l_discount * 100, 1), '%') "
        "else format_number(l_discount * 100, 1) end as rate",
    )


DUCK_PERCENT_LINES = """select l_orderkey, l_linenumber, case when l_orderkey % 10 < 7
    then format('{:.1f}%', l_discount * 100) else format('{:.1f}', l_discount * 100) end as rate from lineitem"""


def clean_null_tokens(spark, d):
    return c.normalize_nulls(dirty_orders(spark, d).select("o_orderkey", "priority"))


def clean_currency(spark, d):
    return rounded(c.parse_currency(dirty_orders(spark, d).select("o_orderkey", "money")))


def clean_percent(spark, d):
    return rounded(c.parse_percent(_percent_lines(spark, d)))


def clean_numeric_coerce(spark, d):
    events = table(spark, d, "events").selectExpr(
        "event_id", "case when event_id % 7 = 0 then concat('u', user_id) else cast(user_id as string) end as user_text"
    )
    return c.coerce_numeric(events)


def clean_booleans(spark, d):
    return c.bool_to_int(dirty_orders(spark, d).select("o_orderkey", "finished"))


def clean_infinities(spark, d):
    return rounded(c.inf_to_null(dirty_orders(spark, d).select("o_orderkey", "amount")))


def clean_negatives(spark, d):
    """Two percent negatives are masked."""
    return rounded(c.mask_rare_negatives(c.inf_to_null(dirty_orders(spark, d).select("o_orderkey", "amount")), ["amount"]))


def clean_negatives_kept(spark, d):
    """Account balances are negative too often to be mistakes."""
    return rounded(c.mask_rare_negatives(table(spark, d, "customer").select("c_custkey", "c_acctbal")))


def clean_categories(spark, d):
    return c.normalize_categories(dirty_orders(spark, d).select("o_orderkey", "gender"))


def dates_mixed_parse(spark, d):
    parsed = c.parse_dates(dirty_orders(spark, d).select("o_orderkey", "day_text"), ["day_text"])
    return parsed.select("o_orderkey", F.to_date("day_text").alias("day"))


def dates_expand(spark, d):
    return c.expand_dates(dirty_orders(spark, d).select("o_orderkey", "day_text"))


def detect_columns(spark, d):
    """The verdict per column of the dirty orders."""
    return detection_table(dirty_orders(spark, d)).withColumnRenamed("column", "column_name")


def detect_ids(spark, d):
    """Identifier columns of three tables."""
    found = [(t, x) for t in ("customer", "part", "supplier") for x in c.detect_ids(table(spark, d, t))]
    return spark.createDataFrame(found, "table_name string, column_name string")


def drop_ids(spark, d):
    return c.drop_ids(table(spark, d, "customer"))


def dedup_rows(spark, d):
    docs = c.dedup(table(spark, d, "documents").select("text", "lang"))
    return docs.select(F.md5("text").alias("text_md5"), "lang")


def dedup_count(spark, d):
    return duplicate_rows(table(spark, d, "documents").select("text", "lang"))


def outlier_bounds(spark, d):
    """Which columns have outliers worth capping, and their limits."""
    found = []
    for t, cols in (("documents", ["n_chars"]), ("events", ["value"]), ("lineitem", ["l_extendedprice", "l_quantity"])):
        found += [(t, x, *b) for x, b in c.outlier_bounds(table(spark, d, t).select(*cols)).items()]
    return rounded(spark.createDataFrame(found, "table_name string, column_name string, lower double, upper double"))


def outlier_cap(spark, d):
    return rounded(c.cap_outliers(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars"]))


def outlier_kept(spark, d):
    """Fewer than one percent of the event values are outliers, so they stay."""
    return rounded(c.cap_outliers(table(spark, d, "events").select("event_id", "value"), ["value"]))


def cleaning_log(spark, d):
    return c.cleaning_log(dirty_orders(spark, d)).withColumnRenamed("column", "column_name")


def quick_clean(spark, d):
    dirty = dirty_orders(spark, d).select("o_orderkey", "money", "amount", "gender")
    return rounded(c.quick_clean(dirty))


def clean_full(spark, d):
    return rounded(c.clean(dirty_orders(spark, d))[0])


def preview_rows(spark, d):
    """The first 100 orders; the limit is the feature."""
    return preview(table(spark, d, "orders").orderBy("o_orderkey").select("o_orderkey", "o_orderstatus"))


def _bounds_sql(t: str, col: str) -> str:
    return f"""select '{t}' as table_name, '{col}' as column_name, q1 - 3 * (q3 - q1) as lower, q3 + 3 * (q3 - q1) as upper
      from (select quantile_cont({col}, 0.25) q1, quantile_cont({col}, 0.75) q3 from {t}) q
      where q3 > q1 and (select avg(({col} < q1 - 3 * (q3 - q1) or {col} > q3 + 3 * (q3 - q1))::int) from {t}) > 0.01
        and (select avg(({col} < q1 - 3 * (q3 - q1) or {col} > q3 + 3 * (q3 - q1))::int) from {t}) < 0.10"""


def _expand_sql(source: str, name: str, others: str = "o_orderkey") -> str:
    return f"""select {others},
      coalesce(year(p)::double, quantile_cont(year(p), 0.5) over ()) as "{name}_año",
      coalesce(month(p)::double, quantile_cont(month(p), 0.5) over ()) as "{name}_mes",
      coalesce(day(p)::double, quantile_cont(day(p), 0.5) over ()) as "{name}_dia",
      coalesce((isodow(p) - 1)::double, 2.0) as "{name}_diasemana"
      from (select *, {duck_date(name)} as p from ({source}))"""


_SHARE = "count(*) filter (where regexp_matches({x}, '{p}')) * {n} >= count({x}) and count(*) filter (where regexp_matches({x}, '{p}')) > 0"

DETECT_SQL = f"""with o as ({DUCK_DIRTY_ORDERS}),
      t as (unpivot (select {duck_nulls('money')} as money, {duck_nulls('day_text')} as day_text,
              {duck_nulls('priority')} as priority, {duck_nulls('gender')} as gender, {duck_nulls('order_code')} as order_code from o)
            on money, day_text, priority, gender, order_code into name column_name value v),
      n as (select count(*) as n, count(*) filter (where isfinite(amount)) as amounts,
              count(*) filter (where {duck_nulls('priority')} is null) as tokens from o),
      f as (select column_name, count(v) as filled, count(distinct v) as u,
              {_SHARE.format(x='v', p='^[$]', n=20)} as dollar, {_SHARE.format(x='v', p='%$', n=20)} as pct,
              {_SHARE.format(x='v', p='[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}-[A-Za-z]{3}-[0-9]{4}', n=30)} as dated,
              count({duck_date('v')}) as dates, count({duck_number('v')}) / count(v) as numbers from t group by column_name)
      select column_name, 'text' as kind, case when dollar then 'currency' when pct then 'percent' when numbers >= 0.7 then 'number'
          when dated and dates > 0.4 * n then 'date' when dated then 'id' when u > 0.9 * n then 'id' when u < 0.5 * n then 'category'
          else 'text' end as rule, n as n_rows, filled, case when column_name = 'priority' then tokens else 0 end as tokens from f, n
      union all select 'o_orderkey', 'numeric', 'numeric', n, n, 0 from n
      union all select 'amount', 'numeric', 'numeric', n, amounts, 0 from n
      union all select 'finished', 'boolean', 'boolean', 0, 0, 0"""

def csv_round_trip(spark, d):
    """Orders written as CSV, with a quoted line break and null tokens, and read back."""
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}.csv"
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.concat_ws("\n", "o_orderstatus", "o_orderpriority").alias("note"),
        F.when(F.col("o_orderkey") % 7 == 0, "NA").otherwise(F.col("o_custkey").cast("string")).alias("owner"),
    )
    write_predictions(orders, path)
    back = read_table(spark, path)
    return back.select(*[F.col(c).cast("bigint").alias(c) if c in ("o_orderkey", "o_custkey") else F.col(c) for c in back.columns])


QUERIES = {
    "csv_round_trip": (csv_round_trip, """select o_orderkey, o_custkey, o_totalprice, o_orderstatus || chr(10) || o_orderpriority as note,
      case when o_orderkey % 7 <> 0 then o_custkey end::int as owner from orders"""),
    "clean_null_tokens": (clean_null_tokens, f"select o_orderkey, {duck_nulls('priority')} as priority from ({DUCK_DIRTY_ORDERS})"),
    "clean_currency": (clean_currency, f"""select o_orderkey, round({CURRENCY}, 6) as money from ({DUCK_DIRTY_ORDERS})
      where (select count(*) filter (where starts_with(money, '$')) * 20 >= count(money) from ({DUCK_DIRTY_ORDERS}))"""),
    "clean_percent": (clean_percent, f"""select l_orderkey, l_linenumber,
      round({duck_number("replace(rate, '%', '')")} / 100.0, 6) as rate from ({DUCK_PERCENT_LINES})"""),
    "clean_numeric_coerce": (clean_numeric_coerce, f"""select event_id, {duck_number('user_text')} as user_text from (
      select event_id, case when event_id % 7 = 0 then 'u' || user_id::varchar else user_id::varchar end as user_text from events)"""),
    "clean_booleans": (clean_booleans, "select o_orderkey, (o_orderstatus = 'F')::int as finished from orders"),
    "clean_infinities": (clean_infinities, f"select o_orderkey, round({FINITE}, 6) as amount from ({DUCK_DIRTY_ORDERS})"),
    "clean_negatives": (clean_negatives, f"""select o_orderkey, round(case when a < 0 and share < 0.05 then null else a end, 6) as amount
      from (select o_orderkey, {FINITE} as a, (select count(*) filter (where isfinite(amount) and amount < 0) / count(*)
        from ({DUCK_DIRTY_ORDERS})) as share from ({DUCK_DIRTY_ORDERS}))"""),
    "clean_negatives_kept": (clean_negatives_kept, """select c_custkey, round(case when c_acctbal < 0
      and (select count(*) filter (where c_acctbal < 0) / count(*) from customer) < 0.05 then null else c_acctbal end, 6) as c_acctbal
      from customer"""),
    "clean_categories": (clean_categories, f"select o_orderkey, {GENDER} as gender from ({DUCK_DIRTY_ORDERS})"),
    "dates_mixed_parse": (dates_mixed_parse, f"select o_orderkey, {duck_date('day_text')}::date as day from ({DUCK_DIRTY_ORDERS})"),
    "dates_expand": (dates_expand, _expand_sql(DUCK_DIRTY_ORDERS, "day_text")),
    "detect_columns": (detect_columns, DETECT_SQL),
    "detect_ids": (detect_ids, """select * from (
      select 'customer' as table_name, 'c_name' as column_name from customer having count(distinct c_name) > 0.9 * count(*)
      union all select 'customer', 'c_mktsegment' from customer having count(distinct c_mktsegment) > 0.9 * count(*)
      union all select 'part', 'p_name' from part having count(distinct p_name) > 0.9 * count(*)
      union all select 'part', 'p_brand' from part having count(distinct p_brand) > 0.9 * count(*)
      union all select 'supplier', 's_name' from supplier having count(distinct s_name) > 0.9 * count(*))"""),
    "drop_ids": (drop_ids, "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer"),
    "dedup_rows": (dedup_rows, "select md5(text) as text_md5, lang from (select distinct text, lang from documents)"),
    "dedup_count": (dedup_count, """select (select count(*) from documents) - count(*) as duplicated_rows
      from (select distinct text, lang from documents)"""),
    "outlier_bounds": (outlier_bounds, "select table_name, column_name, round(lower, 6) as lower, round(upper, 6) as upper from ("
      + " union all ".join(_bounds_sql(t, x) for t, x in (
          ("documents", "n_chars"), ("events", "value"), ("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"))) + ")"),
    "outlier_cap": (outlier_cap, f"""with b as ({_bounds_sql('documents', 'n_chars')})
      select doc_id, round(least(greatest(n_chars::double, lower), upper), 6) as n_chars from documents, b"""),
    "outlier_kept": (outlier_kept, f"""with b as ({_bounds_sql('events', 'value')})
      select event_id, round(coalesce(least(greatest(value, lower), upper), value), 6) as value from events left join b on true"""),
    "cleaning_log": (cleaning_log, f"""with v as ({DETECT_SQL})
      select column_name, case rule when 'currency' then 'parsed_currency' when 'percent' then 'parsed_pct'
        when 'number' then 'coerced_numeric' when 'date' then 'parsed_dates' when 'category' then 'normalized_cats'
        when 'id' then 'ids_detected' when 'boolean' then 'bools_converted' end as rule
      from v where rule not in ('numeric', 'text')
      union all select column_name, 'nulls_normalized' from v where kind = 'text' and tokens > 0
      union all select 'amount', 'inf_handled' from ({DUCK_DIRTY_ORDERS}) having count(*) filter (where isinf(amount)) > 0"""),
    "quick_clean": (quick_clean, f"""select o_orderkey, round({CURRENCY}, 6) as money,
      round(case when {FINITE} < 0 then null else {FINITE} end, 6) as amount, gender from ({DUCK_DIRTY_ORDERS})"""),
    "clean_full": (clean_full, f"""with o as ({DUCK_DIRTY_ORDERS}), e as ({_expand_sql('select * from o', 'day_text', '*')})
      select o_orderkey, round({CURRENCY}, 6) as money, "day_text_año", "day_text_mes", "day_text_dia", "day_text_diasemana",
        {duck_nulls('priority')} as priority, round(case when {FINITE} < 0 then null else {FINITE} end, 6) as amount,
        {GENDER} as gender, order_code, finished::int as finished from e"""),
    "preview_rows": (preview_rows, "select o_orderkey, o_orderstatus from orders order by o_orderkey limit 100"),
}
