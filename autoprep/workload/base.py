"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not decide about equality."""
    return df.select(*[
        (F.round(col_of(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else col_of(f.name)
        for f in df.schema.fields
    ])


def share_sql(part: str, whole: str, digits: int, times: int = 1) -> str:
    """``times * part / whole`` of two counts, rounded half to even from the counts."""
    top = f"(({part}) * {times * 10**digits})"
    left = f"2 * ({top} % ({whole}))"
    up = f"case when {left} > ({whole}) or ({left} = ({whole}) and {top} // ({whole}) % 2 = 1) then 1 else 0 end"
    return f"(({top} // ({whole}) + {up})::double / {10**digits})"


# Dirty views of the clean tables: the same values in Spark and in the SQL of the check.
SPARK_DIRTY_ORDERS = [
    "o_orderkey",
    "case when o_orderkey % 10 < 6 then concat('$', format_number(o_totalprice, 2)) "
    "else format_number(o_totalprice, 2) end as money",
    "case when o_orderkey % 9 = 0 then 'sin fecha' else case o_orderkey % 4 "
    "when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'dd/MM/yyyy') "
    "when 2 then date_format(o_orderdate, 'yyyy/MM/dd') else date_format(o_orderdate, 'dd-MMM-yyyy') end end as day_text",
    "case when o_orderkey % 20 = 0 then 'N/A' when o_orderkey % 20 = 1 then '?' else o_orderpriority end as priority",
    "case when o_orderkey % 50 = 0 then double('Infinity') when o_orderkey % 50 = 1 then null "
    "when o_orderkey % 50 = 2 then -o_totalprice else o_totalprice end as amount",
    "element_at(array('M', 'Male', 'male', 'F', 'Female', 'NB', 'otro'), cast(o_custkey % 7 as int) + 1) as gender",
    "concat('order-', o_orderkey) as order_code",
    "o_orderstatus = 'F' as finished",
]
DUCK_DIRTY_ORDERS = """
  select o_orderkey,
    case when o_orderkey % 10 < 6 then format('${:,.2f}', o_totalprice) else format('{:,.2f}', o_totalprice) end as money,
    case when o_orderkey % 9 = 0 then 'sin fecha' else case o_orderkey % 4
      when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d/%m/%Y')
      when 2 then strftime(o_orderdate, '%Y/%m/%d') else strftime(o_orderdate, '%d-%b-%Y') end end as day_text,
    case when o_orderkey % 20 = 0 then 'N/A' when o_orderkey % 20 = 1 then '?' else o_orderpriority end as priority,
    case when o_orderkey % 50 = 0 then 'Infinity'::double when o_orderkey % 50 = 1 then null
      when o_orderkey % 50 = 2 then -o_totalprice else o_totalprice end as amount,
    (['M', 'Male', 'male', 'F', 'Female', 'NB', 'otro'])[(o_custkey % 7)::int + 1] as gender,
    'order-' || o_orderkey::varchar as order_code,
    o_orderstatus = 'F' as finished
  from orders"""

SPARK_GAPPY_EVENTS = [
    "event_id", "user_id",
    "case when event_id % 13 = 0 then null else value end as value",
    "case when event_id % 11 = 0 then null else event_type end as event_type",
]
DUCK_GAPPY_EVENTS = """
  select event_id, user_id, case when event_id % 13 = 0 then null else value end as value,
    case when event_id % 11 = 0 then null else event_type end as event_type
  from events"""


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(*SPARK_DIRTY_ORDERS)


def gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*SPARK_GAPPY_EVENTS)


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with numeric and text features of their documents."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        F.length(F.regexp_replace("text", "[^ ]", "")).cast("double").alias("n_blanks"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("n_digits"),
    )
    return table(spark, folder, "labels").join(docs, "doc_id")


# A plain decimal literal, as the safe conversion reads it.
NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def duck_number(x: str) -> str:
    return f"case when regexp_matches(trim({x}), {NUMBER}) then try_cast(trim({x}) as double) end"


def duck_nulls(x: str) -> str:
    return f"case when lower(trim({x})) in ('n/a','na','null','none','?','-','--','nan','') then null else {x} end"


def duck_date(x: str) -> str:
    formats = "['%Y-%m-%d','%d/%m/%Y','%Y/%m/%d','%d-%b-%Y','%m/%d/%Y','%Y%m%d']"
    return f"try_strptime(trim({x}), {formats})"


def duck_hash(key: str, seed: int = 42, buckets: int = 10_000) -> str:
    return f"(('0x' || substr(md5({key}::varchar || '|{seed}'), 1, 8))::bigint % {buckets})"
