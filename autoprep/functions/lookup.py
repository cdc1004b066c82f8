"""Left lookup of a fitted dictionary that stays even when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SMALL_DICTIONARY_ROWS
from .columns import col_of, is_text
from .lineage import cut_lineage

HOT_KEYS = 1_000
LONG_KEY_BYTES = 256


def small_copy(table: DataFrame, keys: list[str], limit: int = SMALL_DICTIONARY_ROWS) -> DataFrame | None:
    """The table as a local relation when it has at most ``limit`` rows with short keys, else None.

    At most ``limit + 1`` rows reach the driver and long text keys are blanked before they do,
    so the copy is bounded before anything is moved.
    """
    long_key = F.lit(False)
    safe = []
    for c in table.columns:
        if c in keys and is_text(table.schema[c].dataType):
            too_long = F.coalesce(F.octet_length(col_of(c)) > LONG_KEY_BYTES, F.lit(False))
            long_key = long_key | too_long
            safe.append(F.when(~too_long, col_of(c)).alias(c))
        else:
            safe.append(col_of(c))
    rows = table.select(*safe, long_key.alias("__long")).limit(limit + 1).collect()
    if len(rows) > limit or any(r["__long"] for r in rows):
        return None
    return table.sparkSession.createDataFrame([tuple(r)[:-1] for r in rows], table.schema)


def lookup(
    df: DataFrame,
    keys: list[str],
    table: DataFrame,
    values: list[str],
    weight: str | None = None,
    small_rows: int = SMALL_DICTIONARY_ROWS,
) -> DataFrame:
    """Append ``values`` of ``table`` (one row per key) to every row of ``df``, null when absent.

    A table with at most ``small_rows`` rows is broadcast; the size is checked, never assumed.
    A larger one is written once and joined once. The ``HOT_KEYS`` keys with the highest ``weight``
    (rows per key) are answered by a bounded broadcast of digests; their rows, like rows with a
    null key, get a salt by their position, so they spread over the join's tasks and match nothing
    there. Key and salt are one column, so that the optimiser cannot take the dictionary's constant
    salt out of the shuffle. Any key left to it holds less than one in ``HOT_KEYS`` of the rows.
    """
    clash = set(values) & set(df.columns)
    if clash:
        raise ValueError(f"the table already has {sorted(clash)}")
    small = small_copy(table.select(*[col_of(c) for c in [*keys, *values]]), keys, small_rows)
    if small is not None:
        return df.join(F.broadcast(small), keys, "left").select(
            *[col_of(c) for c in df.columns], *[col_of(v) for v in values]
        )

    table = cut_lineage(table.select(*[col_of(c) for c in dict.fromkeys([*keys, *values, *([weight] if weight else [])])]))
    found = F.struct(*[col_of(v) for v in values])
    left, unanswered, answers = df, F.lit(True), []
    for k in keys:
        unanswered = unanswered & col_of(k).isNotNull()
    if weight:
        hot = table.orderBy(col_of(weight).desc(), *[col_of(k) for k in keys]).limit(HOT_KEYS)
        digests = [f"__digest{i}" for i in range(len(keys))]
        hot = hot.select(*[_digest(table, k).alias(d) for k, d in zip(keys, digests)], found.alias("__hot"))
        left = df.select("*", *[_digest(df, k).alias(d) for k, d in zip(keys, digests)]).join(F.broadcast(hot), digests, "left").drop(*digests)
        unanswered = unanswered & F.col("__hot").isNull()
        answers.append("__hot")
    salt = F.when(unanswered, 0).otherwise(F.monotonically_increasing_id() % 100_000 - 100_001).cast("int")
    asked = [F.when(unanswered, col_of(k)).alias(f"key{i}") for i, k in enumerate(keys)]
    left = left.withColumn("__salted", F.struct(*asked, salt.alias("salt")))
    cold = table.select(F.struct(*[col_of(k).alias(f"key{i}") for i, k in enumerate(keys)], F.lit(0).alias("salt")).alias("__salted"), found.alias("__cold"))
    joined = left.join(cold, "__salted", "left")
    answer = F.coalesce(*[F.col(a) for a in [*answers, "__cold"]])
    return joined.withColumn("__answer", answer).select(*[col_of(c) for c in df.columns], *[F.col("__answer").getField(v).alias(v) for v in values])


def _digest(df: DataFrame, key: str) -> Column:
    """A short stand-in for a text key, so that no long key is broadcast."""
    return F.sha2(col_of(key), 256) if is_text(df.schema[key].dataType) else col_of(key)
