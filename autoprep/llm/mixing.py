"""Temperature mixing of sources: exponent by interval search, weights as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of each source: documents with the same first three hex digits of their hash.
DIGITS, BLOCKS = 3, 4096
#: Production targets: share of the largest possible entropy, and how often any text may be seen per sight of another.
ENTROPY, REPEATS = 0.95, 4.0
SECTIONS, ROUNDS = 16, 14


def mixing_exponent(totals: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """Smallest exponent in [0, 1] whose weights are no flatter than the entropy target and the repetition limit allow.

    ``totals`` has ``(tokens)`` per source, all positive. Weights are shares to the power of the
    exponent: 1 keeps the sources' own shares, 0 makes them equal. Entropy falls and the ratio of
    repetitions shrinks as the exponent grows, so the interval is cut in equal sections by one
    small aggregate per round.
    """
    base = totals.agg(F.sum("tokens").alias("all"), F.count("*").alias("n"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not base["n"]:
        return 1.0
    log_share = F.log(F.col("tokens") / F.lit(float(base["all"])))
    target, spread = entropy * math.log(base["n"]), math.log(base["most"] / base["least"])
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / SECTIONS for i in range(SECTIONS)]
        sums = totals.agg(
            *[F.sum(F.exp(F.lit(a) * log_share)).alias(f"z{i}") for i, a in enumerate(points)],
            *[F.sum(F.exp(F.lit(a) * log_share) * log_share).alias(f"d{i}") for i, a in enumerate(points)],
        ).first()
        fits = [
            math.log(sums[f"z{i}"]) - a * sums[f"d{i}"] / sums[f"z{i}"] <= target and (1 - a) * spread <= math.log(repeats)
            for i, a in enumerate(points)
        ]
        first = next((i for i, ok in enumerate(fits) if ok), SECTIONS)
        if first == 0:
            return low
        high = points[first] if first < SECTIONS else high
        low = points[first - 1]
    return high


def mixed(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: int = 42) -> DataFrame:
    """``(doc_id, source, n_tokens, weight, epoch, block, block_order)``: the rows of the mixture, in units of blocks.

    Every source gets its weight's part of the token budget: whole epochs over all its blocks, then
    the first blocks of one more, and of the block where the budget ends the first documents that
    fit. Ordering by ``block_order`` mixes the blocks of all sources anew in each epoch. Without a
    budget it is the smallest that shows every document once. A null source is a source of its own;
    texts without a token (null, empty, blank) carry no weight and come once, in epoch 0. Repeated
    rows stay repeated. An empty table gives an empty result; extra columns are ignored.
    """
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}")))
    tokens = saved(
        docs.select(
            "doc_id", "source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("key"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"),
            F.substring(digest, 1, DIGITS).alias("block"), F.substring(digest, DIGITS + 1, 16).alias("place"),
        ), "tokens",
    )
    blocks = saved(tokens.where("n_tokens > 0").groupBy("key", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    totals = saved(blocks.groupBy("key").agg(F.sum("tokens").alias("tokens")), "sources")
    alpha = mixing_exponent(totals, entropy, repeats)
    base = totals.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most")).first()
    every = float(base["all"] or 1)
    power = F.pow(F.col("tokens") / F.lit(every), F.lit(alpha))
    z = totals.agg(F.sum(power).alias("z")).first()["z"] or 1.0
    weight = power / F.lit(z)
    # The source seen least often per token is the largest one.
    spend = float(budget) if budget is not None else (base["most"] or 0) / ((base["most"] or 1) / every) ** alpha * z
    shares = totals.select("key", "tokens", weight.alias("weight"), F.floor(F.lit(spend) * weight + 0.5).alias("budget")).select(
        "key", "weight", F.floor(F.col("budget") / F.col("tokens")).alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest")
    )
    shares = saved(shares, "shares")
    upto = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("tokens").over(upto), F.lit(0))
    plan = blocks.withColumn("before", before).join(shares, "key").select(
        "key", "block", "weight", "epochs", (F.col("rest") - F.col("before")).alias("room"), "tokens"
    )
    plan = saved(plan, "plan")
    placed = tokens.where("n_tokens > 0").join(plan, ["key", "block"])
    whole = placed.where("room <= 0 or tokens <= room").withColumn("copies", F.col("epochs") + (F.col("room") > 0).cast("int"))
    inside = Window.partitionBy("key", "block").orderBy("place", "doc_id")
    split = placed.where("room > 0 and tokens > room").withColumn("seen", F.sum("n_tokens").over(inside))
    split = split.withColumn("copies", F.col("epochs") + (F.col("seen") <= F.col("room")).cast("int")).drop("seen")
    columns = ("doc_id", "source", "n_tokens", "weight", "key", "block", "copies")
    blank = tokens.where("n_tokens = 0").withColumn("weight", F.lit(0.0)).withColumn("copies", F.lit(1).cast("bigint"))
    rows = whole.select(*columns).union(split.select(*columns)).union(blank.select(*columns)).where("copies > 0")
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, copies - 1)")))
    order = F.md5(F.concat_ws("|", "key", "block", F.col("epoch").cast("string"), F.lit(str(seed))))
    return rows.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", F.substring(order, 1, 16).alias("block_order"))


def oracle(entropy: float = ENTROPY, repeats: float = REPEATS, seed: int = 42, docs: str = "documents") -> str:
    """The same rows in DuckDB SQL."""
    return f"""
with recursive tokens as (
  select doc_id, source, coalesce('=' || source, '-') as key,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as n_tokens,
         substr(md5(coalesce(doc_id::varchar, '') || '|{seed}'), 1, {DIGITS}) as block,
         substr(md5(coalesce(doc_id::varchar, '') || '|{seed}'), {DIGITS + 1}, 16) as place
  from {docs}
), blocks as (select key, block, sum(n_tokens)::bigint as tokens from tokens where n_tokens > 0 group by all),
totals as (select key, sum(tokens)::bigint as tokens from blocks group by key),
shares0 as (select key, tokens, ln(tokens / (select sum(tokens)::double from totals)) as l from totals),
facts as (select {entropy} * ln(count(*)) as target, ln(max(tokens) / min(tokens)::double) as spread from totals),
points as (select 0 as step, 0.0::double as low, 1.0::double as high
  union all
  select step + 1, case when ok then low else mid end, case when ok then mid else high end from (
    select step, low, high, mid,
           (select ln(sum(exp(mid * l))) - mid * sum(exp(mid * l) * l) / sum(exp(mid * l)) from shares0) <= (select target from facts)
           and (1 - mid) * (select spread from facts) <= ln({repeats}) as ok
    from (select *, (low + high) / 2 as mid from points) where step < 54)
), alpha as (
  select case when (select ln(count(*)) <= target and spread <= ln({repeats}) from shares0, facts group by target, spread) then 0.0 else high end as a
  from points where step = 54
), powered as (select key, tokens, exp(a * l) as p from shares0, alpha),
weighed as (select key, tokens, p / (select sum(p) from powered) as weight from powered),
budgeted as (
  select key, weight, tokens, floor((select max(tokens / weight) from weighed where tokens = (select max(tokens) from weighed)) * weight + 0.5)::bigint as budget
  from weighed
), shares as (select key, weight, budget // tokens as epochs, budget % tokens as rest from budgeted),
plan as (
  select key, block, weight, epochs, tokens,
         rest - coalesce(sum(tokens) over (partition by key order by block rows between unbounded preceding and 1 preceding), 0) as room
  from blocks join shares using (key)
), placed as (
  select *, sum(n_tokens) over (partition by key, block order by place, doc_id) as seen from tokens join plan using (key, block) where n_tokens > 0
), counted as (
  select doc_id, source, n_tokens, weight, key, block,
         epochs + case when room <= 0 then 0 when tokens <= room then 1 when seen <= room then 1 else 0 end as copies from placed
  union all select doc_id, source, n_tokens, 0.0, key, block, 1 from tokens where n_tokens = 0
), rows as (select *, unnest(range(copies::bigint)) as epoch from counted where copies > 0)
select doc_id, source, n_tokens, weight, epoch, block,
       substr(md5(key || '|' || block || '|' || epoch::varchar || '|{seed}'), 1, 16) as block_order
from rows"""
