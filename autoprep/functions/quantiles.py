"""Exact linear-interpolated quantiles without holding a column's values in one task.

The built-in ``percentile`` keeps every distinct value of a group in one buffer, so it is used
only up to ``small_rows``. Beyond that each wanted rank is bracketed with a mergeable sketch,
the bracket is narrowed by counting passes, and only the values inside it are grouped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import col_of, finite_or_null

SMALL_ROWS = 2_000_000
ACCURACY = 10_000
MAX_ROUNDS = 4


def exact_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    small_rows: int = SMALL_ROWS,
) -> dict[str, list[float] | None]:
    """``{column: [quantile per prob]}``, nulls and non-finite values ignored, None when empty."""
    if not cols:
        return {}
    values = df.select(*[finite_or_null(col_of(c).cast("double"), df.schema[c].dataType).alias(f"v{i}")
                         for i, c in enumerate(cols)])
    counts = values.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(cols))]).first()
    n = [counts[f"n{i}"] for i in range(len(cols))]
    if max(n) <= small_rows:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        row = values.agg(*[F.percentile(f"v{i}", wanted).alias(f"q{i}") for i in range(len(cols))]).first()
        return {c: (list(row[f"q{i}"]) if n[i] else None) for i, c in enumerate(cols)}
    return _select_ranks(values, cols, n, probs, small_rows)


def _select_ranks(values, cols, n, probs, small_rows):
    slots = {}
    for i in range(len(cols)):
        if n[i]:
            for j, p in enumerate(probs):
                rank = p * (n[i] - 1)
                slots[(i, j)] = {"k": math.floor(rank), "frac": rank - math.floor(rank),
                                 "top": min(math.floor(rank) + 1, n[i] - 1),
                                 "lo": -math.inf, "hi": math.inf, "below": 0, "inside": n[i]}
    for _ in range(MAX_ROUNDS):
        wide = {s: v for s, v in slots.items() if v["inside"] > small_rows and v["lo"] != v["hi"]}
        if not wide or not _narrow(values, wide):
            break
    picked = _values_at(values, slots)
    out = {c: None for c in cols}
    for (i, j), s in slots.items():
        low, high = picked[(i, j)]
        out[cols[i]] = out[cols[i]] or [0.0] * len(probs)
        out[cols[i]][j] = low + (high - low) * s["frac"]
    return out


def _inside(i: int, s: dict) -> Column:
    v = F.col(f"v{i}")
    cond = v.isNotNull()
    if s["lo"] > -math.inf:
        cond = cond & (v >= F.lit(s["lo"]))
    if s["hi"] < math.inf:
        cond = cond & (v <= F.lit(s["hi"]))
    return cond


def _narrow(values: DataFrame, wide: dict) -> bool:
    """One sketch pass and one counting pass; True when some bracket shrank."""
    aggs = []
    for (i, j), s in wide.items():
        inner = F.when(_inside(i, s), F.col(f"v{i}"))
        edges = [max(0.0, (s["k"] - s["below"]) / s["inside"] - 3 / ACCURACY),
                 min(1.0, (s["top"] - s["below"] + 1) / s["inside"] + 3 / ACCURACY)]
        aggs.append(F.percentile_approx(inner, edges, ACCURACY).alias(f"e{i}_{j}"))
    edges = values.agg(*aggs).first()
    aggs = []
    for i, j in wide:
        lo, hi = edges[f"e{i}_{j}"]
        v = F.col(f"v{i}")
        aggs += [F.count_if(v < F.lit(lo)).alias(f"b{i}_{j}"),
                 F.count_if((v >= F.lit(lo)) & (v <= F.lit(hi))).alias(f"w{i}_{j}")]
    counted = values.agg(*aggs).first()
    shrank = False
    for (i, j), s in wide.items():
        lo, hi = edges[f"e{i}_{j}"]
        below, inside = counted[f"b{i}_{j}"], counted[f"w{i}_{j}"]
        if below <= s["k"] and below + inside > s["top"] and inside < s["inside"]:
            s.update(lo=lo, hi=hi, below=below, inside=inside)
            shrank = True
    return shrank


def _values_at(values: DataFrame, slots: dict) -> dict:
    entries = [
        F.when(_inside(i, s), F.struct(F.lit(f"{i}_{j}").alias("slot"), F.col(f"v{i}").alias("v")))
        for (i, j), s in slots.items()
    ]
    ranks = F.create_map(*[x for (i, j), s in slots.items() for x in (
        F.lit(f"{i}_{j}"), F.array(F.lit(s["k"] - s["below"]), F.lit(s["top"] - s["below"])))])
    upto = Window.partitionBy("slot").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        values.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy(F.col("e.slot").alias("slot"), F.col("e.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn("last", F.sum("m").over(upto) - 1)
        .withColumn("first", F.col("last") - F.col("m") + 1)
        .withColumn("want", ranks[F.col("slot")])
    )
    rows = (
        counted.select("slot", "v", "first", "last", F.posexplode("want").alias("pos", "rank"))
        .where(F.col("rank").between(F.col("first"), F.col("last")))
        .collect()
    )
    found = {}
    for r in rows:
        found.setdefault(tuple(int(x) for x in r["slot"].split("_")), [None, None])[r["pos"]] = r["v"]
    return found
