"""Isolation forest: bounded samples build the trees in parallel, every row is scored against all."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..functions.lineage import cut_lineage
from ..functions.quantiles import exact_quantiles
from ..operators.vectors import as_array

SAMPLE_ROWS = 256
HASHES = 1 << 30
# Fixed value: the automatic limit on the anomaly score.
AUTO_LIMIT = 0.5
NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    rng = np.random.default_rng((seed, tree))
    most = math.ceil(math.log2(max(len(x), 2)))
    nodes, todo = [], [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        spans = x[rows].max(0) - x[rows].min(0) if len(rows) else np.zeros(x.shape[1])
        usable = np.flatnonzero(spans > 0)
        if depth >= most or len(rows) <= 1 or not len(usable):
            nodes.append([tree, me, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
        else:
            f = int(rng.choice(usable))
            low, high = x[rows, f].min(), x[rows, f].max()
            cut = float(rng.uniform(low, high))
            nodes.append([tree, me, f, cut, -1, -1, 0.0])
            goes = x[rows, f] <= cut
            todo += [(rows[~goes], depth + 1, me, 5), (rows[goes], depth + 1, me, 4)]
        if parent is not None:
            nodes[parent][side] = me
    return [tuple(n) for n in nodes]


def fit_isolation_forest(df: DataFrame, key: str, features, n_trees: int = 100, seed: int = 42) -> list[list[tuple]]:
    """Trees as node tables. Each tree sees the 256 of its rows with the lowest key hashes."""
    rows = df.select(col_of(key).alias("id"), as_array(df, features).alias("x")).where(F.col("x").isNotNull())
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit")
    chosen = Window.partitionBy("tree").orderBy("h", "id")
    sample = (
        _candidates(rows, n, n_trees, seed)
        .withColumn("rn", F.row_number().over(chosen)).where(F.col("rn") <= SAMPLE_ROWS).select("tree", "h", "x")
    )

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        nodes = _grow(int(pdf["tree"].iloc[0]), np.stack(pdf["x"].to_numpy()).astype(float), seed)
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    trees = {}
    for r in sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).collect():  # at most 511 nodes per tree
        trees.setdefault(r["tree"], []).append(tuple(r)[1:])
    return [sorted(trees[t]) for t in sorted(trees)]


def _candidates(rows: DataFrame, n: int, n_trees: int, seed: int) -> DataFrame:
    """``(tree, h, id, x)``: about twice the sample per tree survives the scan.

    With rows to spare each row is drawn for at most one tree, at one hash per row; otherwise
    every row may serve in several trees.
    """
    if n >= 4 * SAMPLE_ROWS * n_trees:
        share = math.ceil(HASHES * 2 * SAMPLE_ROWS * n_trees / n)
        return rows.withColumn("h", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(HASHES))).where(F.col("h") < share).withColumn(
            "tree", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n_trees)).cast("int"))
    share = HASHES if n <= 4 * SAMPLE_ROWS else min(HASHES, math.ceil(HASHES * 2 * SAMPLE_ROWS / n))
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    drawn = drawn.withColumn("h", F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.lit(HASHES)))
    return drawn.where(F.col("h") < share)


def score_isolation_forest(df: DataFrame, trees: list[list[tuple]], features, sample_rows: int) -> DataFrame:
    """Append ``anomaly_score`` in (0, 1]."""
    # One table of all trees: leaves point to themselves, so every row takes the same steps.
    start, feature, cut, left, right, depth = [], [], [], [], [], []
    for t in trees:
        base = len(feature)
        start.append(base)
        for node, f, c, goes_left, goes_right, d in t:
            leaf = f < 0
            feature.append(0 if leaf else f)
            cut.append(np.inf if leaf else c)
            left.append(base + (node if leaf else goes_left))
            right.append(base + (node if leaf else goes_right))
            depth.append(d)
    start, feature, cut = np.array(start), np.array(feature), np.array(cut)
    step, depth = np.array([left, right]), np.array(depth)
    levels = math.ceil(math.log2(max(sample_rows, 2)))
    scale = float(average_path(sample_rows)) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        v = np.stack(x.to_numpy()).astype(float)
        at_row = np.arange(len(v))[:, None]
        node = np.repeat(start[None, :], len(v), axis=0)
        for _ in range(levels):
            node = step[(v[at_row, feature[node]] > cut[node]).astype(int), node]
        return pd.Series(2.0 ** (-depth[node].mean(axis=1) / scale))

    return df.withColumn("anomaly_score", score(as_array(df, features)))


def isolation_forest(
    df: DataFrame, key: str, features, n_trees: int = 100, contamination: float | str = "auto", seed: int = 42
) -> DataFrame:
    """``(key, anomaly_score, is_outlier)``."""
    rows = df.where(as_array(df, features).isNotNull())
    trees = fit_isolation_forest(rows, key, features, n_trees, seed)
    sample_rows = min(SAMPLE_ROWS, rows.limit(SAMPLE_ROWS).count())
    scored = score_isolation_forest(rows, trees, features, sample_rows).select(col_of(key).alias("key"), "anomaly_score")
    limit = AUTO_LIMIT
    if contamination != "auto":
        scored = cut_lineage(scored)  # the limit and the result both read the scores
        limit = exact_quantiles(scored, ["anomaly_score"], [1 - float(contamination)])["anomaly_score"][0]
    return scored.withColumn("is_outlier", F.col("anomaly_score") > F.lit(limit))
