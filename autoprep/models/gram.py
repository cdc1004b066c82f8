"""Linear models of a whole search from one table of sums per fold.

Each fold's sums of products hold all that least squares and ridge regression know about its rows, and all
that R² asks of a held-out fold. "All folds but one" is a subtraction, so every grid point is solved
and judged without another look at the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import ModelSpec, linear_regression, ridge

#: Beyond this many features the matrices of the folds weigh more than refits are worth.
GRAM_FEATURES = 500
SALTS = 32
#: Rows whose products are summed at once.
STRIP = 4096


def solvable(spec: ModelSpec, task: str) -> bool:
    return task == "regression" and spec.make in (linear_regression, ridge)


def fold_sums(data: DataFrame, weight: str | None = None) -> dict[int, np.ndarray] | None:
    """Per fold the weighted and the plain sums of products of (1, features, label), about the overall means.

    One scan for the means, one for the sums, joined in two steps. None without rows or with more than
    ``GRAM_FEATURES`` features.
    """
    if data.isEmpty():
        return None
    means = data.agg(Summarizer.mean(F.col("features")).alias("x"), F.avg("label").alias("y")).first()
    if not len(means["x"]) or len(means["x"]) > GRAM_FEATURES or means["y"] is None:
        return None
    shift = np.append(means["x"].toArray(), means["y"])
    width = len(shift) + 1
    kind = "fold int, salt int, sums binary"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                fold, features, label, w = (c.to_pylist() for c in batch.slice(at, STRIP).columns)
                z = np.column_stack([np.ones(len(fold)), np.column_stack([np.array(features, float), np.array(label, float)]) - shift])
                w, fold = np.array(w, float), np.array(fold)
                for f in np.unique(fold):
                    here = z[fold == f]
                    add = np.stack([(here * w[fold == f, None]).T @ here, here.T @ here])
                    total[int(f)] = total.get(int(f), 0) + add
        salt = TaskContext.get().partitionId() % SALTS
        for f, m in total.items():
            yield pa.record_batch([pa.array([f], pa.int32()), pa.array([salt], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["fold", "salt", "sums"])

    def together(group: pa.Table) -> pa.Table:
        # Sorted, so that the order of arrival does not decide about the last bits.
        total = sum(np.frombuffer(part) for part in sorted(group.column("sums").to_pylist()))
        return pa.table({"fold": group.column("fold").slice(0, 1), "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = data.select(F.col("fold").cast("int").alias("fold"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), w.alias("w"))
    parts = rows.mapInArrow(sums, kind).groupBy("fold", "salt").applyInArrow(together, kind)
    found = parts.groupBy("fold").applyInArrow(together, kind).collect()  # one row of bounded size per fold
    return {r["fold"]: np.frombuffer(r["sums"]).reshape(2, width, width) for r in found}


def solve(sums: np.ndarray, alpha: float = 0.0) -> np.ndarray:
    """``(-intercept, -coefficients, 1)``: the weights that turn (1, features, label) into a residual."""
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    centred = sums[1:, 1:] - n * np.outer(mean, mean)
    xx, xy = centred[:-1, :-1], centred[:-1, -1]
    # On features of unit spread the cut of vanishing directions does not depend on units.
    scale = np.sqrt(np.maximum(np.diag(xx), 0))
    scale = np.where(scale > 1e-12 * np.sqrt(np.maximum(np.diag(sums)[1:-1], 0) + 1e-300), scale, 1.0)
    scaled = xx / np.outer(scale, scale) + np.diag(alpha / scale**2)
    b = np.linalg.lstsq(scaled, xy / scale, rcond=1e-12)[0] / scale
    return np.concatenate([[-(mean[-1] - b @ mean[:-1])], -b, [1.0]])


def r2(sums: np.ndarray, residual: np.ndarray) -> float:
    error = max(float(residual @ sums @ residual), 0.0)
    spread = float(sums[-1, -1] - sums[0, -1] ** 2 / sums[0, 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(1 - np.float64(error) / np.float64(spread))


def fold_scores(sums: dict[int, np.ndarray], points: list[dict], folds: int) -> dict[int, list[float]] | None:
    """R² of each grid point on each fold, fitted on all others; None where a fold or its rest is empty."""
    total = sum(sums.values())
    rest = {f: total - sums[f] for f in range(folds) if f in sums}
    # Entry (0, 0) of the weighted sums is the weight, of the plain ones the number of rows.
    if len(rest) < folds or not np.isfinite(total).all() or any(r[0, 0, 0] <= 0 or r[1, 0, 0] < 1 for r in rest.values()):
        return None
    return {i: [r2(sums[f][1], solve(rest[f][0], p.get("alpha", 0.0))) for f in range(folds)] for i, p in enumerate(points)}


def label_sums(data: DataFrame, weight: Column) -> dict[int, np.ndarray]:
    """Per fold: weight, and first and second weighted moment of the label about its overall mean; the largest label last."""
    centre = data.agg(F.avg("label")).first()[0] or 0.0
    away = F.col("label") - F.lit(centre)
    found = data.groupBy("fold").agg(F.sum(weight).alias("n"), F.sum(weight * away).alias("s"), F.sum(weight * away * away).alias("ss"), F.max("label").alias("top"))
    return {r["fold"]: np.array([r["n"] or 0.0, r["s"] or 0.0, r["ss"] or 0.0, -1.0 if r["top"] is None else r["top"]]) for r in found.collect()}
