"""Boosted regressors of a whole search from one table of sums per fold and bins.

A tree sees of a row only the bins that its features fall into. With the squared loss, the weights and label sums of
each fold and combination of bins are therefore all that boosting asks of its rows, and all that R² asks of a held-out
fold: each round of each grid point is computed from them without another look at the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import DEEPEST, ModelSpec, gbt_regressor

#: Bins of a feature, the library's default.
BINS = 32
#: Different values of all features and folds, and combinations of fold and bins, beyond which every point is refitted.
VALUES = 100_000
CELLS = 200_000
#: Share by which even gains may differ.
EVEN = 1e-12
DEFAULTS = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3}
SUMS = ("n", "w", "wy", "y", "yy")


def solvable(spec: ModelSpec, task: str) -> bool:
    return task == "regression" and spec.make is gbt_regressor


def _plain(point: dict) -> bool:
    """Points that the library accepts; it has to name the fault of others."""
    p = DEFAULTS | point
    return (
        len(p) == len(DEFAULTS) and type(p["n_estimators"]) is int and p["n_estimators"] > 0 and type(p["max_depth"]) is int
        and 0 <= p["max_depth"] <= DEEPEST and type(p["learning_rate"]) is float and 0 < p["learning_rate"] <= 1
    )


def _together(parts: DataFrame, by: list[str], names: tuple, most: int) -> pa.Table | None:
    """Sums by key, none of more than ``most`` keys. Sorted, so that the order of arrival does not decide about the last bits."""
    total = [F.aggregate(F.sort_array(F.collect_list(c)), F.lit(0.0), lambda a, v: a + v).alias(c) for c in names]
    found = parts.groupBy(*by).agg(*total).limit(most + 1).toArrow()
    return found if found.num_rows <= most else None


def _value_weights(rows: DataFrame) -> pa.Table | None:
    """Rows and weight of each value of each feature, by fold."""
    kind = "fold int, feature int, value double, n double, w double"

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, x, w = np.asarray(batch["fold"]), np.asarray(batch["x"].flatten(), float).reshape(batch.num_rows, -1), np.asarray(batch["w"])
            for f in np.unique(fold):
                here = fold == f
                for j in range(x.shape[1]):
                    value, at = np.unique(x[here, j], return_inverse=True)
                    yield pa.record_batch([
                        pa.array(np.full(len(value), f, np.int32)), pa.array(np.full(len(value), j, np.int32)), pa.array(value),
                        pa.array(np.bincount(at).astype(float)), pa.array(np.bincount(at, w[here]))], ["fold", "feature", "value", "n", "w"])

    return _together(rows.select("fold", "x", "w").mapInArrow(values, kind), ["fold", "feature", "value"], ("n", "w"), VALUES)


def _cells(rows: DataFrame, cuts: list[np.ndarray]) -> pa.Table | None:
    """Sums of rows, weight, weighted label, label and its square by fold and bins."""
    kind = "fold int, bins binary, " + ", ".join(f"{c} double" for c in SUMS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, x, y, w = np.asarray(batch["fold"]), np.asarray(batch["x"].flatten(), float).reshape(batch.num_rows, -1), np.asarray(batch["y"]), np.asarray(batch["w"])
            cell = np.column_stack([fold, *[np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]]).astype(np.int32)
            cell, at = np.unique(cell, axis=0, return_inverse=True)
            total = [np.bincount(at.reshape(-1), v) for v in (np.ones(len(y)), w, w * y, y, y * y)]
            yield pa.record_batch([pa.array(cell[:, 0]), pa.array([c.tobytes() for c in cell[:, 1:]], pa.binary()), *map(pa.array, total)], ["fold", "bins", *SUMS])

    return _together(rows.mapInArrow(sums, kind), ["fold", "bins"], SUMS, CELLS)


def thresholds(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """The library's cuts between sorted values: all of them, or those nearest to even shares of the weight."""
    if len(values) - 1 <= most:
        return (values[1:] + values[:-1]) / 2
    stride, count, found = weights.sum() / (most + 1), np.cumsum(weights), []
    target = stride
    for i in range(1, len(values)):
        if abs(count[i - 1] - target) < abs(count[i] - target):
            found.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(found)


def _tree(bins: np.ndarray, sizes: list[int], n: np.ndarray, w: np.ndarray, s: np.ndarray, depth: int) -> np.ndarray:
    """What a tree of squared error predicts for each cell; ``n``, ``w`` and ``s`` are its rows, weight and weighted target.

    As in the library, the first of equally good cuts counts, and either side of a cut holds a row. Gains are even if
    they differ by rounding, which decides in the library.
    """
    out, live, node, k = np.zeros(len(n)), np.arange(len(n)), np.zeros(len(n), int), 1
    for level in range(depth + 1):
        rows, weight, total = (np.bincount(node, v[live], k) for v in (n, w, s))
        out[live] = (total / weight)[node]
        if level == depth:
            break
        best, feature, cut = np.zeros(k), np.zeros(k, int), np.zeros(k, int)
        for j, size in enumerate(sizes):
            if size < 2:
                continue
            at = node * size + bins[live, j]
            left_n, left_w, left = (np.bincount(at, v[live], k * size).reshape(k, size).cumsum(1)[:, :-1] for v in (n, w, s))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left**2 / left_w + (total[:, None] - left) ** 2 / (weight[:, None] - left_w) - (total**2 / weight)[:, None]
            gain = np.where((left_n > 0.5) & (left_n < rows[:, None] - 0.5), gain, -np.inf)
            found = gain.max(1)
            first = (gain >= (found * (1 - EVEN))[:, None]).argmax(1)
            better = found > best * (1 + EVEN)
            best[better], feature[better], cut[better] = found[better], j, first[better]
        split = best[node] > 0
        live, node = live[split], node[split]
        if not len(live):
            break
        number, node = np.unique(2 * node + (bins[live, feature[node]] > cut[node]), return_inverse=True)
        k = len(number)
    return out


def _boosts(bins: np.ndarray, sizes: list[int], n: np.ndarray, w: np.ndarray, wy: np.ndarray, rate: float, depth: int, rounds: int) -> Iterator[np.ndarray]:
    """Predictions for each cell after one, two, … rounds. As in the library, the first tree counts in full and the others fit the loss's whole gradient, twice the residual."""
    found = _tree(bins, sizes, n, w, wy, depth)
    yield found
    for _ in range(1, rounds):
        found = found + rate * _tree(bins, sizes, n, w, 2 * (wy - found * w), depth)
        yield found


def fold_scores(data: DataFrame, points: list[dict], folds: int, weight: str | None = None) -> dict[int, list[float]]:
    """R² on each fold of the grid points that can be computed from sums, fitted on all others.

    Cuts come from all rows, where the library draws them from a sample of tables above 10,000 rows. No points where a
    fold or its rest is empty, a value is not finite, or the sums would not stay small.
    """
    plain = {i: DEFAULTS | p for i, p in enumerate(points) if _plain(p)}
    centre = data.agg(F.avg("label")).first()[0] if plain else None
    if centre is None or not np.isfinite(centre):
        return {}
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = data.select(F.col("fold").cast("int").alias("fold"), vector_to_array("features").alias("x"), (F.col("label") - F.lit(centre)).alias("y"), w.alias("w"))
    values = _value_weights(rows)
    if values is None or not values.num_rows:
        return {}
    fold, feature, value, value_n, value_w = (values[c].to_numpy() for c in values.column_names)
    if not (np.isfinite(value).all() and np.isfinite(value_w).all() and set(range(folds)) == set(fold) and folds > 1):
        return {}
    width = int(feature.max()) + 1
    cuts = []
    for f in range(folds):
        rest = fold != f
        most = min(BINS, round(value_n[rest & (feature == 0)].sum())) - 1
        cuts.append([])
        for j in range(width):
            here = rest & (feature == j)
            known, at = np.unique(value[here], return_inverse=True)
            cuts[f].append(thresholds(known, np.bincount(at, value_w[here]), most))
    every = [np.unique(np.concatenate([c[j] for c in cuts])) for j in range(width)]
    cells = _cells(rows, every)
    if cells is None:
        return {}
    fold, bins = cells["fold"].to_numpy(), np.frombuffer(b"".join(cells["bins"].to_pylist()), np.int32).reshape(-1, width)
    # In the order of the cells, not of arrival.
    order = np.lexsort([*bins.T[::-1], fold])
    fold, bins, sums = fold[order], bins[order], {c: cells[c].to_numpy()[order] for c in SUMS}
    if not all(np.isfinite(v).all() for v in sums.values()) or (sums["w"] <= 0).any():
        return {}
    out: dict[int, list[float]] = {i: [] for i in plain}
    for f in range(folds):
        # The first bin lies below every cut; another one above the cut that opens it.
        own = [np.searchsorted(c, e, side="right") for c, e in zip(cuts[f], every)]
        here = np.column_stack([np.append(0, o)[bins[:, j]] for j, o in enumerate(own)])
        here, at = np.unique(here, axis=0, return_inverse=True)
        at, rest = at.reshape(-1), fold != f
        n, weights, wy = (np.bincount(at, sums[c] * rest, len(here)) for c in ("n", "w", "wy"))
        held, y = (np.bincount(at, sums[c] * ~rest, len(here)) for c in ("n", "y"))
        yy = sums["yy"][~rest].sum()
        spread = yy - y.sum() ** 2 / held.sum()
        for rate, depth in dict.fromkeys((p["learning_rate"], p["max_depth"]) for p in plain.values()):
            asked = {i: p["n_estimators"] for i, p in plain.items() if (p["learning_rate"], p["max_depth"]) == (rate, depth)}
            boosts = _boosts(here, [len(c) + 1 for c in cuts[f]], n, weights, wy, rate, depth, max(asked.values()))
            for rounds, found in enumerate(boosts, 1):
                for i in (i for i, r in asked.items() if r == rounds):
                    error = max(yy - 2 * (found @ y) + held @ found**2, 0.0)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        out[i].append(float(1 - np.float64(error) / np.float64(spread)))
    return out
