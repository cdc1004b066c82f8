"""Profiling: column statistics, value lists, correlations and target analysis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    BALANCE_LEVELS,
    BALANCE_REMEDY,
    CATEGORICAL_NUMERIC_MAX,
    CONCENTRATION_LEVELS,
    REGRESSION_MIN_UNIQUE,
    SENTINELS,
    VALUE_LIST_MAX,
)
from ..functions.columns import (
    col_of,
    distinct_token,
    finite_or_null,
    is_datetime,
    is_numeric,
    is_text,
    share,
    sketch_distinct,
)
from ..functions.quantiles import exact_quantiles

# An aggregate with more than 100 buffer fields is not compiled. A pass reads only its own
# columns, so splitting costs no extra input.
COLUMNS_PER_PASS = 7

# Distinct counts the rules compare with; sketches within 10 % of one are recounted exactly.
UNIQUE_LIMITS = (2, 10, 15, 20, 50)
RATIO_LIMITS = (0.5,)


def ladder(value: Column, levels, otherwise: str, strict: bool) -> Column:
    """First level whose limit the value passes (``>`` when strict, else ``>=``)."""
    out = None
    for name, limit in levels:
        hit = value > limit if strict else value >= limit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def profile_table(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"))


def _base_type(dtype) -> str:
    if is_numeric(dtype):
        return "numeric"
    if dtype.typeName() == "boolean":
        return "boolean"
    if is_text(dtype):
        return "categorical"
    return "datetime" if is_datetime(dtype) else "other"


def _clean_value(df: DataFrame, name: str) -> Column:
    return finite_or_null(col_of(name), df.schema[name].dataType)


def _column_facts(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    v = _clean_value(df, name)
    base = _base_type(dtype)
    number = v.cast("double") if base == "numeric" else v.cast("int").cast("double") if base == "boolean" else None
    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    numeric = [none] * 5
    if number is not None:
        m = F.count(v)
        skew = F.when(
            m >= 3, F.skewness(number) * F.sqrt((m * (m - 1)).cast("double")) / F.greatest(m - 2, F.lit(1)).cast("double")
        )
        numeric = [F.min(number), F.max(number), F.avg(number), F.stddev_samp(number), skew]
    stamps = [F.min(v).cast("string"), F.max(v).cast("string")] if base == "datetime" else [no_text] * 2
    names = ["n_rows", "nulls", "min_value", "max_value", "mean_value", "std_value", "skew_value", "min_ts", "max_ts"]
    exprs = [F.count(F.lit(1)), F.count(F.lit(1)) - F.count(v), *numeric, *stamps]
    return F.struct(*[e.alias(k) for e, k in zip(exprs, names)]).alias(name)


def profile_columns(df: DataFrame, target: str | None = None, approx: bool = False) -> DataFrame:
    """One row per column: counts, moments, semantic type and role flags.

    Distinct counts are exact. With ``approx`` they come from a mergeable sketch, and only the
    columns near a rule's limit are counted exactly.
    """
    facts = _stacked(df, lambda c: _column_facts(df, c), [
        ("dtype", lambda c: df.schema[c].dataType.simpleString()),
        ("base_type", lambda c: _base_type(df.schema[c].dataType)),
        ("is_target", lambda c: c == target),
    ]).select("position", "column", "dtype", "base_type", "is_target", "facts.*")
    recount = _near_limits(df) if approx else set(df.columns)

    def unique(c: str) -> Column:
        token = distinct_token(_clean_value(df, c), df.schema[c].dataType)
        return F.count_distinct(token) if c in recount else sketch_distinct(token)

    # Apart from the moments: the distinct aggregation keys on values and would drag every moment
    # buffer through its shuffle. Both sides have one row per column when they meet.
    distinct = _stacked(df, unique, []).select("position", F.col("facts").alias("unique_count"))
    out = facts.join(F.broadcast(distinct), "position")
    counted_number = F.col("base_type").isin("numeric", "boolean")
    out = out.withColumns({
        "null_pct": F.coalesce(share(F.col("nulls"), F.col("n_rows"), 2, 100), F.lit(0.0)),
        "cardinality_ratio": F.coalesce(share(F.col("unique_count"), F.col("n_rows"), 4), F.lit(0.0)),
        "type": F.when(counted_number & (F.col("unique_count") <= CATEGORICAL_NUMERIC_MAX), "categorical_numeric")
        .otherwise(F.col("base_type")),
    })
    return column_roles(out).drop("base_type")


def _stacked(df: DataFrame, aggregate, labels) -> DataFrame:
    """One aggregate row per ``COLUMNS_PER_PASS`` columns, turned into one row per column."""
    out = None
    for start in range(0, len(df.columns), COLUMNS_PER_PASS):
        names = df.columns[start:start + COLUMNS_PER_PASS]
        rows = df.agg(*[aggregate(c).alias(c) for c in names]).select(F.inline(F.array(*[
            F.struct(F.lit(start + i).alias("position"), F.lit(c).alias("column"),
                     *[F.lit(value(c)).alias(label) for label, value in labels], col_of(c).alias("facts"))
            for i, c in enumerate(names)
        ])))
        out = rows if out is None else out.unionByName(rows)
    return out


def _near_limits(df: DataFrame) -> set[str]:
    sketch = df.agg(F.count(F.lit(1)).alias("n"), *[
        sketch_distinct(_clean_value(df, c)).alias(f"d{i}")
        for i, c in enumerate(df.columns)
    ]).first()
    near = set()
    for i, c in enumerate(df.columns):
        d, n = sketch[f"d{i}"], max(sketch["n"], 1)
        limits = [*UNIQUE_LIMITS, *[r * n for r in RATIO_LIMITS]]
        if any(abs(d - limit) <= max(0.1 * limit, 1) for limit in limits):
            near.add(c)
    return near


def column_roles(columns: DataFrame, target: str | None = None) -> DataFrame:
    """Role flags; the target has none."""
    free = ~F.col("is_target") if target is None else (F.col("column") != target)
    return columns.withColumns({
        "is_numeric_role": free & F.col("type").isin("numeric", "categorical_numeric"),
        "is_categorical_role": free & (F.col("type") == "categorical"),
        "is_high_cardinality": free & (F.col("cardinality_ratio") > 0.5),
        "is_high_null": free & (F.col("null_pct") > 50),
    })


def value_counts(df: DataFrame, cols: list[str] | None = None, top: int = VALUE_LIST_MAX) -> DataFrame:
    """Most frequent values per column. Without ``cols``: the columns with few distinct values.

    A sketch rules out the columns with clearly too many values; the exact number of values is
    then read off the counts themselves.
    """
    limits = None
    if cols is None:
        sketch = df.agg(*[sketch_distinct(_clean_value(df, c)).alias(c) for c in df.columns]).first()
        limits = {}
        for c in df.columns:
            base = _base_type(df.schema[c].dataType)
            most = CATEGORICAL_NUMERIC_MAX if base == "numeric" else VALUE_LIST_MAX
            if base in ("numeric", "boolean", "categorical") and sketch[c] <= 2 * most:
                limits[c] = most
        cols = list(limits)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint, rank int")
    entries = [F.struct(F.lit(c).alias("column"), _clean_value(df, c).cast("string").alias("value")) for c in cols]
    long = df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    if limits:
        # At most twice the limit of values per column is left here.
        most = F.create_map(*[x for kv in limits.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        counts = counts.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy("column")))
        counts = counts.where(F.col("__k") <= most[F.col("column")]).drop("__k")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row. Long text is compared by digest, so it is not shuffled."""
    tokens = df.select(*[distinct_token(col_of(c), df.schema[c].dataType).alias(c) for c in df.columns])
    groups = tokens.groupBy(*[col_of(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicated_rows"))


# Rows that a task sums at once, and groups of tasks whose sums are joined first.
CORRELATED_ROWS, CORRELATED_SALTS = 4_096, 16


def _co_moments(x: np.ndarray) -> np.ndarray:
    """``[n, mean, m2, co]`` over pairs of columns, each over the rows where both are filled.

    ``mean[i, j]`` and ``m2[i, j]`` are of column i where j is filled too. Values are taken relative
    to one of their own, so a constant has no variance at all.
    """
    filled = np.isfinite(x)
    first = np.where(filled.any(0), x[filled.argmax(0), np.arange(x.shape[1])], 0.0)
    y = np.where(filled, x - first, 0.0)
    n = filled.sum(0)
    centre = np.where(n > 0, y.sum(0) / np.maximum(n, 1), 0.0)
    y = np.where(filled, y - centre, 0.0)
    m = filled.astype(float)
    n, s, q, p = m.T @ m, y.T @ m, (y * y).T @ m, y.T @ y
    some = np.maximum(n, 1)
    return np.stack([n, (first + centre)[:, None] + s / some, q - s * s / some, p - s * s.T / some])


def _joined_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Co-moments of two sets of rows from those of each."""
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + gap * b[0] / some, b[1])
    weight = a[0] * b[0] / some
    return np.stack([n, mean, a[2] + b[2] + gap * gap * weight, a[3] + b[3] + gap * gap.T * weight])


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r per column pair over the rows where both are filled; null for constants.

    One scan: tasks hold the co-moments of all pairs as arrays, which are joined in two steps.
    """
    width = len(cols)
    kind = "salt int, moments binary"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1)
            for at in range(0, len(x), CORRELATED_ROWS):
                total = _joined_moments(total, _co_moments(x[at : at + CORRELATED_ROWS]))
        salt = TaskContext.get().partitionId() % CORRELATED_SALTS
        yield pa.record_batch([pa.array([salt], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["salt", "moments"])

    def gathered(group: pa.Table) -> np.ndarray:
        total = np.zeros((4, width, width))
        for part in sorted(group.column("moments").to_pylist()):
            total = _joined_moments(total, np.frombuffer(part).reshape(4, width, width))
        return total

    def together(group: pa.Table) -> pa.Table:
        return pa.table({"salt": group.column("salt").slice(0, 1), "moments": pa.array([gathered(group).tobytes()], pa.binary())})

    def pairs(group: pa.Table) -> pa.Table:
        n, _, m2, co = gathered(group)
        i, j = np.triu_indices(width, 1)
        spread = np.sqrt(m2[i, j]) * np.sqrt(m2[j, i])
        fine = (n[i, j] > 0) & (spread > 0)
        r = np.divide(co[i, j], spread, out=np.zeros(len(i)), where=fine)
        return pa.table({"col1": pa.array([cols[k] for k in i], pa.string()), "col2": pa.array([cols[k] for k in j], pa.string()), "r": pa.array(r, mask=~fine)})

    if width < 2:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, r double")
    rows = df.select(*[_clean_value(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = rows.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism).mapInArrow(sums, kind)
    parts = parts.groupBy("salt").applyInArrow(together, kind)
    return parts.groupBy((F.col("salt") * 0).alias("all")).applyInArrow(pairs, "col1 string, col2 string, r double")


def high_corr_pairs(corr: DataFrame, threshold: float = 0.8) -> DataFrame:
    return (
        corr.where(F.abs("r") > threshold)
        .select("col1", "col2", F.bround(F.abs("r"), 3).alias("correlation"))
        .orderBy(F.col("correlation").desc(), "col1", "col2")
    )


def _target_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(_clean_value(df, target).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and percent (of all rows) per class."""
    counts = _target_counts(df, target)
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.where(F.col("value").isNotNull()).select(
        F.col("value").cast("string").alias("value"), "n", share(F.col("n"), total, 2, 100).alias("pct")
    )


def target_top_values(df: DataFrame, target: str, top: int = 5) -> DataFrame:
    counts = _target_counts(df, target).where(F.col("value").isNotNull())
    return counts.orderBy(F.col("n").desc(), "value").limit(top).select(F.col("value").cast("string").alias("value"), "n")


def target_profile(df: DataFrame, target: str | None) -> DataFrame:
    """One row: majority, concentration, task, balance level and remedy, regression statistics."""
    spark = df.sparkSession
    if target is None:
        return spark.createDataFrame([(["clustering", "dimensionality_reduction"],)], "task_candidates array<string>")
    if target not in df.columns:
        raise KeyError(target)
    dtype = df.schema[target].dataType
    numeric = is_numeric(dtype)
    counts = _target_counts(df, target)
    filled = F.col("value").isNotNull()
    n = F.when(filled, F.col("n"))
    number = F.col("value").cast("double") if numeric else F.lit(None).cast("double")
    one = counts.agg(
        F.sum("n").alias("n_rows"),
        F.count("value").alias("unique_count"),
        F.min_by(F.when(filled, F.col("value").cast("string")), F.when(filled, F.struct(-F.col("n"), F.col("value"))))
        .alias("majority_value"),
        F.max(n).alias("majority_count"),
        F.min(n).alias("minority_count"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
    )
    if numeric:
        # Moments come from the rows, not the counts, so they agree with the column profile.
        v = _clean_value(df, target)
        moments = df.agg(F.struct(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))).scalar()
        one = one.withColumn("moments", moments).withColumns(
            {"mean_value": F.col("moments.mean"), "std_value": F.col("moments.std")}
        )
    else:
        none = F.lit(None).cast("double")
        one = one.withColumns({"mean_value": none, "std_value": none})
    pct = share(F.col("majority_count"), F.col("n_rows"), 2, 100)
    ratio = F.col("minority_count") / F.col("majority_count")
    regression = F.lit(numeric) & (F.col("unique_count") >= REGRESSION_MIN_UNIQUE)
    level = ladder(ratio, BALANCE_LEVELS, "extreme", strict=False)
    remedy = F.create_map(*[F.lit(x) for kv in BALANCE_REMEDY.items() for x in kv])
    quantiles = [F.lit(None).cast("double")] * 3
    # A bounded look at the values tells whether quartiles are wanted at all.
    if numeric and counts.where("value is not null").limit(REGRESSION_MIN_UNIQUE).count() >= REGRESSION_MIN_UNIQUE:
        q = exact_quantiles(df, [target], [0.25, 0.5, 0.75])[target]
        quantiles = [F.when(regression, F.lit(v).cast("double")) for v in (q or [None] * 3)]
    keep = [F.when(regression, F.col(c)).alias(c) for c in ("min_value", "max_value", "mean_value", "std_value")]
    out = one.select(
        F.lit(target).alias("name"), F.lit(dtype.simpleString()).alias("dtype"), "n_rows", "unique_count",
        "majority_value", "majority_count", "minority_count", pct.alias("majority_pct"),
        ladder(pct, CONCENTRATION_LEVELS, "normal", strict=True).alias("concentration_level"),
        F.when(regression, "regression").otherwise("classification").alias("task_type"),
        (~regression & (F.col("unique_count") >= 15)).alias("high_cardinality_warning"),
        *keep, *[q.alias(k) for q, k in zip(quantiles, ("p25", "p50", "p75"))],
        F.when(~regression, share(F.col("minority_count"), F.col("majority_count"), 4)).alias("balance_ratio"),
        F.when(~regression, level).alias("balance_level"),
        ((pct > 60) & F.col("majority_value").isin(*SENTINELS)).alias("sentinel_majority"),
    )
    return out.withColumns({
        "balance_strategy": remedy[F.col("balance_level")],
        "use_weighted_metrics": F.col("balance_level") != "balanced",
    })
