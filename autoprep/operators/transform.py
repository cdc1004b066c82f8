"""Fitted transforms: ``fit`` measures a training table, ``transform`` is a pure projection or lookup.

Every fitted object turns into a plain dict (``to_dict``) and, where it holds a dictionary, into
tables, so a plan can be stored and replayed on later batches or on a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SMALL_DICTIONARY_ROWS
from ..functions.columns import col_of, distinct_token, finite_or_null, is_numeric, is_text
from ..functions.indexing import number_rows
from ..functions.lookup import lookup, small_copy
from ..functions.quantiles import exact_quantiles

ONEHOT_LIMIT = 1_000
COLUMNS_PER_PASS = 20


def _replace(df: DataFrame, changed: dict[str, Column], added: dict[str, Column] | None = None) -> DataFrame:
    kept = [changed[c].alias(c) if c in changed else col_of(c) for c in df.columns if c not in (added or {})]
    return df.select(*kept, *[e.alias(k) for k, e in (added or {}).items()])


def _text_key(name: str) -> Column:
    return F.coalesce(col_of(name).cast("string"), F.lit("nan"))


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def missing_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    """``{c}_is_missing`` for the columns that have nulls."""
    gaps = df.agg(*[F.count_if(col_of(c).isNull()).alias(c) for c in cols]).first()
    return _replace(df, {}, {f"{c}_is_missing": col_of(c).isNull().cast("int") for c in cols if gaps[c]})


def column_mode(df: DataFrame, col: str):
    """Most frequent value, the smallest on ties, None when the column is empty."""
    best = (
        df.where(col_of(col).isNotNull()).groupBy(col_of(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "v").limit(1).collect()
    )
    return best[0]["v"] if best else None


@dataclass
class Imputer:
    """Fill gaps; ``drop`` removes the rows instead. Columns with gaps also get a flag."""

    values: dict[str, object] = field(default_factory=dict)
    flagged: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    kind: str = "impute"

    @classmethod
    def fit(cls, df: DataFrame, methods: dict[str, str], flags: bool = True) -> Imputer:
        unknown = set(methods.values()) - {"median", "mean", "zero", "mode", "drop"}
        if unknown:
            raise ValueError(f"unknown imputation: {sorted(unknown)}")
        out = cls(dropped=[c for c, m in methods.items() if m == "drop"])
        means = [c for c, m in methods.items() if m == "mean"]
        filled = [c for c in methods if c not in out.dropped]
        if filled:
            finite = {c: finite_or_null(col_of(c), df.schema[c].dataType) for c in filled}
            row = df.agg(
                *[F.avg(finite[c]).alias(f"mean_{i}") for i, c in enumerate(means)],
                *[F.count_if(col_of(c).isNull()).alias(f"gaps_{i}") for i, c in enumerate(filled)],
            ).first()
            out.values.update({c: row[f"mean_{i}"] for i, c in enumerate(means)})
            out.flagged = [c for i, c in enumerate(filled) if flags and row[f"gaps_{i}"]]
        medians = exact_quantiles(df, [c for c, m in methods.items() if m == "median"], [0.5])
        out.values.update({c: q[0] if q else None for c, q in medians.items()})
        for c, m in methods.items():
            if m == "zero":
                out.values[c] = 0
            elif m == "mode":
                mode = column_mode(df, c)
                out.values[c] = 0 if mode is None else mode
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        if self.dropped:
            df = df.na.drop(subset=[c for c in self.dropped if c in df.columns])
        changed = {}
        for c, v in self.values.items():
            if c in df.columns and v is not None:
                dtype = df.schema[c].dataType
                wide = "double" if is_numeric(dtype) and isinstance(v, float) else dtype
                changed[c] = F.coalesce(col_of(c).cast(wide), F.lit(v).cast(wide))
        flags = {f"{c}_is_missing": col_of(c).isNull().cast("int") for c in self.flagged if c in df.columns}
        return _replace(df, changed, flags)


def _small_tables(tables: dict[str, DataFrame], keys: list[str]) -> dict[str, DataFrame]:
    """Bring dictionaries that are small into local relations, so they are computed once."""
    out = {}
    for c, t in tables.items():
        small = small_copy(t, keys)
        out[c] = t if small is None else small
    return out


@dataclass
class Dictionary:
    """A per-column ``key -> value`` table with a default for unseen keys."""

    tables: dict[str, DataFrame]
    defaults: dict[str, float]
    kind: str

    def transform(self, df: DataFrame) -> DataFrame:
        for c, table in self.tables.items():
            if c not in df.columns:
                continue
            order = df.columns
            as_text = self.kind == "label"
            keyed = df.withColumn("__key", _text_key(c) if as_text else col_of(c))
            renamed = table.withColumnsRenamed({"key": "__key", "value": "__value", "n": "__n"})
            found = lookup(keyed, ["__key"], renamed, ["__value"], weight="__n")
            coded = F.coalesce(F.col("__value"), F.lit(self.defaults[c])).alias(c)
            df = found.select(*[coded if x == c else col_of(x) for x in order])
        return df


class LabelEncode(Dictionary):
    """Sorted distinct text values to 0..k-1; a null counts as the text ``nan``; unseen gives -1."""

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str]) -> LabelEncode:
        tables = {}
        for c in cols:
            counts = df.groupBy(_text_key(c).alias("key")).agg(F.count(F.lit(1)).alias("n"))
            small = small_copy(counts, ["key"])
            if small is not None:
                rows = sorted(small.collect(), key=lambda r: r["key"].encode())
                tables[c] = df.sparkSession.createDataFrame(
                    [(r["key"], r["n"], float(i)) for i, r in enumerate(rows)], "key string, n bigint, value double"
                )
            else:
                indexed = number_rows(counts, ["key"], "value")
                tables[c] = indexed.withColumn("value", F.col("value").cast("double"))
        return cls(tables, {c: -1.0 for c in cols}, "label")


class TargetEncode(Dictionary):
    """Unsmoothed mean of the target per category; unseen and null give the global mean."""

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str], y: str) -> TargetEncode:
        overall = df.agg(F.avg(col_of(y)).alias("m")).first()["m"]
        tables = {
            c: df.where(col_of(c).isNotNull()).groupBy(col_of(c).alias("key"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(col_of(y)).cast("double").alias("value"))
            for c in cols
        }
        return cls(_small_tables(tables, ["key"]), {c: float(overall or 0.0) for c in cols}, "target")


class FrequencyEncode(Dictionary):
    """Rows per category; unseen and null give 0."""

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str]) -> FrequencyEncode:
        tables = {
            c: df.where(col_of(c).isNotNull()).groupBy(col_of(c).alias("key")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("value", F.col("n").cast("double"))
            for c in cols
        }
        return cls(_small_tables(tables, ["key"]), {c: 0.0 for c in cols}, "frequency")


@dataclass
class OneHot:
    """``{c}_{category}`` columns for the sorted categories except the first; unseen gives all 0."""

    categories: dict[str, list[str]] = field(default_factory=dict)
    kind: str = "onehot"

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str]) -> OneHot:
        out = cls()
        for c in cols:
            values = [r["v"] for r in df.select(col_of(c).cast("string").alias("v")).distinct().limit(ONEHOT_LIMIT + 1).collect()]
            if len(values) > ONEHOT_LIMIT:
                raise ValueError(f"{c!r} has more than {ONEHOT_LIMIT} categories: use target or frequency encoding")
            known = sorted((v for v in values if v is not None), key=str.encode)
            out.categories[c] = known + (["nan"] if None in values and "nan" not in known else [])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        added, gone = {}, []
        for c, values in self.categories.items():
            if c in df.columns:
                gone.append(c)
                for v in values[1:]:
                    added[f"{c}_{v}"] = (_text_key(c) == F.lit(v)).cast("double")
        return _replace(df, {}, added).drop(*gone)


@dataclass
class Scale:
    """``(x - center) / width`` per column: ``standard``, ``minmax`` or ``robust``."""

    params: dict[str, list[float]] = field(default_factory=dict)
    kind: str = "scale"

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str], method: str = "standard") -> Scale:
        if method not in ("standard", "minmax", "robust"):
            raise ValueError(f"unknown scaling: {method!r}")
        out = cls()
        if not cols:
            return out
        if method == "robust":
            for c, q in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).items():
                out.params[c] = [q[1], q[2] - q[0]] if q else [0.0, 1.0]
        else:
            for start in range(0, len(cols), COLUMNS_PER_PASS):
                part = cols[start:start + COLUMNS_PER_PASS]
                aggs = []
                for i, c in enumerate(part):
                    v = finite_or_null(col_of(c), df.schema[c].dataType).cast("double")
                    pair = (F.avg(v), F.stddev_pop(v)) if method == "standard" else (F.min(v), F.max(v) - F.min(v))
                    aggs += [pair[0].alias(f"a{i}"), pair[1].alias(f"b{i}")]
                row = df.agg(*aggs).first()
                for i, c in enumerate(part):
                    out.params[c] = [row[f"a{i}"] or 0.0, row[f"b{i}"] or 1.0]
        out.params = {c: [a, b if b else 1.0] for c, (a, b) in out.params.items()}
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return _replace(df, {
            c: (col_of(c).cast("double") - F.lit(a)) / F.lit(b) for c, (a, b) in self.params.items() if c in df.columns
        })


def log1p_feature(df: DataFrame, cols: list[str] | str) -> DataFrame:
    """``{c}_log``; negatives count as 0, null stays null."""
    cols = [cols] if isinstance(cols, str) else cols
    return _replace(df, {}, {
        f"{c}_log": F.when(col_of(c).isNotNull(), F.log1p(F.greatest(col_of(c).cast("double"), F.lit(0.0)))) for c in cols
    })


@dataclass
class Ratio:
    """Value over the mean of its group; null results become 1, without a group the value is copied."""

    col: str
    group_col: str | None
    new: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    kind: str = "ratio"

    @classmethod
    def fit(cls, df: DataFrame, col: str, group_col: str | None, new: str) -> Ratio:
        if group_col is None:
            return cls(col, None, new)
        means = (
            df.where(col_of(group_col).isNotNull()).groupBy(col_of(group_col).alias("key"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(col_of(col)).alias("value"))
        )
        return cls(col, group_col, new, _small_tables({group_col: means}, ["key"]))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.group_col is None:
            return _replace(df, {}, {self.new: col_of(self.col)})
        keyed = df.withColumn("__key", col_of(self.group_col))
        table = self.tables[self.group_col].withColumnsRenamed({"key": "__key", "value": "__mean", "n": "__n"})
        found = lookup(keyed, ["__key"], table, ["__mean"], weight="__n")
        ratio = F.coalesce(F.try_divide(col_of(self.col), F.col("__mean")), F.lit(1.0))
        return found.select(*[col_of(c) for c in df.columns if c != self.new], ratio.alias(self.new))


def interact(df: DataFrame, a: str, b: str, new: str) -> DataFrame:
    return _replace(df, {}, {new: col_of(a) * col_of(b)})


def str_len(df: DataFrame, col: str, new: str) -> DataFrame:
    return _replace(df, {}, {new: F.coalesce(F.length(col_of(col).cast("string")), F.lit(0))})


def keyword(df: DataFrame, col: str, pattern: str, new: str) -> DataFrame:
    hit = F.coalesce(col_of(col).cast("string").rlike("(?i)" + pattern), F.lit(False))
    return _replace(df, {}, {new: hit.cast("int")})


def date_diff(df: DataFrame, a: str, b: str, new: str) -> DataFrame:
    """Whole days from ``b`` to ``a``, rounded down; null gives 0."""
    micros = F.unix_micros(col_of(a).cast("timestamp")) - F.unix_micros(col_of(b).cast("timestamp"))
    return _replace(df, {}, {new: F.coalesce(F.floor(micros / F.lit(86_400_000_000)), F.lit(0)).cast("int")})


@dataclass
class Bin:
    """Equal-width, right-closed intervals as 0..n-1, or as the given labels."""

    col: str
    new: str
    low: float
    width: float
    n_bins: int = 4
    labels: list[str] | None = None
    kind: str = "bin"

    @classmethod
    def fit(cls, df: DataFrame, col: str, n_bins: int = 4, labels: list[str] | None = None, new: str | None = None) -> Bin:
        if labels is not None and len(labels) != n_bins:
            raise ValueError("one label per bin is needed")
        v = finite_or_null(col_of(col), df.schema[col].dataType)
        row = df.agg(F.min(v).cast("double").alias("low"), F.max(v).cast("double").alias("high")).first()
        low, high = row["low"] or 0.0, row["high"] or 0.0
        if low == high:
            margin = 0.001 * abs(low) or 0.001
            low, high = low - margin, high + margin
        return cls(col, new or f"{col}_bin", low, (high - low) / n_bins, n_bins, labels)

    def transform(self, df: DataFrame) -> DataFrame:
        v = col_of(self.col).cast("double")
        slot = (F.ceil((v - F.lit(self.low)) / F.lit(self.width)) - 1).cast("int")
        slot = F.when(v.isNotNull(), F.least(F.lit(self.n_bins - 1), F.greatest(F.lit(0), slot)))
        if self.labels:
            slot = F.get(F.array(*[F.lit(x) for x in self.labels]), slot)
        return _replace(df, {}, {self.new: slot})


def near_zero_variance(df: DataFrame, eps: float = 1e-10) -> list[str]:
    """Numeric columns whose sample variance is below ``eps``, when there are more than two."""
    cols = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if len(cols) <= 2:
        return []
    low = []
    for start in range(0, len(cols), COLUMNS_PER_PASS):
        part = cols[start:start + COLUMNS_PER_PASS]
        row = df.agg(*[F.var_samp(finite_or_null(col_of(c), df.schema[c].dataType)).alias(f"v{i}") for i, c in enumerate(part)]).first()
        low += [c for i, c in enumerate(part) if row[f"v{i}"] is not None and row[f"v{i}"] < eps]
    return low


def drop_near_zero_variance(df: DataFrame, eps: float = 1e-10) -> DataFrame:
    return df.drop(*near_zero_variance(df, eps))


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value: min equals max, so no values are shuffled."""
    out = []
    for start in range(0, len(df.columns), COLUMNS_PER_PASS):
        part = df.columns[start:start + COLUMNS_PER_PASS]
        tokens = [distinct_token(finite_or_null(col_of(c), df.schema[c].dataType), df.schema[c].dataType) for c in part]
        row = df.agg(*[F.coalesce(F.min(t) == F.max(t), F.lit(True)).alias(f"k{i}") for i, t in enumerate(tokens)]).first()
        out += [c for i, c in enumerate(part) if row[f"k{i}"]]
    return out


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def target_classes(df: DataFrame, y: str) -> list:
    """Sorted distinct target values; a target with too many to be classes is refused."""
    rows = df.select(col_of(y).alias("v")).where(F.col("v").isNotNull()).distinct().limit(SMALL_DICTIONARY_ROWS + 1).collect()
    if len(rows) > SMALL_DICTIONARY_ROWS:
        raise ValueError(f"{y!r} has more than {SMALL_DICTIONARY_ROWS} distinct values")
    values = [r["v"] for r in rows]
    return sorted(values, key=str.encode if is_text(df.schema[y].dataType) else None)


def encode_target(df: DataFrame, y: str, classes: list | None = None, new: str = "label") -> DataFrame:
    """Target value to its position among the sorted classes, as a double; unknown gives null."""
    classes = target_classes(df, y) if classes is None else classes
    rows = [(v, float(i)) for i, v in enumerate(classes)]
    table = df.sparkSession.createDataFrame(rows, f"__class {df.schema[y].dataType.simpleString()}, `{new}` double")
    joined = df.join(F.broadcast(table), col_of(y) == F.col("__class"), "left")  # at most SMALL_DICTIONARY_ROWS rows
    return joined.select(*[col_of(c) for c in df.columns if c != new], col_of(new))


def decode_target(df: DataFrame, pred: str, classes: list, new: str) -> DataFrame:
    """Positions back to target values; null for positions no class has."""
    rows = list(enumerate(classes))
    kind = df.select(F.array(*[F.lit(v) for v in (classes[0], classes[-1])])[0].alias("v")).schema["v"].dataType.simpleString() if classes else "string"
    table = df.sparkSession.createDataFrame(rows, f"__code int, `{new}` {kind}")
    joined = df.join(F.broadcast(table), col_of(pred).cast("int") == F.col("__code"), "left")  # at most SMALL_DICTIONARY_ROWS rows
    return joined.select(*[col_of(c) for c in df.columns if c != new], col_of(new))
