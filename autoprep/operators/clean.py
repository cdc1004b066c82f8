"""Cleaning: decide once per column from whole-table facts, then apply one projection."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORY_VARIANTS, DATE_PART_SUFFIXES, NULL_TOKENS
from ..functions.columns import (
    col_of,
    currency_value,
    finite_or_null,
    fold_category,
    is_datetime,
    is_numeric,
    is_text,
    null_token_to_null,
    parse_date,
    percent_value,
    safe_double,
)
from ..functions.quantiles import exact_quantiles
from .detect import ColumnFacts, detect, distinct_counts, negatives_after


def _replace(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """All replacements in one projection."""
    return df.select(*[changed[c].alias(c) if c in changed else col_of(c) for c in df.columns])


def _text_cols(df: DataFrame, cols: Iterable[str] | None) -> list[str]:
    return [c for c in (cols or df.columns) if is_text(df.schema[c].dataType)]


def _number_cols(df: DataFrame, cols: Iterable[str] | None) -> list[str]:
    return [c for c in (cols or df.columns) if is_numeric(df.schema[c].dataType)]


def normalize_nulls(df: DataFrame, cols=None, tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    return _replace(df, {c: null_token_to_null(col_of(c), tokens) for c in _text_cols(df, cols)})


def bool_to_int(df: DataFrame, cols=None) -> DataFrame:
    names = [c for c in (cols or df.columns) if df.schema[c].dataType.typeName() == "boolean"]
    return _replace(df, {c: col_of(c).cast("int") for c in names})


def parse_currency(df: DataFrame, cols=None) -> DataFrame:
    """Money text to double, for the columns whose content says so."""
    facts = detect(df, _text_cols(df, cols), with_distinct=False)
    return _replace(df, {c: currency_value(col_of(c)) for c, f in facts.items() if f.is_currency})


def parse_percent(df: DataFrame, cols=None) -> DataFrame:
    """Percent text to a fraction; values without the sign are divided by 100 as well."""
    facts = detect(df, _text_cols(df, cols), with_distinct=False)
    return _replace(df, {c: percent_value(col_of(c)) for c, f in facts.items() if f.is_percent})


def coerce_numeric(df: DataFrame, cols=None, min_share: float = 0.7, min_n: int = 5) -> DataFrame:
    facts = detect(df, _text_cols(df, cols), with_distinct=False)
    return _replace(df, {c: safe_double(col_of(c)) for c, f in facts.items() if f.is_number(min_share, min_n)})


def detect_dates(df: DataFrame, cols=None) -> list[str]:
    """Text columns with more than 10 values of which at least one looks like a date."""
    return [c for c, f in detect(df, _text_cols(df, cols), with_distinct=False).items() if f.looks_dated]


def parse_dates(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return _replace(df, {c: parse_date(col_of(c)) for c in cols})


def date_verdict(facts: ColumnFacts) -> str:
    """``date`` when more than 40 % of all rows parse, ``id`` when it only looks dated, else ``none``."""
    if not facts.looks_dated:
        return "none"
    return "date" if facts.is_date else "id"


def _date_parts(name: str, ts: Column, fills: list) -> list[Column]:
    parts = [F.year(ts), F.month(ts), F.dayofmonth(ts), F.weekday(ts)]
    return [
        F.coalesce(p.cast("double"), F.lit(None if v is None else float(v)).cast("double")).alias(f"{name}_{suffix}")
        for p, v, suffix in zip(parts, [*fills, 2.0], DATE_PART_SUFFIXES)
    ]


def expand_dates(df: DataFrame, cols=None) -> DataFrame:
    """Replace each parsable date text column by year, month, day and weekday (Monday 0)."""
    facts = detect(df, _text_cols(df, cols), with_distinct=False)
    out = []
    for c in df.columns:
        f = facts.get(c)
        if f is not None and f.is_date:
            out += _date_parts(c, parse_date(col_of(c)), [f.median_year, f.median_month, f.median_day])
        else:
            out.append(col_of(c))
    return df.select(*out)


def normalize_categories(df: DataFrame, cols=None, variants: dict[str, str] = CATEGORY_VARIANTS) -> DataFrame:
    counts = distinct_counts(df, _text_cols(df, cols), limits=(0.5,))
    return _replace(df, {c: fold_category(col_of(c), variants) for c, (d, n) in counts.items() if d < 0.5 * n})


def detect_ids(df: DataFrame, cols=None, threshold: float = 0.9) -> list[str]:
    """Text columns in which more than ``threshold`` of the rows hold different values."""
    counts = distinct_counts(df, _text_cols(df, cols), limits=(threshold,))
    return [c for c, (d, n) in counts.items() if d > threshold * n]


def drop_ids(df: DataFrame, cols=None, threshold: float = 0.9) -> DataFrame:
    return df.drop(*detect_ids(df, cols, threshold))


def inf_to_null(df: DataFrame, cols=None) -> DataFrame:
    return _replace(df, {c: finite_or_null(col_of(c), df.schema[c].dataType) for c in _number_cols(df, cols)})


def mask_rare_negatives(df: DataFrame, cols=None, max_share: float = 0.05) -> DataFrame:
    """Negatives become null where they are fewer than ``max_share`` of all rows."""
    facts = detect(df, _number_cols(df, cols), with_distinct=False)
    rare = [c for c, f in facts.items() if f.rare_negatives(max_share=max_share)]
    return _replace(df, {c: F.when(~(col_of(c) < 0), col_of(c)) for c in rare})


def dedup(df: DataFrame, subset: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Distinct rows, nulls equal. The partial aggregate keeps one copy per task before the shuffle.

    With a ``subset`` of columns, rows equal in them are copies; the smallest by ``order`` and then by
    the other columns stays.
    """
    if subset is None:
        return df.dropDuplicates()
    first = ([order] if order else []) + [c for c in df.columns if c not in subset and c != order]
    kept = df.groupBy(*[col_of(c) for c in subset]).agg(F.min(F.struct(*[col_of(c) for c in first])).alias("__kept")) if first else df.select(*[col_of(c) for c in subset]).distinct()
    return kept.select(*[col_of(c) if c in subset and c != order else F.col("__kept").getField(c).alias(c) for c in df.columns])


def outlier_bounds(df: DataFrame, cols=None, k: float = 3.0, lo: float = 0.01, hi: float = 0.10) -> dict[str, tuple]:
    """``{column: (lower, upper)}`` for the columns whose outlier share lies strictly in (lo, hi)."""
    cols = _number_cols(df, cols)
    quartiles = exact_quantiles(df, cols, [0.25, 0.75])
    bounds = {}
    for c in cols:
        if quartiles[c] and quartiles[c][1] - quartiles[c][0] > 0:
            q1, q3 = quartiles[c]
            bounds[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    if not bounds:
        return {}
    names = list(bounds)
    values = {c: finite_or_null(col_of(c), df.schema[c].dataType) for c in names}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if((values[c] < F.lit(bounds[c][0])) | (values[c] > F.lit(bounds[c][1]))).alias(f"o{i}")
        for i, c in enumerate(names)
    ]).first()
    return {c: bounds[c] for i, c in enumerate(names) if lo < row[f"o{i}"] / row["n"] < hi}


def apply_bounds(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    clipped = {}
    for c, (low, high) in bounds.items():
        if c in df.columns:
            v = col_of(c).cast("double")
            clipped[c] = F.when(col_of(c).isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))
    return _replace(df, clipped)


def cap_outliers(df: DataFrame, cols=None, k: float = 3.0, lo: float = 0.01, hi: float = 0.10) -> DataFrame:
    return apply_bounds(df, outlier_bounds(df, cols, k, lo, hi))


@dataclass
class CleaningPlan:
    """What to do with each column; fitted once, replayed on any later batch or stream."""

    rules: dict[str, str] = field(default_factory=dict)
    fills: dict[str, list] = field(default_factory=dict)
    masked: list[str] = field(default_factory=list)
    with_tokens: list[str] = field(default_factory=list)
    with_inf: list[str] = field(default_factory=list)
    log_rows: list[tuple] = field(default_factory=list)

    @property
    def ids(self) -> list[str]:
        return [c for c, r in self.rules.items() if r == "id"]

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for name in df.columns:
            c, rule = col_of(name), self.rules.get(name)
            dtype = df.schema[name].dataType
            if is_text(dtype) and rule is not None:
                c = null_token_to_null(c) if name in self.with_tokens else c
                if rule == "currency":
                    c = currency_value(c)
                elif rule == "percent":
                    c = percent_value(c)
                elif rule == "number":
                    c = safe_double(c)
                elif rule == "category":
                    c = fold_category(c)
                elif rule == "date":
                    out += _date_parts(name, parse_date(c), self.fills[name])
                    continue
            elif rule == "boolean":
                c = c.cast("int")
            elif rule == "datetime_parts" and is_datetime(dtype):
                out += _date_parts(name, c, self.fills[name])
                continue
            elif rule == "numeric":
                c = finite_or_null(c, dtype)
            if name in self.masked:
                c = F.when(~(c < 0), c)
            out.append(c.alias(name))
        return df.select(*out)

    def log(self, spark) -> DataFrame:
        return spark.createDataFrame(self.log_rows, "column string, rule string")

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> CleaningPlan:
        return cls(**{**d, "log_rows": [tuple(r) for r in d["log_rows"]]})


# Name of the log entry each rule leaves.
LOG_NAMES = {
    "currency": "parsed_currency",
    "percent": "parsed_pct",
    "number": "coerced_numeric",
    "date": "parsed_dates",
    "datetime_parts": "parsed_dates",
    "category": "normalized_cats",
    "id": "ids_detected",
    "boolean": "bools_converted",
}


def fit_quick_clean(df: DataFrame, target: str | None = None) -> CleaningPlan:
    """Light pass before profiling: infinities, ``$`` money, ``%`` text, rare negatives."""
    plan = CleaningPlan()
    facts = detect(df, target=target, with_distinct=False)
    parsers = {"currency": currency_value, "percent": percent_value}
    parsed = {c: parsers[f.quick_rule](col_of(c)) for c, f in facts.items() if f.quick_rule in parsers}
    negatives = negatives_after(df, parsed)
    for c, f in facts.items():
        if c in parsed or f.kind == "numeric":
            plan.rules[c] = f.quick_rule
            if f.rare_negatives(negatives.get(c, f.negative)):
                plan.masked.append(c)
        _log(plan, c, f)
    return plan


def fit_clean(df: DataFrame, target: str | None = None, native_dates: bool = False) -> CleaningPlan:
    """Full cleaning; the first rule that claims a column ends its treatment.

    ``native_dates`` also expands date and timestamp columns into their parts.
    """
    plan = CleaningPlan()
    facts = detect(df, target=target)
    for c, f in facts.items():
        rule = f.rule()
        if rule == "datetime" and native_dates:
            rule = "datetime_parts"
        if rule not in ("datetime", "other"):
            plan.rules[c] = rule
        if f.kind == "text":
            plan.with_tokens.append(c)
        if rule == "date":
            plan.fills[c] = [f.median_year, f.median_month, f.median_day]
        if rule == "numeric" and f.rare_negatives():
            plan.masked.append(c)
        _log(plan, c, f)
    native = [c for c, r in plan.rules.items() if r == "datetime_parts"]
    if native:
        row = df.agg(*[
            F.array(*[F.percentile(part(col_of(c)), 0.5) for part in (F.year, F.month, F.dayofmonth)]).alias(c)
            for c in native
        ]).first()
        plan.fills.update({c: list(row[c]) for c in native})
    return plan


def _log(plan: CleaningPlan, c: str, f: ColumnFacts) -> None:
    if f.tokens and c in plan.with_tokens:
        plan.log_rows.append((c, "nulls_normalized"))
    rule = plan.rules.get(c)
    if rule in LOG_NAMES:
        plan.log_rows.append((c, LOG_NAMES[rule]))
    if rule == "numeric" and f.bad:
        plan.with_inf.append(c)
        plan.log_rows.append((c, "inf_handled"))


def quick_clean(df: DataFrame, target: str | None = None) -> DataFrame:
    return fit_quick_clean(df, target).transform(df)


def clean(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(cleaned table, log)``; identifier columns are kept and listed in the log."""
    plan = fit_clean(df, target)
    return plan.transform(df), plan.log(df.sparkSession)


def cleaning_log(df: DataFrame, target: str | None = None) -> DataFrame:
    return fit_clean(df, target).log(df.sparkSession)
