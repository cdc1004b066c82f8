"""One aggregate over the whole table that decides how every column must be cleaned."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DATE_LOOKS, NULL_TOKENS
from ..functions.columns import (
    col_of,
    distinct_token,
    finite_or_null,
    is_fractional,
    is_numeric,
    is_text,
    null_token_to_null,
    parse_date,
    safe_double,
    sketch_distinct,
)

# The distinct sketch errs by about 1 %; columns within 10 % of a limit are recounted exactly.
NEAR = 0.10
# Keeps the buffer of one aggregate below the 100 fields that still compile.
COLUMNS_PER_PASS = 7

# A marker decides about a column when one value in this many carries it. The
# share over the whole column replaces a look at the first rows, so neither the row order nor
# one stray value in a huge table changes the verdict.
MARKER_SAMPLE = 20
DATE_SAMPLE = 30
QUICK_SAMPLE = 50


@dataclass
class ColumnFacts:
    """Counts of one column over the whole table."""

    name: str
    kind: str
    n: int = 0
    filled: int = 0
    tokens: int = 0
    raw_dollar: int = 0
    raw_percent: int = 0
    dollar: int = 0
    thousands: int = 0
    letter: int = 0
    percent: int = 0
    numbers: int = 0
    date_like: int = 0
    dates: int = 0
    median_year: float | None = None
    median_month: float | None = None
    median_day: float | None = None
    distinct: int = 0
    bad: int = 0
    negative: int = 0

    def _carried(self, hits: int, sample: int) -> bool:
        return hits > 0 and hits * sample >= self.filled

    @property
    def is_currency(self) -> bool:
        grouped = self._carried(self.thousands, MARKER_SAMPLE) and not self._carried(self.letter, MARKER_SAMPLE)
        return self._carried(self.dollar, MARKER_SAMPLE) or grouped

    @property
    def is_percent(self) -> bool:
        return self._carried(self.percent, MARKER_SAMPLE) and not self.is_currency

    @property
    def quick_rule(self) -> str:
        """Verdict of the light pass: only ``$`` at the start or ``%`` at the end count."""
        if self.kind != "text":
            return self.kind
        if self._carried(self.raw_dollar, QUICK_SAMPLE):
            return "currency"
        return "percent" if self._carried(self.raw_percent, QUICK_SAMPLE) else "text"

    def is_number(self, min_share: float = 0.7, min_n: int = 5) -> bool:
        return self.filled >= min_n and self.numbers >= min_share * self.filled

    @property
    def looks_dated(self) -> bool:
        return self.filled > 10 and self._carried(self.date_like, DATE_SAMPLE)

    @property
    def is_date(self) -> bool:
        return self.looks_dated and self.dates > 0.4 * self.n

    def rule(self) -> str:
        """The first cleaning rule that claims the column."""
        if self.kind == "boolean":
            return "boolean"
        if self.kind == "text":
            if self.is_currency:
                return "currency"
            if self.is_percent:
                return "percent"
            if self.is_number():
                return "number"
            if self.looks_dated:
                return "date" if self.is_date else "id"
            if self.distinct > 0.9 * self.n:
                return "id"
            return "category" if self.distinct < 0.5 * self.n else "text"
        return self.kind

    def rare_negatives(self, negatives: int | None = None, max_share: float = 0.05) -> bool:
        count = self.negative if negatives is None else negatives
        return 0 < count < max_share * self.n


def _text_counts(raw: Column, tokens) -> dict[str, Column]:
    c = null_token_to_null(raw, tokens)
    dated = c.rlike("|".join(DATE_LOOKS))
    return {
        "n": F.count(F.lit(1)),
        "filled": F.count(c),
        "tokens": F.count_if(raw.isNotNull() & c.isNull()),
        "raw_dollar": F.count_if(raw.startswith("$")),
        "raw_percent": F.count_if(raw.endswith("%")),
        "dollar": F.count_if(c.startswith("$")),
        "thousands": F.count_if(c.rlike(r"^\d+,\d{3}")),
        "letter": F.count_if(c.rlike(r"^[A-Za-z]")),
        "percent": F.count_if(c.endswith("%")),
        "numbers": F.count(safe_double(c)),
        "date_like": F.count_if(dated),
    }


def _number_counts(c: Column, dtype) -> dict[str, Column]:
    finite = finite_or_null(c, dtype)
    bad = F.count_if(c.isNotNull() & finite.isNull()) if is_fractional(dtype) else F.lit(0).cast("bigint")
    return {"n": F.count(F.lit(1)), "filled": F.count(finite), "bad": bad, "negative": F.count_if(finite < 0)}


def _date_counts(parsed: Column) -> dict[str, Column]:
    # Years, months and days have few distinct values, so the exact median buffer stays small.
    return {
        "dates": F.count(parsed),
        "median_year": F.percentile(F.year(parsed), 0.5),
        "median_month": F.percentile(F.month(parsed), 0.5),
        "median_day": F.percentile(F.dayofmonth(parsed), 0.5),
    }


def _fill(df: DataFrame, facts: dict[str, ColumnFacts], cols: list[str], counts) -> None:
    """One aggregate per ``COLUMNS_PER_PASS`` columns; every pass scans only its own columns."""
    for start in range(0, len(cols), COLUMNS_PER_PASS):
        part = cols[start:start + COLUMNS_PER_PASS]
        row = df.agg(*[
            F.struct(*[e.alias(k) for k, e in counts(c).items()]).alias(c) for c in part
        ]).first()
        for c in part:
            for k, v in row[c].asDict().items():
                setattr(facts[c], k, v)


def kind_of(dtype) -> str:
    name = dtype.typeName()
    if name == "boolean":
        return "boolean"
    if is_text(dtype):
        return "text"
    if is_numeric(dtype):
        return "numeric"
    if name in ("timestamp", "timestamp_ntz", "date"):
        return "datetime"
    return "other"


def detect(
    df: DataFrame,
    cols: list[str] | None = None,
    target: str | None = None,
    with_distinct: bool = True,
    tokens=NULL_TOKENS,
) -> dict[str, ColumnFacts]:
    """Facts for every column but the target.

    Cheap counts come first. Dates are parsed only in columns that look dated, and distinct
    values are counted only in text columns no earlier rule has claimed.
    """
    cols = [c for c in (cols or df.columns) if c != target]
    facts = {c: ColumnFacts(c, kind_of(df.schema[c].dataType)) for c in cols}

    def counts(c):
        if facts[c].kind == "text":
            return _text_counts(col_of(c), tokens)
        return _number_counts(col_of(c), df.schema[c].dataType)

    text = [c for c in cols if facts[c].kind == "text"]
    _fill(df, facts, [c for c in cols if facts[c].kind == "numeric"] + text, counts)
    value = {c: null_token_to_null(col_of(c), tokens) for c in text}
    dated = [c for c in text if facts[c].rule() in ("date", "id") and facts[c].looks_dated]
    if dated:
        # Parsed in a projection of its own, so each value is parsed once, not once per statistic.
        parsed = df.select(*[parse_date(value[c]).alias(c) for c in dated])
        _fill(parsed, facts, dated, lambda c: _date_counts(col_of(c)))
    if with_distinct:
        free = [c for c in text if not facts[c].looks_dated and facts[c].rule() in ("id", "category", "text")]
        for c, (distinct, _) in distinct_counts(df, free, (0.5, 0.9), tokens).items():
            facts[c].distinct = distinct
    return facts


def distinct_counts(df: DataFrame, cols: list[str], limits, tokens=NULL_TOKENS) -> dict[str, tuple[int, int]]:
    """``{column: (distinct values, rows)}``, sketched first and exact where near a limit."""
    facts = {c: ColumnFacts(c, "text") for c in cols}
    value = {c: null_token_to_null(col_of(c), tokens) for c in cols}
    _fill(df, facts, cols, lambda c: {"n": F.count(F.lit(1)), "distinct": sketch_distinct(value[c])})
    near = [c for c, f in facts.items() if any(abs(f.distinct - x * f.n) <= NEAR * x * f.n for x in limits)]
    _fill(df, facts, near, lambda c: {"distinct": F.count_distinct(distinct_token(value[c], df.schema[c].dataType))})
    return {c: (f.distinct, f.n) for c, f in facts.items()}


def negatives_after(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """Negative values per column once its text is parsed."""
    if not values:
        return {}
    return df.agg(*[F.count_if(v < 0).alias(c) for c, v in values.items()]).first().asDict()


def detection_table(df: DataFrame, cols: list[str] | None = None, target: str | None = None) -> DataFrame:
    """The same facts and verdict as a table with one row per column."""
    facts = detect(df, cols, target)
    rows = [(f.name, f.kind, f.rule(), f.n, f.filled, f.tokens) for f in facts.values()]
    return df.sparkSession.createDataFrame(
        rows, "column string, kind string, rule string, n_rows bigint, filled bigint, tokens bigint"
    )
