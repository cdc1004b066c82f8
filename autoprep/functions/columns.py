"""Column expressions used across the cleaning and profiling operators.

ANSI mode raises on dirty input, so every conversion here is guarded or a ``try_`` variant.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CATEGORY_VARIANTS, NULL_TOKENS

# Fixed value: a plain decimal literal. It excludes "12d", "nan" and "inf", which a cast accepts.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Date spellings in order of preference, each with the shape that selects it.
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d'T'H:mm:ss"),
)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def col_of(name: str) -> Column:
    """Column by its literal name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_double(c: Column) -> Column:
    """Text to double; anything that is not a plain decimal literal becomes null."""
    t = F.trim(c)
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def currency_value(c: Column) -> Column:
    return safe_double(F.regexp_replace(c, r"[$,]", ""))


def percent_value(c: Column) -> Column:
    return safe_double(F.regexp_replace(c, "%", "")) / F.lit(100.0)


def null_token_to_null(c: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*[t.lower() for t in tokens]), c)


def finite_or_null(c: Column, dtype: T.DataType) -> Column:
    """NaN and both infinities to null; other types pass through."""
    if not is_fractional(dtype):
        return c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def parse_date(c: Column) -> Column:
    """First format that fits wins, so day/month beats month/day."""
    t = F.trim(c)
    tries = []
    for shape, fmt in DATE_FORMATS:
        text = F.initcap(t) if "MMM" in fmt else t
        tries.append(F.when(t.rlike(shape), F.try_to_timestamp(text, F.lit(fmt))))
    return F.coalesce(*tries)


def fold_category(c: Column, variants: dict[str, str] = CATEGORY_VARIANTS) -> Column:
    pairs = [F.lit(x) for kv in variants.items() for x in kv]
    table = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), c)


def key_hash(keys: Iterable[str], seed: int = 42, buckets: int = 10_000) -> Column:
    """Row hash in [0, buckets), the same on any partitioning and in any engine with md5."""
    text = F.concat_ws("|", *[col_of(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def distinct_token(c: Column, dtype: T.DataType) -> Column:
    """Stand-in with the same equality; long text is replaced by a digest so it does not shuffle."""
    if is_text(dtype):
        return F.when(F.octet_length(c) <= 64, c).otherwise(F.concat(F.lit("\u0001"), F.sha2(c, 256)))
    return c


def sketch_distinct(c: Column) -> Column:
    """Distinct count from a mergeable sketch, within about 1 %."""
    sketch = F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(14))
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).cast("bigint")


def share(part: Column, whole: Column, digits: int, times: int = 1) -> Column:
    """``times * part / whole`` of two counts, rounded half to even from the counts themselves; null if ``whole`` is 0.

    A quotient that lies midway between two roundings has no exact double, so engines would differ.
    """
    whole = F.nullif(whole.cast("bigint"), F.lit(0))
    top = part.cast("bigint") * (times * 10**digits)
    rest = top % whole
    down = F.round((top - rest) / whole).cast("bigint")
    up = (rest * 2 > whole) | ((rest * 2 == whole) & (down % 2 == 1))
    return (down + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(10**digits))
