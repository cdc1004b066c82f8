"""Table scans, previews and prediction sinks."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NULL_TOKENS
from ..functions.columns import col_of, finite_or_null, is_fractional, is_text, null_token_to_null

# Readers by file extension.
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    null_tokens: Iterable[str] | None = NULL_TOKENS,
    multi_line: bool = True,
) -> DataFrame:
    """Scan a file or folder; text null tokens, NaN and infinities become null.

    CSV types are inferred after null tokens have gone, so a number column with ``NA`` stays one.
    ``multi_line`` reads quoted line breaks, each file in one task: turn it off for huge files that
    are known to have none, so that they are split.
    """
    fmt = fmt or FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if fmt not in FORMATS.values():
        raise ValueError(f"unsupported format for {path!r}: use one of {sorted(set(FORMATS.values()))}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    df = reader.load(path)
    if fmt == "csv" and schema is None:
        df = _typed(df, null_tokens)
    out = []
    for f in df.schema.fields:
        c = col_of(f.name)
        if is_text(f.dataType) and null_tokens is not None:
            c = null_token_to_null(c, null_tokens)
        elif is_fractional(f.dataType):
            c = finite_or_null(c, f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


# Shapes of typed text, tried in this order.
SHAPES = (
    ("int", r"[+-]?\d{1,19}"), ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"), ("boolean", "(?i:true|false)"),
    ("date", r"\d{4}-\d{2}-\d{2}"), ("timestamp", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?"),
)


def _typed(df: DataFrame, null_tokens: Iterable[str] | None) -> DataFrame:
    """Give each text column the first type that fits all its values; one pass over the table decides."""
    clean = {c: F.trim(null_token_to_null(col_of(c), null_tokens) if null_tokens is not None else col_of(c)) for c in df.columns}
    counts = []
    for i, c in enumerate(df.columns):
        v = clean[c]
        counts.append(F.count(v).alias(f"n{i}"))
        for kind, shape in SHAPES:
            fits = v.rlike(f"^({shape})$") & v.try_cast("bigint" if kind == "int" else kind).isNotNull()
            counts.append(F.count_if(fits).alias(f"{kind}{i}"))
        whole = v.try_cast("bigint")
        counts.append(F.count_if((whole > 2**31 - 1) | (whole < -(2**31))).alias(f"wide{i}"))
        # Whole numbers beyond 64 bits are keys: as doubles, different ones would become one.
        counts.append(F.count_if(v.rlike(r"^[+-]?\d{16,}$") & whole.isNull()).alias(f"long{i}"))
    row = df.agg(*counts).first()
    out = []
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        kind = next((k for k, _ in SHAPES if n and row[f"{k}{i}"] == n), None)
        if kind == "int" and row[f"wide{i}"]:
            kind = "bigint"
        if kind == "double" and row[f"long{i}"]:
            kind = None
        out.append((clean[c].try_cast(kind) if kind else col_of(c)).alias(c))
    return df.select(*out)


def write_predictions(
    df: DataFrame, path: str, fmt: str = "csv", key_cols: Iterable[str] = (), mode: str = "errorifexists"
) -> None:
    """Write a scored table as CSV (with header), Parquet, JSON or ORC; keys come first."""
    if fmt not in FORMATS.values():
        raise ValueError(f"unsupported format {fmt!r}")
    keys = list(key_cols)
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"key columns not in the table: {missing}")
    out = df.select(*[col_of(k) for k in keys], *[col_of(c) for c in df.columns if c not in keys])
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def describe_schema(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: type, filled and missing rows, missing percent, distinct values."""
    from ..operators.profile import profile_columns

    p = profile_columns(df, approx=approx)
    return p.select(
        "column", "dtype", (p["n_rows"] - p["nulls"]).alias("non_null"), "nulls", "null_pct", "unique_count"
    )
