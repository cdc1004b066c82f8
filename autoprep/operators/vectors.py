"""Feature vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col_of


def is_single(df: DataFrame, features: str | list[str]) -> bool:
    """Whether the vectors are arrays of single precision, which such arrays hold without loss."""
    return isinstance(features, str) and df.schema[features].dataType in (T.ArrayType(T.FloatType(), True), T.ArrayType(T.FloatType(), False))


def as_array(df: DataFrame, features: str | list[str], number: str = "double") -> Column:
    """One array<double> column from an array column, an ML vector or several numeric columns.

    ``number`` may be "float" where ``is_single`` holds.
    """
    if not isinstance(features, str):
        return F.array(*[col_of(c).cast("double") for c in features])
    dtype = df.schema[features].dataType
    if isinstance(dtype, T.ArrayType):
        return col_of(features).cast(f"array<{number}>")
    if dtype.typeName() == "vector" or "Vector" in type(dtype).__name__:
        return vector_to_array(col_of(features))
    return F.array(col_of(features).cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
