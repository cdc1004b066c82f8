"""Spark-native tabular preparation and AutoML: dirty table in, scored predictions out."""

from .config import RunConfig

__all__ = ["RunConfig"]
