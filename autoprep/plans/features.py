"""Derived columns a run is asked for: fitted on training rows, stored by name, replayed on batches and streams.

A wish is ``{"new": name, "method": method, "source": [columns], "params": {…}}``. Further methods are
added with ``register``; an artifact keeps their name only, so whoever loads it registers them first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import col_of
from ..operators import transform as tf

Method = Callable[[DataFrame, str, list[str], dict], DataFrame]


def _log1p(df: DataFrame, new: str, source: list[str], params: dict) -> DataFrame:
    return tf.log1p_feature(df.withColumn(new, col_of(source[0])), new).drop(new).withColumnRenamed(f"{new}_log", new)


# Names of the methods, and how many columns each takes.
SOURCES = {"log1p": 1, "ratio": 1, "interact": 2, "str_len": 1, "keyword": 1, "date_diff": 2, "bin": 1}
_METHODS: dict[str, Method] = {
    "log1p": _log1p,
    "interact": lambda df, new, source, params: tf.interact(df, *source, new),
    "str_len": lambda df, new, source, params: tf.str_len(df, *source, new),
    "keyword": lambda df, new, source, params: tf.keyword(df, *source, params["pattern"], new),
    "date_diff": lambda df, new, source, params: tf.date_diff(df, *source, new),
}


def register(name: str, method: Method, sources: int = 1) -> None:
    """Add a method: ``method(df, new, source, params)`` returns ``df`` with the column ``new``.

    It has to decide about each row by itself, or batches and streams would not agree.
    """
    if name in SOURCES:
        raise ValueError(f"{name!r} is taken")
    SOURCES[name], _METHODS[name] = sources, method


@dataclass
class Feature:
    """One derived column; ``step`` is what was fitted, for the methods that fit anything."""

    new: str
    method: str
    source: list[str]
    params: dict = field(default_factory=dict)
    step: tf.Ratio | tf.Bin | None = None

    @classmethod
    def fit(cls, df: DataFrame, wish: dict) -> Feature:
        made = cls(wish["new"], wish["method"], list(wish.get("source", [])), dict(wish.get("params", {})))
        made._check(df)
        if made.new in df.columns:
            raise ValueError(f"feature {made.new!r} would replace a column")
        if made.method == "ratio":
            made.step = tf.Ratio.fit(df, made.source[0], made.params.get("group_col"), made.new)
        elif made.method == "bin":
            made.step = tf.Bin.fit(df, made.source[0], made.params.get("n_bins", 4), made.params.get("labels"), made.new)
        return made

    def _check(self, df: DataFrame) -> None:
        if self.method not in SOURCES:
            raise ValueError(f"feature {self.new!r}: unknown method {self.method!r}, known are {sorted(SOURCES)}")
        if len(self.source) != SOURCES[self.method]:
            raise ValueError(f"feature {self.new!r}: {self.method!r} takes {SOURCES[self.method]} columns")
        if self.method == "keyword" and not self.params.get("pattern"):
            raise ValueError(f"feature {self.new!r}: a keyword needs a pattern")
        group = self.params.get("group_col") if self.method == "ratio" else None
        lacking = [c for c in [*self.source, *([group] if group else [])] if c not in df.columns]
        if lacking:
            raise ValueError(f"feature {self.new!r}: the table lacks columns {lacking}")

    def transform(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return self.step.transform(df) if self.step else _METHODS[self.method](df, self.new, self.source, self.params)

    def save(self, folder: str) -> dict:
        doc = {"new": self.new, "method": self.method, "source": self.source, "params": self.params}
        if isinstance(self.step, tf.Bin):
            doc["fitted"] = [self.step.low, self.step.width]
        elif self.step is not None:
            doc["fitted"] = list(self.step.tables)
            for i, table in enumerate(self.step.tables.values()):
                table.write.mode("overwrite").parquet(f"{folder}/{i}")
        return doc

    @classmethod
    def load(cls, spark: SparkSession, doc: dict, folder: str) -> Feature:
        made = cls(doc["new"], doc["method"], doc["source"], doc["params"])
        if made.method == "bin":
            low, width = doc["fitted"]
            made.step = tf.Bin(made.source[0], made.new, low, width, made.params.get("n_bins", 4), made.params.get("labels"))
        elif made.method == "ratio":
            tables = {c: spark.read.parquet(f"{folder}/{i}") for i, c in enumerate(doc["fitted"])}
            made.step = tf.Ratio(made.source[0], made.params.get("group_col"), made.new, tables)
        return made


def fit_features(df: DataFrame, wishes: list[dict]) -> tuple[list[Feature], DataFrame]:
    """The fitted features in order, and the table with them; a feature may use those before it."""
    made = []
    for wish in wishes:
        made.append(Feature.fit(df, wish))
        df = made[-1].transform(df)
    return made, df


def apply_features(df: DataFrame, made: list[Feature]) -> DataFrame:
    for feature in made:
        df = feature.transform(df)
    return df


def save_features(made: list[Feature], folder: str) -> list[dict]:
    return [f.save(f"{folder}/{i}") for i, f in enumerate(made)]


def load_features(spark: SparkSession, docs: list[dict], folder: str) -> list[Feature]:
    return [Feature.load(spark, doc, f"{folder}/{i}") for i, doc in enumerate(docs)]
