"""Scoring: a fitted run as an artifact that replays on new batches and on streams."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..models.ensemble import ensemble_mean, ensemble_vote
from ..models.train import KnnModel
from ..operators.transform import decode_target
from .preprocess import Preparation


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


@dataclass
class Artifact:
    """Preparation, models with their weights, class names and metadata."""

    preparation: Preparation
    models: list
    weights: list[float]
    task: str
    key: list[str]
    classes: list | None = None
    meta: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Key and kept columns plus ``prediction`` (a class code or a number)."""
        held = [*self.key, *[c for c in keep if c not in self.key]]
        data = assemble(self.preparation.transform(df, keep=held), self.preparation.features).select(
            *[col_of(c) for c in held], "features"
        )
        for i, m in enumerate(self.models):
            data = m.transform(data).withColumnRenamed("prediction", f"p{i}")
            data = data.drop("rawPrediction", "probability")
        cols = [f"p{i}" for i in range(len(self.models))]
        if len(cols) == 1:
            out = data.withColumnRenamed("p0", "prediction")
        elif self.task == "regression":
            out = ensemble_mean(data, cols, self.weights, "prediction")
        elif self.meta.get("ensemble_method") == "vote":
            out = ensemble_vote(data, cols, [1.0] * len(cols), "weighted", "prediction")
        else:
            out = ensemble_vote(data, cols, self.weights, "weighted", "prediction")
        return out.select(*[col_of(c) for c in held], "prediction")

    def score(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Like ``predict`` with class names in ``prediccion``; works on a streaming table as well."""
        out = self.predict(df, keep)
        if self.task == "classification" and self.classes is not None:
            return decode_target(out, "prediction", self.classes, "prediccion").drop("prediction")
        return out.withColumnRenamed("prediction", "prediccion")

    def save(self, spark: SparkSession, folder: str) -> None:
        """A nearest-neighbour model is its training rows: they are stored as a table, and searched anew when scoring."""
        self.preparation.save(spark, folder)
        neighbors = {}
        for i, m in enumerate(self.models):
            if isinstance(m, KnnModel):
                m.train.select(col_of(m.key), "features", "label").write.mode("overwrite").parquet(f"{folder}/models/{i}")
                neighbors[i] = {"key": m.key, "n_neighbors": m.n_neighbors, "weights": m.weights}
            else:
                PipelineModel([m]).write().overwrite().save(f"{folder}/models/{i}")
        doc = {"weights": self.weights, "task": self.task, "key": self.key, "classes": self.classes,
               "models": len(self.models), "neighbors": neighbors, "meta": self.meta, "version": 1}
        spark.createDataFrame([(json.dumps(doc, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/artifact")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Artifact:
        doc = json.loads(spark.read.text(f"{folder}/artifact").first()["value"])
        neighbors = doc.get("neighbors", {})
        models = [
            KnnModel(spark.read.parquet(f"{folder}/models/{i}"), **neighbors[str(i)]) if str(i) in neighbors
            else PipelineModel.load(f"{folder}/models/{i}") for i in range(doc["models"])
        ]
        return cls(Preparation.load(spark, folder), models, doc["weights"], doc["task"], doc["key"], doc["classes"], doc["meta"])


def score(spark: SparkSession, folder: str, df: DataFrame, keep: list[str] = ()) -> DataFrame:
    return Artifact.load(spark, folder).score(df, keep)


def scored(df: DataFrame, label: str, pred: str, task: str, keep: list[str] = ()) -> DataFrame:
    """Test table: ``actual``, ``prediccion`` and ``correcto`` or ``error_abs``."""
    y, p = col_of(label), col_of(pred)
    verdict = F.abs(y - p).alias("error_abs") if task == "regression" else (y == p).alias("correcto")
    return df.select(*[col_of(c) for c in keep], y.alias("actual"), p.alias("prediccion"), verdict)
