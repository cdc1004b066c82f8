"""Score a stream with a fitted artifact. Nothing is fitted on the stream: every step is a
projection or a join with a stored table, so the query keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.score import Artifact


def score_stream(spark: SparkSession, folder: str, stream: DataFrame, keep: list[str] = ()) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("expected a streaming table; use plans.score for a batch")
    return Artifact.load(spark, folder).score(stream, keep)


def write_scores(scores: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append scores as Parquet; each input row is written exactly once."""
    writer = scores.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
