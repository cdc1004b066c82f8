"""Intermediate tables in the cluster's shared folder, and columns that survive clashing names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.lineage import shared_folder


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: lost executors cost no recomputation."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete tables that ``saved`` wrote and that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getName().startswith("llm-"):
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
                break


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it finds only when the driver collects garbage."""
    spark._jvm.System.gc()


def local_folder(path: str) -> str:
    """A shared folder as tasks open it: the folder has to be mounted on every executor."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {path}")
    return path.removeprefix("file://").removeprefix("file:")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
