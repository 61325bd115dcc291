"""The folder that driver and executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; our own folder only where none is set and all run here."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so that lost executors cost no recomputation."""
    spark, drop = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = shared_path(spark, "cut"), spark.conf.get(drop, "false")
    spark.conf.set(drop, "true")  # what the write shuffled is of no use once it is written, and would else stay on disk beside it
    try:
        df.write.option("compression", "zstd").parquet(path)  # hashes in hex take half of what they do without entropy coding
    finally:
        spark.conf.set(drop, before)
    return spark.read.schema(df.schema).parquet(path)
