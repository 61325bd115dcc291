"""Sequences that go on where the last run stopped: high-water marks advanced by conditional commits."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import assign_sequence

KEYS = ["ledger_id", "sensor_stream_id"]


def _storage(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, path: str, content: str) -> bool:
    """Whether this call put the file there, whole: of several that try, one does, where a rename never replaces a file
    (HDFS; on stores without such renames, runs must not overlap)."""
    fs, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    draft, final = fs.Path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"), fs.Path(path)
    storage = _storage(spark, path)
    out = storage.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    kind = getattr(fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        fs.FileContext.getFileContext(storage.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, how)
    except Exception as e:  # noqa: BLE001
        if "AlreadyExists" in str(e):
            storage.delete(draft, False)
            return False
        raise
    return True


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits so far in order: version, batch, and the folder that holds its rows and marks."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    storage = _storage(spark, path)
    if not storage.exists(Path(f"{path}/commits")):
        return []
    names = sorted(f.getPath().getName() for f in storage.listStatus(Path(f"{path}/commits")) if not f.getPath().getName().startswith("."))
    return [r.asDict() for r in spark.read.schema("version long, batch string, folder string").json([f"{path}/commits/{n}" for n in names]).orderBy("version").collect()] if names else []


def marks(spark: SparkSession, path: str) -> DataFrame:
    """ledger_id, sensor_stream_id, mark: the last sequence that was given out."""
    done = commits(spark, path)
    return spark.read.parquet(f"{done[-1]['folder']}/marks") if done else spark.createDataFrame([], "ledger_id long, sensor_stream_id string, mark long")


def allocated(rows: DataFrame, path: str, batch: str, most_tries: int = 100, before_commit=None) -> DataFrame:
    """rows (ledger_id, sensor_stream_id, arrival, ...) of a batch with sequence, going on from the marks in path.

    Rows and new marks are written to a folder of their own, and a commit file of the next version, which only one run can create,
    makes both count. A run that loses the race reads the winner's marks and numbers its rows again; a batch that was
    committed before is returned as it was. So neither a restart at any point nor a race leaves a gap or gives a number twice.
    before_commit() is called before each try of a commit.
    """
    spark = rows.sparkSession
    for _ in range(most_tries):
        done = commits(spark, path)
        mine = [c for c in done if c["batch"] == batch]
        if mine:
            return spark.read.parquet(f"{mine[0]['folder']}/rows")
        old = spark.read.parquet(f"{done[-1]['folder']}/marks") if done else spark.createDataFrame([], "ledger_id long, sensor_stream_id string, mark long")
        past = F.broadcast(old) if old.count() <= 200_000 else old
        folder = f"{path}/data/{uuid.uuid4().hex}"
        numbered = assign_sequence(rows, 1).join(past, KEYS, "left")
        numbered.withColumn("sequence", F.col("sequence") + F.coalesce("mark", F.lit(0))).drop("mark").write.parquet(f"{folder}/rows")
        new = spark.read.parquet(f"{folder}/rows").groupBy(*KEYS).agg(F.max("sequence").alias("mark"))
        old.unionByName(new).groupBy(*KEYS).agg(F.max("mark").alias("mark")).write.parquet(f"{folder}/marks")
        if before_commit:
            before_commit()
        version = len(done)
        if _claim(spark, f"{path}/commits/{version:012d}.json", json.dumps({"version": version, "batch": batch, "folder": folder})):
            return spark.read.parquet(f"{folder}/rows")
    raise RuntimeError(f"lost {most_tries} races")
