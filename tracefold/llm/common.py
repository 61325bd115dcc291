"""What the operators of this subpackage share: tables, the shared folder, lineage cuts and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that every contract of this subpackage means.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset and all run here."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps reread it, and lost executors don't matter."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # the table stands for its shuffles
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Arrow batches that hold few texts, so that a Python worker's memory doesn't follow the longest ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def without(docs: DataFrame, ids: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """docs but those whose doc_id is in ids (doc_id). Up to most_rows counted ids are broadcast, more are joined."""
    gone = written(ids.distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= most_rows else gone, "doc_id", "left_anti")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, chunk_key: str, chunks: int) -> DataFrame:
    """A gapless number from 0 within keys, without a task that holds a whole key.

    Rows are numbered inside (keys, hash chunk); a small table of chunk counts gives each chunk its first number.
    """
    by = [*keys, "_chunk"]
    cut = df.withColumn("_chunk", F.pmod(F.xxhash64(chunk_key), F.lit(chunks)).cast("int"))
    counts = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*by).orderBy(*order)
    return (
        cut.withColumn("_no", F.row_number().over(inside))
        .join(first, by)
        .withColumn(name, F.col("_first") + F.col("_no") - 1)
        .drop("_chunk", "_no", "_first")
    )


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """left with the columns of right, whose keys are unique, not null and hold all of left's; rows counts a key's rows in left.

    A key is hot from a share of 1 / (4 * partitions) of the rows, so there are at most that many hot ones; they are
    broadcast, and all others are joined by a shuffle."""
    parts = 4 * partitions(left.sparkSession)
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(rows) * parts >= max(total, 1)).drop(rows))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(rows) * parts < max(total, 1)).drop(rows), key)
    return left.join(hot, key).unionByName(rest)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b), longs or strings; component is its smallest node.

    Alternates the large-star and small-star steps of the published MapReduce algorithm: each step needs one
    aggregation with map-side combine and one join. No row holds a hub's neighbours; in the joins a hub's edges share a
    key, which Spark's skew rule splits. Every round is written to the shared folder. Loops and repeated edges are
    allowed; an empty table gives an empty result.
    """
    now = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        now = written(small, "edges")
        now_is = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now_is == seen:
            break
        seen = now_is
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select("v", "v").distinct())
