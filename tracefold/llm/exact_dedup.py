"""Exact dedup with an extendible-hash index on shared files (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, hot_join, partitions, text_or_empty, written

#: Slots of the largest directory: 2 ** MOST_DEPTH rows are all that reach the driver or a broadcast.
MOST_DEPTH = 14


def directory(counts: dict[int, int], capacity: int, most_depth: int = MOST_DEPTH) -> list[tuple[int, int, int]]:
    """(slot, bucket, local depth) of the doubled directory.

    counts: entries by slot of the full directory. A bucket over capacity splits in two, doubling the directory when
    its local depth has reached the global one; buckets in capacity keep several slots.
    """
    out = []
    open_ = [(0, 0)]
    while open_:
        depth, prefix = open_.pop()
        width = most_depth - depth
        slots = range(prefix << width, (prefix + 1) << width)
        if depth < most_depth and sum(counts.get(s, 0) for s in slots) > capacity:
            open_ += [(depth + 1, prefix * 2), (depth + 1, prefix * 2 + 1)]
        else:
            out += [(s, slots[0], depth) for s in slots]
    return sorted(out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 20) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when the same bytes remain after deleting white space (null: empty). The row with the most code
    points, then the smallest id, stays; null ids come last. Rows that repeat an id and a text are counted in
    group_size, and one of them stays. Empty texts are one group. An empty table gives no rows; only the id and the
    text are read, so other columns may have any name.

    Work: one aggregation groups texts by hash and then bytes, combined before the shuffle, so a group of copies sends
    one row from each task; it writes the index entries. Their hashes' prefixes fill buckets, and overfull buckets
    split as the directory doubles. Each owner task takes a range of buckets and walks the chain of each hash. A last
    join gives each row its group; groups with a large share of the rows are broadcast. Very long texts are read whole.
    A bucket that is still overfull at the directory's last doubling stays so: it costs time, not results.
    """
    spark = docs.sparkSession
    bare = F.regexp_replace(F.col("text"), f"{BLANK}+", "")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    pages = (
        rows.select("doc_id", F.length("text").alias("points"), bare.alias("bare"))
        .withColumn("h", F.xxhash64("bare"))
        .groupBy("h", "bare", "points")
        .agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n"))
    )
    slot = F.shiftrightunsigned("h", 64 - MOST_DEPTH).cast("int").alias("slot")
    index = written(pages.select("h", slot, F.sha2("bare", 256).alias("sha"), "points", "head", "n"), "index")
    filled = {r.slot: r.n for r in index.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}
    owners = partitions(spark)
    room = max(1, min(capacity, sum(filled.values()) // (8 * owners)))
    slots = spark.createDataFrame(directory(filled, room), "slot int, bucket int, depth int")
    first = F.min(F.struct((-F.col("points")).alias("p"), F.col("head").isNull().alias("z"), F.col("head").alias("id")))
    groups = written(
        index.join(F.broadcast(slots), "slot")
        .repartitionByRange(owners, "bucket")
        .groupBy("bucket", "h", "sha")
        .agg(first.alias("first"), F.sum("n").alias("group_size"))
        .select(F.col("sha").alias("text_sha256"), "bucket", F.col("first.id").alias("keep_id"), (-F.col("first.p")).alias("keep_points"), "group_size", F.col("group_size").alias("rows")),
        "groups",
    )
    once = Window.partitionBy("text_sha256", "doc_id").orderBy(F.col("points").desc())
    keyed = written(rows.select("doc_id", F.length("text").alias("points"), F.sha2(bare, 256).alias("text_sha256")).withColumn("_no", F.row_number().over(once)), "keyed")
    return hot_join(keyed, groups, "text_sha256", "rows").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_no") == 1) & (F.col("points") == F.col("keep_points"))).alias("kept"),
        "text_sha256",
        "bucket",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY points DESC, doc_id) AS keep_id FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
