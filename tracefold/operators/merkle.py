"""A hash tree over the segments of a chained ledger: a change touches its segment and the path above it only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage

#: Children of a node.
FAN_OUT = 64
BY = ["ledger_id", "level", "node"]


def leaves(chained: DataFrame) -> DataFrame:
    """ledger_id, level 0, node (the segment), rows, hash (the segment's last) of chained rows."""
    ends = chained.groupBy("ledger_id", F.col("segment").alias("node")).agg(F.count(F.lit(1)).alias("rows"), F.max_by("hash", "sequence").alias("hash"))
    return ends.select("ledger_id", F.lit(0).alias("level"), "node", "rows", "hash")


def _above(children: DataFrame, fan_out: int) -> DataFrame:
    """The nodes above children, which hold all children of each: rows are summed, and the hash covers each child's number, rows and hash in order."""
    child = F.concat_ws(":", "node", "rows", "hash")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", child.alias("text")))), lambda c: c["text"]), ";")
    up = F.floor(F.col("node") / fan_out).alias("node")
    return children.groupBy("ledger_id", F.col("level") + 1, up).agg(F.sum("rows").alias("rows"), F.sha2(text, 256).alias("hash")).toDF(*BY, "rows", "hash")


def _levels(nodes: DataFrame, fan_out: int) -> int:
    """Levels up to the one where each ledger has the single node 0."""
    most, levels = nodes.agg(F.max("node")).first()[0] or 0, 0
    while most:
        most //= fan_out
        levels += 1
    return levels


def tree(chained: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """ledger_id, level, node, rows, hash of all nodes, from the segments (level 0) to one root a ledger, node 0 of the highest level."""
    level = every = cut_lineage(leaves(chained))
    for _ in range(_levels(every, fan_out)):
        level = cut_lineage(_above(level, fan_out))
        every = every.unionByName(level)
    return every


def roots(nodes: DataFrame) -> DataFrame:
    """ledger_id, rows, root: what stands for a whole ledger."""
    return nodes.groupBy("ledger_id").agg(F.max_by("rows", "level").alias("rows"), F.max_by("hash", "level").alias("root"))


def renewed(nodes: DataFrame, changed: DataFrame, fresh: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """The tree after the segments in changed (ledger_id, segment) became the leaves in fresh, or vanished where fresh lacks them.

    fresh may hold new segments too. At each level only nodes above a change are hashed again, from their children.
    """
    past = changed.select("ledger_id", F.col("segment").alias("node")).unionByName(fresh.select("ledger_id", "node")).distinct()
    level = cut_lineage(nodes.where("level = 0").join(past, ["ledger_id", "node"], "left_anti").select(*nodes.columns).unionByName(fresh.select(*nodes.columns)))
    every = level
    for k in range(1, _levels(level, fan_out) + 1):
        past = cut_lineage(past.select("ledger_id", F.floor(F.col("node") / fan_out).alias("node")).distinct())
        parent = level.withColumn("_up", F.floor(F.col("node") / fan_out))
        dirty = parent.join(past.withColumnRenamed("node", "_up"), ["ledger_id", "_up"], "left_semi").select(*nodes.columns)
        stored = nodes.where(F.col("level") == k)
        if stored.isEmpty():  # the tree grows a level: all its nodes are new
            dirty = level
        level = cut_lineage(stored.join(past, ["ledger_id", "node"], "left_anti").select(*nodes.columns).unionByName(_above(dirty, fan_out)))
        every = every.unionByName(level)
    return every


def broken(chained: DataFrame, nodes: DataFrame, segments: DataFrame | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """ledger_id, level, node, fault where rows or stored nodes don't agree; with segments (ledger_id, segment) only of those and the paths above them.

    missing: a stored segment has no rows, or a node that others stand below isn't stored. unknown: rows of a segment that isn't
    stored, or a node without any below. changed: another last hash or number of rows, or a hash that isn't that of the
    nodes below. chain.broken() tells what is wrong inside a segment.
    """
    faults = None
    asked = None if segments is None else segments.select("ledger_id", F.col("segment").alias("node")).distinct()
    rows = chained if segments is None else chained.join(segments, ["ledger_id", "segment"], "left_semi")
    found = leaves(rows)
    for k in range(_levels(nodes, fan_out) + 1):
        stored = nodes.where(F.col("level") == k)
        held = stored if asked is None else stored.join(asked, ["ledger_id", "node"], "left_semi")
        mine = held.select("ledger_id", "node", F.col("rows").alias("_rows"), F.col("hash").alias("_hash"))
        both = found.select("ledger_id", "node", "rows", "hash").join(mine, ["ledger_id", "node"], "full")
        fault = F.when(F.col("hash").isNull(), F.lit("missing" if k == 0 else "unknown")).when(F.col("_hash").isNull(), F.lit("unknown" if k == 0 else "missing")).when((F.col("hash") != F.col("_hash")) | (F.col("rows") != F.col("_rows")), "changed")
        part = both.select("ledger_id", F.lit(k).alias("level"), "node", fault.alias("fault")).where("fault IS NOT NULL")
        faults = part if faults is None else faults.unionByName(part)
        if asked is not None:
            asked = asked.select("ledger_id", F.floor(F.col("node") / fan_out).alias("node")).distinct()
            below = stored.withColumn("_up", F.floor(F.col("node") / fan_out)).join(asked.withColumnRenamed("node", "_up"), ["ledger_id", "_up"], "left_semi").select(*nodes.columns)
            found = _above(below, fan_out)
        else:
            found = _above(stored, fan_out)
    return faults
