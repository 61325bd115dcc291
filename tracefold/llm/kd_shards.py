"""Sharding by a k-d tree: weighted medians along the widest metadata dimension (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, text_or_empty, written

#: A key is coordinate (16 bits), text CRC-32 (32 bits), hash of the id (15 bits); a pass refines it down to one of these shifts.
SHIFTS = (47, 31, 15, 0)
TEXT_SHIFT = 15


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and one sort key per dimension: size, share of multi-byte text, bytes in a line."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).select(
        "doc_id",
        F.octet_length("t").cast("long").alias("bytes"),
        F.length("t").cast("long").alias("points"),
        (F.length("t") - F.length(F.replace("t", F.lit("\n"))) + 1).cast("long").alias("lines"),
        F.crc32(F.encode("t", "UTF-8")).alias("text_crc32"),
    )
    low = F.col("text_crc32") * (1 << TEXT_SHIFT) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << TEXT_SHIFT))
    at = lambda x: F.least(F.floor(x), F.lit(65535)).cast("long") * (1 << 47) + low
    return rows.select(
        "doc_id",
        (F.col("bytes") + 8).alias("size"),
        "text_crc32",
        at(F.log2(F.col("bytes") + 8) * 2048).alias("k0"),
        at(F.coalesce(F.try_divide((F.col("bytes") - F.col("points")) * 65535.0, F.col("bytes")), F.lit(0.0))).alias("k1"),
        at(F.log2(F.col("bytes") / F.col("lines") + 1) * 2048).alias("k2"),
    )


def kd_tree(meta: DataFrame, shards: int, tolerance: float = 0.001) -> Column:
    """The expression that gives a row of meta its shard.

    A node that shall hold n shards splits into n // 2 and the rest at that share of its bytes, along the dimension
    that is widest there relative to the whole table. All nodes of a level are split together: each pass sums bytes by
    node and bin of the key in executors and brings back the one bin in which each node's median lies. A median
    inside a group of equal texts moves to the group's nearer end if that costs no more than 10 tolerances of a shard.
    Only (nodes) rows reach the driver, at most shards.
    """
    spark = meta.sparkSession
    dims = [c for c in meta.columns if c.startswith("k")]
    total = meta.agg(F.sum("size")).first()[0] or 0
    slack = max(1, total / shards * tolerance)
    node: Column = F.lit(0)
    need = {0: shards}
    tree: dict[int, tuple[str, int, int, int]] = {}

    def place(n: int, names: dict[int, int]) -> Column:
        if n in tree:
            dim, cut, left, right = tree[n]
            return F.when(F.col(dim) < cut, place(left, names)).otherwise(place(right, names))
        return F.lit(names.get(n, n))

    spans = None
    fresh = 1
    while any(n > 1 for n in need.values()):
        rows = meta.withColumn("node", node)
        ends = rows.groupBy("node").agg(F.sum("size").alias("all"), *[f(F.shiftright(d, 47)).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)]).collect()
        at = {r.node: r for r in ends}
        spans = spans or {d: max(1, at[0][f"{d}_max"] - at[0][f"{d}_min"]) for d in dims} if at else {}
        todo = {n: at[n] for n, k in need.items() if k > 1 and n in at}
        state = {}  # node: dimension, key from which the open bin starts, bytes before it, wanted bytes
        for n, r in todo.items():
            dim = max(dims, key=lambda d: ((r[f"{d}_max"] - r[f"{d}_min"]) / spans[d], d == dims[0]))
            state[n] = [dim, 0, 0, r["all"] * (need[n] // 2) / need[n]]
        cuts: dict[int, int] = {}
        above = 63
        for shift in SHIFTS:
            live = [(n, dims.index(dim), start, float(wanted - before)) for n, (dim, start, before, wanted) in state.items() if n not in cuts]
            if not live:
                break
            open_ = F.broadcast(spark.createDataFrame(live, "node int, dim int, low long, want double"))
            binned = rows.join(open_, "node").select("node", "size", "low", "want", F.get(F.array(*dims), F.col("dim")).alias("key"))
            same = F.shiftright("key", above) == F.shiftright("low", above)
            sums = binned.where(same).groupBy("node", "want", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("w"))
            run = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            end = F.max("bin").over(Window.partitionBy("node"))
            reached = (F.col("run") >= F.col("want")) & (F.col("run") - F.col("w") < F.col("want"))
            found = sums.withColumn("run", F.sum("w").over(run)).withColumn("end", end).where(reached | ((F.col("bin") == F.col("end")) & (F.col("run") < F.col("want")))).collect()
            for r in found:
                n = r.node
                _, _, before, wanted = state[n]
                start, under, over = r.bin << shift, wanted - (before + r.run - r.w), before + r.run - wanted
                if shift == 0 or min(under, over) <= (10 * slack if shift == TEXT_SHIFT else slack) or r.w <= slack:
                    cuts[n] = start if under <= over else (r.bin + 1) << shift
                state[n][1:3] = [start, before + r.run - r.w]
            above = shift
        need = {n: k for n, k in need.items() if k == 1 or n in todo}  # a node without rows needs no place
        for n in todo:
            left, right = fresh, fresh + 1
            fresh += 2
            tree[n] = (state[n][0], cuts.get(n, state[n][1]), left, right)
            k = need.pop(n)
            need |= {left: k // 2, right: k - k // 2}
        node = place(0, {})
    return place(0, {n: i for i, n in enumerate(sorted(need))})


def kd_shards(docs: DataFrame, shards: int = 24, chunk_rows: int = 10_000) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 8 (null text: 8). Shards' bytes are near equal; equal texts have equal
    coordinates and stay together but where a cut must fall inside their group for the sizes' sake. slot numbers a
    shard's rows by chunks of hashed ids and then id, from 0 without gaps; rows that repeat an id and a text get
    different slots. Null ids hash alike. A text longer than a shard's share makes its shard larger than the others. An
    empty table gives no rows. Only ids and texts are read, and texts are
    read once: all else works on the small metadata table.
    """
    meta = written(metadata(docs), "meta")
    n = meta.count()
    dealt = meta.select("doc_id", "size", "text_crc32", kd_tree(meta, shards).alias("shard"))
    chunks = max(64, -(-n // (shards * chunk_rows)))
    return numbered(dealt, ["shard"], ["doc_id", "text_crc32"], "slot", "doc_id", chunks).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )
