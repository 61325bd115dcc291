"""SimHash near-dedup: fingerprints, exact band routing to shards, a BK-tree in each, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, hot_join, partitions, small_batches, written

SEED, GRAM, RADIUS = 42, 3, 3
#: Bits of the blocks: two fingerprints with at most 3 differing bits agree in one of four blocks. A block's key with more
#: than SHARD_ROWS fingerprints is split by four blocks of its remaining bits, and again.
LEVELS = (16, 12, 9)
SHARD_ROWS = 512


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII blanks alone
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= GRAM:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        length = np.fromiter(map(len, words), np.int64, n) + 1
        start = np.cumsum(length) - length
        ends = (start + length - 1)[GRAM - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(start.tolist(), ends)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(np.array(hashes[at : at + 65536], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(docs.sparkSession, size="4m")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


class BKTree:
    """Children are keyed by their distance to the parent; a search follows only edges within the radius."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The node of value; it is new if value was not in the tree."""
        values, edges = self.values, self.edges
        at = 0 if values else -1
        while at >= 0:
            d = (values[at] ^ value).bit_count()
            if d == 0:
                return at
            step = edges[at].get(d)
            if step is None:
                edges[at][d] = len(values)
                break
            at = step
        values.append(value)
        edges.append({})
        return len(values) - 1

    def within(self, value: int, radius: int = RADIUS) -> list[int]:
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.edges[at]
            if edges:
                open_ += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
        return found


def shard_links(prints: list[int]) -> list[tuple[int, int]]:
    """Links that connect what is connected among prints: at most one less than there are, not all pairs."""
    tree, root = BKTree(), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for p in prints:
        near = tree.within(p)
        node = tree.add(p)
        if node == len(root):
            root.append(node)
        for x in near:
            a, b = find(x), find(node)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((tree.values[x], p))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key; a shard may go over several of them."""
    key, held = None, []

    def done() -> pa.RecordBatch:
        got = np.array(shard_links(held), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    for batch in batches:
        keys = batch.column(0).to_numpy()
        prints = batch.column(1).to_numpy().view(np.uint64).tolist()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if keys[a] != key:
                    if len(held) > 1:
                        yield done()
                    key, held = keys[a], []
                held += prints[a:b]
    if len(held) > 1:
        yield done()


def _routes(above: dict[int, tuple[list[int], list[int]]], bits: int) -> dict[int, tuple[int, list[int], list[int]]]:
    """route: the route above it, the bit positions on which its members agree, and the remaining ones."""
    out = {}
    for up, (fixed, rest) in above.items():
        for i in range(4):
            block = rest[i * bits : (i + 1) * bits]
            out[up * 4 + i + 1] = (up, fixed + block, [p for p in rest if p not in block])
    return out


def _mask(positions: list[int]) -> int:
    m = sum(1 << p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def links(prints: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): enough links among distinct fingerprints (fp) to connect what links of RADIUS bits connect.

    A pair within 3 bits agrees in one of four blocks of its bits, so it meets in a shard keyed by that block; shards
    over shard_rows are keyed further by blocks of the remaining bits, which is as exact. Each shard is one BK-tree,
    built and searched in one pass.
    """
    spark = prints.sparkSession
    at: dict[int, tuple[list[int], list[int]]] = {0: ([], list(range(64)))}
    open_ = prints.select("fp", F.lit(0).alias("up"))
    shards = []
    for bits in LEVELS:
        routes = _routes(at, bits)
        at = {r: (fixed, rest) for r, (_, fixed, rest) in routes.items()}
        few = F.broadcast(spark.createDataFrame([(up, r, _mask(fixed)) for r, (up, fixed, _) in routes.items()], "up int, route int, mask long"))
        keyed = open_.join(few, "up").select("fp", "route", F.xxhash64("route", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
        counts = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
        last = bits == LEVELS[-1]
        small = counts if last else counts.where(F.col("n") <= shard_rows)
        shards.append(keyed.join(small, "key", "left_semi").select("key", "fp"))
        large = counts.where(F.col("n") > shard_rows)
        if last or large.isEmpty():
            break
        open_ = written(keyed.join(large, "key", "left_semi").select("fp", F.col("route").alias("up")), "open")
    every = shards[0]
    for s in shards[1:]:
        every = every.union(s)
    return every.repartition(partitions(spark), "key").sortWithinPartitions("key", "fp").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Words are what remains between white space after lower-casing A-Z; three words in a row are a shingle, repeats
    included (fewer: all of them; none, or a null text: fingerprint zero, linked like any other). Fingerprints of at
    most 3 differing bits are linked. Null ids are never a component's name unless it has no other. An empty table
    gives no rows; only the id, of any type, and the text are read. Rows that repeat share their component; a very long
    text is fingerprinted whole. A fingerprint with a large share of the rows, as of empty texts, is joined by broadcast.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fp")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "classes")
    found = components(links(classes.select("fp")))
    rooted = classes.join(found.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    names = written(rooted.join(named, "root").select("fp", "component_id", "rows"), "names")
    return hot_join(prints, names, "fp", "rows").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
