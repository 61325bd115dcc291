"""Tamper-evident hash chains over a ledger's stored payloads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import scan

GENESIS = "0"


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in order with previous_hash and hash: a chain goes on over batches, and starts anew at a segment's first row."""
    before = GENESIS
    for batch in batches:
        previous, hashes = [], []
        for place, text in zip(*(batch.column(c).to_pylist() for c in ("_place", "payload"))):
            if place == 1:
                before = GENESIS
            previous.append(before)
            before = hashlib.sha256((before + (text or "")).encode()).hexdigest()
            hashes.append(before)
        more = [pa.array(previous, pa.string()), pa.array(hashes, pa.string())]
        plain = batch.drop_columns(["_place"])
        yield pa.RecordBatch.from_arrays([*plain.columns, *more], names=[*plain.schema.names, "previous_hash", "hash"])


def link(rows: DataFrame) -> DataFrame:
    """rows (ledger_id, segment, sequence, payload, ...) with previous_hash and hash; all other columns stay.

    hash = SHA-256(previous_hash followed by the payload as stored), from GENESIS in each segment: a chain is serial, so
    a segment is the least that one task links. Tasks stream over sorted segments and hold a batch of rows at a time."""
    return link_placed(placed(rows.drop("previous_hash", "hash")))


def placed(rows: DataFrame) -> DataFrame:
    """rows with _place, from 1 in each segment, and in that order; those partitioned and sorted so before are neither shuffled nor sorted."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("ledger_id", "segment").orderBy(F.asc_nulls_last("sequence"))))


def link_placed(rows: DataFrame) -> DataFrame:
    """link() for rows that placed() has put in order."""
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != "_place")
    return rows.mapInArrow(_linked, f"{kinds}, previous_hash string, hash string")


def build(rows: DataFrame, segment_size: int = 10_000) -> DataFrame:
    """rows (ledger_id, sequence, id, payload, ...) with segment, previous_hash and hash; all other columns stay.

    Segments of segment_size sequences are chained apart, see link(); heads() chains their ends, and merkle.tree() puts
    them under one root."""
    return link(rows.drop("segment").withColumn("segment", F.floor(F.col("sequence") / segment_size)))


def heads(chained: DataFrame) -> DataFrame:
    """ledger_id, segment, rows, head, and the chain of heads: dropping or reordering a segment breaks it."""
    ends = chained.groupBy("ledger_id", "segment").agg(F.max_by("hash", "sequence").alias("payload"), F.count(F.lit(1)).alias("rows"))
    linked = link(ends.select("ledger_id", F.lit(0).cast("long").alias("segment"), F.col("segment").alias("sequence"), "payload", "rows"))
    return linked.drop("segment").withColumnsRenamed({"sequence": "segment", "payload": "head"})


def broken(chained: DataFrame) -> DataFrame:
    """ledger_id, segment, first_broken: the first sequence whose link or hash is wrong, for segments that have one. Fully parallel."""
    rows = scan(chained, ["ledger_id", "segment"], ["sequence"], F.floor(F.col("sequence") / 100_000), {"_before": ("last_before", F.col("hash"))}, small=True)  # segments are bounded
    expected = F.sha2(F.concat("previous_hash", F.coalesce("payload", F.lit(""))), 256)
    bad = (F.col("previous_hash") != F.coalesce("_before", F.lit(GENESIS))) | (F.col("hash") != expected)
    return rows.where(F.coalesce(bad, F.lit(True))).groupBy("ledger_id", "segment").agg(F.min("sequence").alias("first_broken"))


def broken_heads(chained: DataFrame, stored: DataFrame) -> DataFrame:
    """ledger_id, segment, fault of the segments whose end isn't what the stored heads() say.

    missing: a stored segment has no rows. unknown: rows of a segment that isn't stored. changed: another last hash or
    number of rows. unlinked: the stored row doesn't follow the one before it. broken() tells what is wrong inside a
    segment; with both, no row and no segment can be dropped, added, swapped or changed unseen.
    """
    ends = chained.groupBy("ledger_id", "segment").agg(F.max_by("hash", "sequence").alias("_head"), F.count(F.lit(1)).alias("_rows"))
    linked = scan(stored, ["ledger_id"], ["segment"], F.floor(F.col("segment") / 100_000), {"_before": ("last_before", F.col("hash"))})
    both = linked.join(ends, ["ledger_id", "segment"], "full")
    follows = (F.col("previous_hash") == F.coalesce("_before", F.lit(GENESIS))) & (F.col("hash") == F.sha2(F.concat("previous_hash", "head"), 256))
    fault = F.when(F.col("_head").isNull(), "missing").when(F.col("head").isNull(), "unknown").when((F.col("head") != F.col("_head")) | (F.col("rows") != F.col("_rows")), "changed").when(~F.coalesce(follows, F.lit(False)), "unlinked")
    return both.select("ledger_id", "segment", fault.alias("fault")).where("fault IS NOT NULL")


def history(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """For each (ledger_id, id): the rows up to it, as place (0 is itself), sequence, ancestor."""
    at = ids.join(rows.select("ledger_id", "id", F.col("sequence").alias("_s")), ["ledger_id", "id"])
    past = rows.select("ledger_id", "sequence", F.col("id").alias("ancestor"))
    found = past.join(F.broadcast(at) if at.count() <= 10_000 else at, "ledger_id").where("sequence <= _s")
    return found.select("ledger_id", "id", (F.col("_s") - F.col("sequence")).alias("back"), "sequence", "ancestor")
