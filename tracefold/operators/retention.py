"""Retention plans and gated export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Retention
from ..functions.columns import whole_number
from .lineage import Compacted, cascade, compacted, in_range, sources
from .privacy import audit

PROTECTED = ("episode", "pattern", "agent_run")


def event_time(body: str = "body") -> Column:
    """A record's time from its parsed payload: ts_us, else timestamp_us; integers only."""
    return F.coalesce(whole_number(body, "$.ts_us"), whole_number(body, "$.timestamp_us"))


def cutoff(kind: Column, c: Retention = Retention()) -> Column:
    return F.when(kind == "observation", c.observation_us).when(kind == "belief", c.belief_us).when(kind == "event", c.event_us)


def eligible(records: DataFrame, now_us: int, c: Retention = Retention()) -> DataFrame:
    """Records (kind, recorded_us) whose age has reached their kind's cutoff; kinds without one and rows without a time never."""
    return records.where(F.lit(now_us) - F.col("recorded_us") >= cutoff(F.col("kind"), c))


def preview(records: DataFrame, now_us: int, c: Retention = Retention()) -> DataFrame:
    old = F.coalesce(F.lit(now_us) - F.col("recorded_us") >= cutoff(F.col("kind"), c), F.lit(False))
    n = lambda k: F.coalesce(F.sum((old & (F.col("kind") == k)).cast("long")), F.lit(0)).alias(f"{k}s")
    return records.agg(n("observation"), n("belief"), n("event"), F.coalesce(F.sum(F.col("kind").isin(*PROTECTED).cast("long")), F.lit(0)).alias("protected"))


def plan(records: DataFrame, edges: DataFrame, now_us: int, c: Retention = Retention()) -> DataFrame:
    """Eligible records with their sources in insertion order."""
    return eligible(records, now_us, c).join(sources(edges).withColumnRenamed("derived_id", "id"), "id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def applied(records: DataFrame, edges: DataFrame, now_us: int, confirm: bool, c: Retention = Retention(), segment_size: int = 10_000) -> Compacted:
    """What stays of records, edges and the tree over segments after erasing the eligible ones and all that derives from them."""
    if not confirm:
        raise ValueError("confirm is required")
    return compacted(records, edges, cascade(eligible(records, now_us, c).select("id"), records, edges), segment_size)


def export_bundle(records: DataFrame, edges: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Records (id, kind, ts_us, payload) in the range with their sources; rows without a time only if no bound is given.

    A record that holds a forbidden key anywhere stops the export.
    """
    chosen = records if since is None and until is None else records.join(in_range(records, since, until), "id", "left_semi")
    leak = audit(chosen.select("id", "payload")).take(1)
    if leak:
        raise PermissionError(f"{leak[0].id}: {leak[0].path}")
    return chosen.join(sources(edges).withColumnRenamed("derived_id", "id"), "id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
