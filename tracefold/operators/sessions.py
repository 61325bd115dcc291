"""Occupancy sessions, episodes and recurring patterns from belief samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SECOND, Sessions
from ..functions.scan import fits, scan
from ..sources.shared import cut_lineage

KEY = ["ledger_id"]


def _span(us: str = "ts_us", seconds: int = 86_400) -> Column:
    return F.floor(F.col(us) / (seconds * SECOND))


def samples(beliefs: DataFrame, fusion_only: bool = True) -> DataFrame:
    """ledger_id, ts_us, sequence, p of beliefs with a probability: those of fusion, or of every stream."""
    chosen = beliefs.where("stream_id = 'fusion'") if fusion_only else beliefs
    return chosen.where("kind = 'belief' AND probability IS NOT NULL").select("ledger_id", "ts_us", "sequence", F.col("probability").alias("p"))


def occupancy(sample: DataFrame, c: Sessions = Sessions()) -> DataFrame:
    """ledger_id, start_us, end_us: hysteresis over samples in the order (ts_us, sequence).

    A run of samples over the entry threshold, or under the exit threshold, counts once it lasts its duration. A
    session lasts from the onset of an entry run to the onset of the next counting exit run, or to the last sample.
    """
    if not c.enter > 1.0 - c.exit_confidence:
        raise ValueError("the entry threshold must be over the exit threshold")
    order = ["ts_us", "sequence"]
    state = F.when(F.col("p") >= c.enter, "E").when(F.col("p") <= 1.0 - c.exit_confidence, "X").otherwise("-")
    sample = cut_lineage(sample)
    small = fits(sample, KEY)
    rows = scan(sample.withColumn("k", state), KEY, order, _span(), {"before": ("last_before", F.col("k"))}, small)
    rows = scan(rows, KEY, order, _span(), {"run": ("sum", F.when(F.col("before").eqNullSafe(F.col("k")), 0).otherwise(1).cast("long"))}, small)
    runs = rows.groupBy(*KEY, "run").agg(F.first("k").alias("k"), F.min("ts_us").alias("start"), F.max("ts_us").alias("last"))
    lasting = F.col("last") - F.col("start") >= F.when(F.col("k") == "E", c.enter_us).otherwise(c.exit_us)
    counting = cut_lineage(runs.where(F.col("k").isin("E", "X") & lasting))  # few of the samples
    hundred = F.floor(F.col("run") / 100_000)
    turns = scan(counting, KEY, ["run"], hundred, {"prior": ("last_before", F.col("k"))}, small).where("(k = 'E' AND coalesce(prior, 'X') = 'X') OR (k = 'X' AND prior = 'E')")
    numbered = scan(turns, KEY, ["run"], hundred, {"session": ("sum", (F.col("k") == "E").cast("long"))}, small)
    ends = sample.groupBy(*KEY).agg(F.max("ts_us").alias("final"))
    whole = numbered.groupBy(*KEY, "session").agg(F.min(F.when(F.col("k") == "E", F.col("start"))).alias("start_us"), F.min(F.when(F.col("k") == "X", F.col("start"))).alias("stop"))
    return whole.join(ends, KEY).select(*KEY, "start_us", F.coalesce("stop", "final").alias("end_us"))


def _grouped(sessions: DataFrame, gap_us: int) -> DataFrame:
    """sessions with index (from 0, by start and end) and group: a new one where the gap to the previous end is over gap_us."""
    order = ["start_us", "end_us"]
    sessions = cut_lineage(sessions)
    small = fits(sessions, KEY)
    rows = scan(sessions, KEY, order, _span("start_us", 30 * 86_400), {"index": ("sum_before", F.lit(1).cast("long")), "_end": ("last_before", F.col("end_us"))}, small)
    fresh = (F.col("_end").isNull() | (F.col("start_us") - F.col("_end") > gap_us)).cast("long")
    return scan(rows, KEY, order, _span("start_us", 30 * 86_400), {"group": ("sum", fresh)}, small).drop("_end")


def merged(sessions: DataFrame, c: Sessions = Sessions()) -> DataFrame:
    """Sessions apart by at most merge_us become one, which ends where the later one does."""
    return _grouped(sessions, c.merge_us).groupBy(*KEY, "group").agg(F.min("start_us").alias("start_us"), F.max_by("end_us", "index").alias("end_us")).drop("group")


def episodes(sessions: DataFrame, c: Sessions = Sessions()) -> DataFrame:
    """ledger_id, episode (from 0), start_us, end_us, members (indices of sessions)."""
    rows = _grouped(sessions, c.episode_us)
    return rows.groupBy(*KEY, "group").agg(F.min("start_us").alias("start_us"), F.max_by("end_us", "index").alias("end_us"), F.array_sort(F.collect_list("index")).alias("members")).withColumn("episode", F.col("group") - 1).drop("group")


def patterns(episode: DataFrame, c: Sessions = Sessions()) -> DataFrame:
    """ledger_id, signature, episodes: episodes of the same length in whole buckets."""
    signature = F.concat(F.lit("Occupied:"), F.floor((F.col("end_us") - F.col("start_us")) / c.bucket_us).cast("string"), F.lit("min"))
    return episode.groupBy(*KEY, signature.alias("signature")).agg(F.array_sort(F.collect_list("episode")).alias("episodes"))


def session_evidence(sessions: DataFrame, beliefs: DataFrame) -> DataFrame:
    """ledger_id, start_us, belief_id for beliefs (id, ts_us) in [start, end]: sessions are disjoint, so the latest start decides."""
    none = F.lit(None).cast("long")
    starts = sessions.select("ledger_id", F.col("start_us").alias("ts_us"), F.lit(0).alias("part"), F.lit("").alias("id"), F.struct(F.col("start_us").alias("s"), F.col("end_us").alias("e")).alias("of"))
    rows = beliefs.select("ledger_id", "ts_us", F.lit(1).alias("part"), "id", F.struct(none.alias("s"), none.alias("e")).alias("of"))
    found = scan(starts.unionByName(rows), KEY, ["ts_us", "part", "id"], _span(), {"in": ("last", F.when(F.col("part") == 0, F.col("of")))})
    return found.where((F.col("part") == 1) & (F.col("ts_us") <= F.col("in.e"))).select("ledger_id", F.col("in.s").alias("start_us"), F.col("id").alias("belief_id"))


def episode_evidence(sessions: DataFrame, evidence: DataFrame, c: Sessions = Sessions()) -> DataFrame:
    """ledger_id, episode, belief_id: what session_evidence() found for an episode's sessions."""
    of = _grouped(sessions, c.episode_us).select("ledger_id", "start_us", (F.col("group") - 1).alias("episode"))
    return evidence.join(of, ["ledger_id", "start_us"]).select("ledger_id", "episode", "belief_id").distinct()


def pattern_evidence(pattern: DataFrame, evidence: DataFrame) -> DataFrame:
    """ledger_id, signature, belief_id: what episode_evidence() found for a pattern's episodes."""
    of = pattern.select("ledger_id", "signature", F.explode("episodes").alias("episode"))
    return evidence.join(of, ["ledger_id", "episode"]).select("ledger_id", "signature", "belief_id").distinct()


def memory_records(episode: DataFrame, pattern: DataFrame) -> DataFrame:
    """ledger_id, id, kind of the records that stand for episodes and patterns; a pattern's number is its place by signature."""
    from pyspark.sql import Window

    eps = episode.select("ledger_id", F.concat_ws("-", F.lit("memory-episode"), "episode", "start_us", "end_us").alias("id"), F.lit("episode").alias("kind"))
    at = F.row_number().over(Window.partitionBy("ledger_id").orderBy("signature")) - 1
    return eps.unionByName(pattern.select("ledger_id", F.concat_ws("-", F.lit("memory-pattern"), at, "signature").alias("id"), F.lit("pattern").alias("kind")))


def to_write(records: DataFrame, stored: DataFrame) -> DataFrame:
    """records that stored (ledger_id, id) lacks: a second run writes nothing."""
    return records.join(stored.select("ledger_id", "id"), ["ledger_id", "id"], "left_anti")


def write_counts(records: DataFrame, stored: DataFrame) -> DataFrame:
    """ledger_id, kind, total, written: the records of a run, and how many of them stored (ledger_id, id) lacks."""
    fresh = to_write(records, stored).groupBy("ledger_id", "kind").agg(F.count(F.lit(1)).alias("written"))
    return records.groupBy("ledger_id", "kind").agg(F.count(F.lit(1)).alias("total")).join(fresh, ["ledger_id", "kind"], "left").fillna(0, ["written"])


def memory_counts(stored: DataFrame, episode: DataFrame, pattern: DataFrame) -> DataFrame:
    """ledger_id, episodes, patterns: the stored records' counts where either is positive, else the replay's."""
    kept = stored.groupBy("ledger_id").agg(F.sum((F.col("kind") == "episode").cast("long")).alias("se"), F.sum((F.col("kind") == "pattern").cast("long")).alias("sp"))
    now = episode.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("e")).join(pattern.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("p")), "ledger_id", "full").join(kept, "ledger_id", "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    held = (z("se") > 0) | (z("sp") > 0)
    return now.select("ledger_id", F.when(held, z("se")).otherwise(z("e")).alias("episodes"), F.when(held, z("sp")).otherwise(z("p")).alias("patterns"))
