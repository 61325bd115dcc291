"""Roll-ups and newest-first reports over the ledger (ledger_id, sequence, id, kind, stream_id, ts_us, payload, probability)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY, SECOND

LANES, BINS, DAYS, RECENT, RECORDS = 5, 96, 30, 4096, 32
ZOOMS = (24, 96, 256, 1024, 4096)
#: What recent_observations() takes of a ledger's rows.
TIMED = "stream_id IS NOT NULL AND ts_us IS NOT NULL"


def counts(rows: DataFrame) -> DataFrame:
    n = lambda k: F.sum((F.col("kind") == k).cast("long"))
    return rows.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("total"), n("sensor_gap").alias("gaps"), n("belief").alias("beliefs"), n("agent_run").alias("agent_runs"))


def stream_counts(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'observation'").groupBy("ledger_id", "stream_id").agg(F.count(F.lit(1)).alias("n"))


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The n newest rows of each ledger; Spark keeps n of a group before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("ledger_id").orderBy(F.desc("sequence")))).where(F.col("_n") <= n).drop("_n")


def recent_records(rows: DataFrame, edges: DataFrame, n: int = RECORDS) -> DataFrame:
    top = newest(rows, n).select("ledger_id", "sequence", "id", "kind", "stream_id", "ts_us")
    own = edges.join(top.select("ledger_id", F.col("id").alias("derived_id")), ["ledger_id", "derived_id"])
    listed = own.groupBy("ledger_id", F.col("derived_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "source_id"))), lambda e: e["source_id"]).alias("sources"))
    return top.join(listed, ["ledger_id", "id"], "left").withColumn("sources", F.array_join(F.coalesce("sources", F.array().cast("array<string>")), ","))


def recent_observations(rows: DataFrame, n: int = RECENT) -> DataFrame:
    return newest(rows.where(TIMED), n).select("ledger_id", "sequence", "stream_id", "ts_us")


def latest_ts(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'observation'").groupBy("ledger_id", "stream_id").agg(F.max("ts_us").alias("ts_us"))


def age_seconds(now_us: Column, ts_us: Column) -> Column:
    return F.floor(F.greatest(now_us - ts_us, F.lit(0)) / SECOND)


def rates(rows: DataFrame) -> DataFrame:
    span = (F.max("ts_us") - F.min("ts_us")) / float(SECOND)
    return rows.where("kind = 'observation'").groupBy("ledger_id", "stream_id").agg(F.coalesce(F.try_divide(F.count(F.lit(1)), span), F.lit(0.0)).alias("rate"))


def day_buckets(rows: DataFrame, days: int = DAYS) -> DataFrame:
    each = rows.where("kind = 'observation'").groupBy("ledger_id", F.floor(F.col("ts_us") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("_n", F.row_number().over(Window.partitionBy("ledger_id").orderBy(F.desc("day")))).where(F.col("_n") <= days).drop("_n")


def telemetry(rows: DataFrame) -> DataFrame:
    """Nine figures of each stream's latest observation, one row for a ledger."""
    last = rows.where("kind = 'observation'").groupBy("ledger_id").agg(*[F.max_by("payload", F.when(F.col("stream_id") == s, F.col("sequence"))).alias(s) for s in ("camera", "microphone", "wifi", "bluetooth")])
    get = lambda s, path, kind="double": F.expr(f"try_variant_get(try_parse_json({s}), '$.{path}', '{kind}')")
    body = get("camera", "body_count", "string")
    clusters = F.expr("try_variant_get(try_parse_json(bluetooth), '$.clusters', 'array<variant>')")
    rssi = F.expr("aggregate(transform(try_variant_get(try_parse_json(bluetooth), '$.clusters', 'array<variant>'), c -> coalesce(try_variant_get(c, '$.rssi', 'double'), 0D)), 0D, (a, x) -> a + x)")
    return last.select(
        "ledger_id",
        F.when(body == "zero", 0.0).when(body.isin("one", "two_or_more"), 1.0).alias("camera_presence"),
        get("microphone", "rms").alias("audio_rms"),
        get("microphone", "spectral_centroid_hz").alias("audio_centroid_hz"),
        get("microphone", "voice_activity_probability").alias("audio_vad"),
        get("wifi", "rssi_mean").alias("wifi_rssi_mean"),
        get("wifi", "noise_mean").alias("wifi_noise_mean"),
        get("wifi", "visible_network_count").alias("wifi_network_count"),
        get("bluetooth", "cluster_count").alias("bluetooth_cluster_count"),
        F.when(F.size(clusters) > 0, rssi / F.size(clusters)).alias("bluetooth_mean_rssi"),
    )


def latest_belief(beliefs: DataFrame, edges: DataFrame) -> DataFrame:
    """Each ledger's last belief, null if a field is missing; evidence from the edges, or else from the belief itself."""
    fields = ["probability", "confidence", "disagreement", "modalities", "health", "state"]
    last = beliefs.groupBy("ledger_id").agg(F.max_by(F.struct("id", "derived_from", *fields), "arrival").alias("b")).select("ledger_id", "b.*")
    last = last.where(" AND ".join(f"{c} IS NOT NULL" for c in fields))
    own = edges.join(last.select("ledger_id", F.col("id").alias("derived_id")), ["ledger_id", "derived_id"])
    listed = own.groupBy("ledger_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "source_id"))), lambda e: e["source_id"]).alias("listed"))
    return last.join(listed, "ledger_id", "left").select("ledger_id", "id", *fields, F.array_join(F.coalesce("listed", "derived_from"), ",").alias("evidence"))


def latest_camera(rows: DataFrame) -> DataFrame:
    """The last row of any kind of the camera stream and its joints; a gap row has none."""
    last = rows.where("stream_id = 'camera'").groupBy("ledger_id").agg(F.max_by(F.struct("id", "kind", "payload"), "sequence").alias("r")).select("ledger_id", "r.*")
    return last.select("ledger_id", "id", "kind", F.expr("try_variant_get(try_parse_json(payload), '$.joints', 'array<struct<x double, y double, confidence double>>')").alias("joints"))


def agent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The n latest runs (ledger_id, sequence, id, role, layer, status, evidence); those with a missing field are dropped first."""
    return newest(runs.where("role IS NOT NULL AND layer IS NOT NULL AND status IS NOT NULL AND evidence IS NOT NULL"), n)


def density_histogram(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """ledger_id, lane, bin, n, most: rows with a stream and a time by lane and place in the ledger's span."""
    timed = rows.where("stream_id IS NOT NULL AND ts_us IS NOT NULL")
    ends = timed.groupBy("ledger_id").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    lane = F.when(F.col("stream_id") == "camera", 0).when(F.col("stream_id") == "microphone", 1).when(F.col("stream_id") == "wifi", 2).when(F.col("stream_id") == "bluetooth", 3).otherwise(LANES - 1)
    place = (F.col("ts_us") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("double")
    each = timed.join(ends, "ledger_id").groupBy("ledger_id", lane.alias("lane"), F.floor(place * (bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("most", F.max("n").over(Window.partitionBy("ledger_id")))
