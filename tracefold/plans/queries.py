"""Registered queries: each operator over its derived view of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DAY, SECOND
from ..functions import columns as C
from ..operators import calibration as cal
from ..functions.scan import fits, scan
from ..operators import chain, features, ingest, lineage, merkle, privacy, retention, rollups, sessions, validate
from ..sources import tables
from ..sources.tables import cut_lineage
from .views import lines, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ACK_US, AGENT_US, HMAC_KEY = 10_000_000_000, 20_000_000_000, b"local-pseudonym-key"
FRAME, RATE = 64, 48_000.0


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(c: str | Column, digits: int = 6) -> Column:
    """A double that both engines print alike."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def env(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "envelopes")


def gapped(s: SparkSession, d: str, payload: bool = False) -> DataFrame:
    return ingest.with_gaps(ingest.signalled(env(s, d), payload=payload))


def beliefs(s: SparkSession, d: str) -> DataFrame:
    return ingest.belief_table(ingest.beliefs(env(s, d)))


def stored(s: SparkSession, d: str, payload: bool = False) -> tuple[DataFrame, DataFrame]:
    """Envelopes with their gaps, validated and scanned once for all that reads them, and the beliefs made from them."""
    found = cut_lineage(gapped(s, d, payload))
    return found, ingest.belief_table(ingest.believed(found, small=fits(found, ["ledger_id"])))


def ledger(s: SparkSession, d: str, payload: bool = False) -> DataFrame:
    return ingest.ledger(*stored(s, d, payload))


def recent(s: SparkSession, d: str, n: int = rollups.RECENT) -> DataFrame:
    rows = ingest.entries(*stored(s, d)).select("ledger_id", "arrival", "part", "stream_id", "ts_us")
    return rollups.recent_observations(ingest.recent(rows, n, rollups.TIMED), n)


def samples(s: SparkSession, d: str, held: DataFrame | None = None) -> DataFrame:
    return (beliefs(s, d) if held is None else held).select("ledger_id", "ts_us", F.col("arrival").alias("sequence"), F.col("probability").alias("p"))


def merged(s: SparkSession, d: str, held: DataFrame | None = None) -> DataFrame:
    return sessions.merged(sessions.occupancy(samples(s, d, held)))


def episodes(s: SparkSession, d: str) -> DataFrame:
    return sessions.episodes(merged(s, d))


def remembered(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Beliefs, made once, and the sessions over them."""
    held = cut_lineage(beliefs(s, d))
    return held, cut_lineage(merged(s, d, held))


# Sources and validation


@query
def envelope_scan(s, d):
    return env(s, d)


@query
def ledger_scan(s, d):
    rows = tables.ledger_scan(view(s, d, "chain_rows").withColumn("payload", F.when(F.col("sequence") % 10 == 0, F.lit("{broken")).otherwise(F.col("payload"))))
    return rows.select("ledger_id", "sequence", F.expr("try_variant_get(body, '$.k', 'bigint')").alias("k"))


@query
def label_scan(s, d):
    """Labels written as JSON lines, with blank lines between, and read back."""
    path = tables.shared_path(s, "labels")
    lines = view(s, d, "fusion_labels").select(F.concat(F.to_json(F.struct("ts_us", "occupied")), F.lit("\n")).alias("value"))
    lines.write.text(path)
    return tables.labels(s, path).select("ts_us", "occupied")


@query
def ledger_append(s, d):
    """The ledger appended in two batches that overlap: what readers of committed batches see."""
    path = tables.shared_path(s, "ledger")
    found, held = stored(s, d)
    held = cut_lineage(held)
    rows, links = cut_lineage(ingest.ledger(found, held).select("ledger_id", "sequence", "id", "kind")), ingest.evidence_edges(held)
    tables.append(rows.where("kind <> 'belief'"), links, path, "1")
    tables.append(rows, links, path, "2")
    return tables.committed(s, path, "events").select("ledger_id", "sequence", "id", "kind")


@query
def raw_media_audit(s, d):
    """Capture files, named after events, that hold raw media."""
    return tables.media_paths(view(s, d, "capture_files"))


def _checked(name: str, check: Callable[[], Column], stream: str | None = None) -> None:
    def run(s, d):
        rows = env(s, d)
        rows = rows if stream is None else rows.where(F.col("sensor_stream_id").isin(*stream.split(",")))
        return rows.select("arrival", check().alias("ok"))

    run.__name__ = name
    query(run)


_checked("validate_schema_version", validate.version_ok)
_checked("validate_message_id", lambda: validate.message_id_ok(validate.Ingest(most_id_bytes=4)))
_checked("validate_size", lambda: validate.size_ok(validate.Ingest(most_payload_bytes=40)))
_checked("validate_json", lambda: validate.json_ok() & validate.object_ok())
_checked("validate_stream", validate.stream_ok)
_checked("validate_camera", validate.camera_ok, "camera")
_checked("validate_bluetooth", validate.bluetooth_ok, "bluetooth")
_checked("validate_numeric_streams", validate.shape_ok, "microphone,wifi")


@query
def validate_keys(s, d):
    return env(s, d).select("arrival", validate.offending_key().alias("field"))


@query
def ingest_rejects(s, d):
    return validate.classified(env(s, d)).select("ledger_id", "arrival", "message_id", "status")


@query
def ingest_dedup(s, d):
    return validate.accepted(env(s, d)).select("ledger_id", "arrival", "message_id")


# Gaps and fusion


@query
def sequence_gaps(s, d):
    return ingest.gap_rows(gapped(s, d)).select("ledger_id", "id", "ts_us", "arrival")


@query
def ledger_build(s, d):
    return ledger(s, d, True).select("ledger_id", "sequence", "id", "kind", "stream_id", "ts_us", "payload")


@query
def silent_gaps(s, d):
    return gapped(s, d).where("silent").select("ledger_id", "sensor_stream_id", "arrival", "message_id")


@query
def gap_state(s, d):
    return ingest.gap_state(gapped(s, d))


@query
def pending_gap_streams(s, d):
    return ingest.gap_state(gapped(s, d)).where("pending").select("ledger_id", "sensor_stream_id")


@query
def belief_guard(s, d):
    return gapped(s, d).where("NOT pending").select("ledger_id", "arrival", "sensor_stream_id")


@query
def acknowledge_gaps(s, d):
    return ingest.acknowledged(gapped(s, d), ["camera", "wifi"], ACK_US)


@query
def asof_latest(s, d):
    return ingest.asof(gapped(s, d)).select("ledger_id", "arrival", *[F.col(f"{m}.{c}").alias(f"{m}_{c}") for m in ingest.MODALITIES for c in ("id", "ts_us")])


@query
def fusion_signals(s, d):
    return validate.accepted(env(s, d)).select("arrival", r(ingest.signal()).alias("signal"))


@query
def sensor_freshness(s, d):
    rows = ingest.asof(gapped(s, d))
    return rows.select("arrival", *[r(C.freshness(F.col("captured_at_utc_us"), F.col(f"{m}.ts_us"), 10 * SECOND)).alias(m) for m in ingest.MODALITIES])


@query
def fusion_probability(s, d):
    return ingest.fused(ingest.asof(gapped(s, d))).select("arrival", r("probability").alias("probability"))


@query
def fusion_beliefs(s, d):
    return beliefs(s, d).select("ledger_id", "id", "source_observation_id", "ts_us", r("probability").alias("probability"), r("confidence").alias("confidence"), r("disagreement").alias("disagreement"), "modalities", r("health").alias("health"), "state")


@query
def fusion_evidence(s, d):
    return ingest.evidence_edges(beliefs(s, d))


@query
def fallback_belief(s, d):
    rows = ingest.fallback_belief(rollups.telemetry(ledger(s, d, True)))
    return rows.select("ledger_id", r("probability").alias("probability"), r("confidence").alias("confidence"), r("disagreement").alias("disagreement"), "modalities", "state")


@query
def anchor_downgrade(s, d):
    return beliefs(s, d).select("id", r(ingest.anchor_downgrade(F.col("disagreement"), F.col("confidence"), 0.5)).alias("confidence"))


# Sessions


@query
def belief_samples(s, d):
    return sessions.samples(ledger(s, d)).select("ledger_id", "ts_us", "sequence", r("p").alias("p"))


@query
def occupancy_sessions(s, d):
    return sessions.occupancy(samples(s, d))


@query
def merge_sessions(s, d):
    return merged(s, d)


def _text(array: str) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",").alias(array)


@query
def episodes_(s, d):
    return episodes(s, d).select("ledger_id", "episode", "start_us", "end_us", _text("members"))


QUERIES["episodes"] = QUERIES.pop("episodes_")


@query
def patterns(s, d):
    return sessions.patterns(episodes(s, d)).select("ledger_id", "signature", _text("episodes"))


@query
def session_evidence(s, d):
    held, found = remembered(s, d)
    return sessions.session_evidence(found, held)


@query
def episode_evidence(s, d):
    held, found = remembered(s, d)
    return sessions.episode_evidence(found, sessions.session_evidence(found, held))


@query
def pattern_evidence(s, d):
    held, found = remembered(s, d)
    return sessions.pattern_evidence(sessions.patterns(sessions.episodes(found)), sessions.episode_evidence(found, sessions.session_evidence(found, held)))


@query
def materialize_counts(s, d):
    """A second run over records of which those of even ledgers are stored."""
    found = episodes(s, d)
    every = sessions.memory_records(found, sessions.patterns(found))
    return sessions.write_counts(every, every.where("ledger_id % 2 = 0"))


@query
def materialize_memory(s, d):
    found = episodes(s, d)
    return sessions.memory_records(found, sessions.patterns(found))


@query
def memory_counts(s, d):
    found = episodes(s, d)
    kept = sessions.memory_records(found, sessions.patterns(found)).where("ledger_id % 2 = 0 AND kind = 'episode'")
    return sessions.memory_counts(kept, found, sessions.patterns(found))


# Calibration


@query
def calibration_match(s, d):
    return cal.matched(samples(s, d), view(s, d, "fusion_labels")).select("ledger_id", "line_no", "sequence", r("p").alias("p"), "occupied")


@query
def calibration_metrics(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 8).alias("ledger_id"), (F.col("value") / 100.0).alias("p"), (F.col("event_id") % 3 == 0).alias("occupied"))
    return cal.metrics(rows, ["ledger_id"]).select("ledger_id", "n", *[r(c).alias(c) for c in ("accuracy", "brier", "precision", "recall")])


def _report(s: SparkSession, d: str) -> DataFrame:
    labels = view(s, d, "fusion_labels")
    found = cal.report(cal.matched(samples(s, d), labels, SECOND // 2), labels, SECOND // 2)
    return found.select("ledger_id", "labels", "matched", *[r(c).alias(c) for c in ("accuracy", "brier", "precision", "recall")], "unmatched", "max_offset_us")


@query
def calibration_report(s, d):
    return _report(s, d)


@query
def calibration_report_sink(s, d):
    """The report written as JSON and read back."""
    rows, path = _report(s, d), tables.shared_path(s, "calibration-report")
    tables.write_report(rows, path)
    return s.read.schema(rows.schema).json(path)


# Chains and lineage

SEGMENT, ERASED_SEGMENT, TREE_SEGMENT = 2000, 200, 50


def chained(s: SparkSession, d: str) -> DataFrame:
    return chain.build(view(s, d, "chain_rows"), SEGMENT)


@query
def chain_build(s, d):
    return chained(s, d)


@query
def chain_verify(s, d):
    spoilt = F.col("sequence") % 1777 == 5
    return chain.broken(chained(s, d).withColumn("payload", F.when(spoilt, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))))


@query
def chain_heads(s, d):
    return chain.heads(chained(s, d))


@query
def chain_verify_heads(s, d):
    """One segment of each ledger dropped after its heads were stored, and the last row of another cut off."""
    whole = cut_lineage(chained(s, d))
    last = whole.where("segment = 0").groupBy("ledger_id").agg(F.max("sequence").alias("sequence"))
    return chain.broken_heads(whole.where("segment <> 1").join(last, ["ledger_id", "sequence"], "left_anti"), chain.heads(whole))


@query
def chain_tree(s, d):
    return merkle.tree(chain.build(view(s, d, "chain_rows"), TREE_SEGMENT))


@query
def chain_verify_tree(s, d):
    """Some segments without their rows, some with another last hash, and one ledger's nodes over the segments overwritten in the stored tree."""
    whole = cut_lineage(chain.build(view(s, d, "chain_rows"), TREE_SEGMENT))
    nodes = cut_lineage(merkle.tree(whole).withColumn("hash", F.when((F.col("level") == 1) & (F.col("ledger_id") == 3), F.concat(F.lit("x"), "hash")).otherwise(F.col("hash"))))
    spoilt = whole.where("segment % 9 <> 2").withColumn("hash", F.when(F.col("segment") % 7 == 3, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")))
    return merkle.broken(spoilt, nodes)


@query
def event_history(s, d):
    rows = view(s, d, "chain_rows")
    last = rows.groupBy("ledger_id").agg(F.max_by("id", "sequence").alias("id"))
    return chain.history(rows, last).select("ledger_id", "sequence", "ancestor")


def edges(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "lineage_edges")


def lineage_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges cut once; each node but a region derives from one that its id, or its table, names."""
    links = cut_lineage(edges(s, d))
    regions = s.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("id"))
    return links.select(F.col("derived_id").alias("id")).unionByName(regions), links


@query
def provenance_sources(s, d):
    return lineage.sources(edges(s, d)).select("derived_id", F.array_join("sources", ",").alias("sources"))


@query
def provenance_tree(s, d):
    """The walk from every node."""
    every, links = lineage_tables(s, d)
    return lineage.tree(every, every, links)


@query
def erase_cascade(s, d):
    every, links = lineage_tables(s, d)
    return lineage.cascade(every.where("id = 'r:1'"), every, links)


def node_ledger(every: DataFrame) -> DataFrame:
    """All nodes as one ledger in segments: kinds after each other, lines by order, line number and the number among rows that repeat both."""
    repeat = F.coalesce(F.try_element_at(F.split("id", ":"), F.lit(4)).cast("long"), F.lit(0))
    place = (F.col("sequence_class") * 100_000_000_000_000 + F.col("n") * 1000 + repeat).alias("place")
    rows = every.select(F.lit(0).cast("long").alias("ledger_id"), "id", "kind", "n", place)
    dense = scan(rows, ["ledger_id"], ["place"], F.floor(F.col("place") / 1_000_000_000), {"sequence": ("sum_before", F.lit(1).cast("long"))}, small=False, cut=False)
    payload = F.concat(F.lit('{"id":"'), "id", F.lit('"}'))
    segment = F.floor(F.col("sequence") / ERASED_SEGMENT)
    return dense.select("ledger_id", "id", "kind", F.col("kind").alias("stream_id"), (F.col("n") * 1000).alias("ts_us"), payload.alias("payload"), "sequence", segment.alias("segment"))


@query
def erase_compact(s, d):
    """What the erasure leaves is linked once. Nodes and edges are both made of lines that were counted once."""
    counted = cut_lineage(lines(s, d))
    rows, links = cut_lineage(node_ledger(view(s, d, "lineage_nodes", counted))), view(s, d, "lineage_edges", counted)
    left = lineage.compacted(rows, links, lineage.cascade(rows.where("id = 'r:1'"), rows, links)).rows
    return left.select("id", "kind", "stream_id", "ts_us", "payload", "segment", "sequence", "previous_hash", "hash")


def records(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "retained_records").withColumn("ts_us", F.when(F.col("kind").isin("episode"), F.lit(None).cast("long")).otherwise(F.col("recorded_us")))


def stored_records(s: SparkSession, d: str) -> DataFrame:
    """Records as a chained ledger with kind, stream, time and payload."""
    rows = records(s, d).withColumn("stream_id", F.concat(F.lit("s"), F.col("sequence") % 4)).withColumn("payload", F.format_string('{"ts_us":%d}', "recorded_us"))
    return cut_lineage(chain.build(rows, ERASED_SEGMENT))


STORED = ("ledger_id", "id", "kind", "stream_id", "ts_us", "recorded_us", "payload", "segment", "sequence", "previous_hash", "hash")


def _range_erased(s: SparkSession, d: str) -> lineage.Compacted:
    return lineage.erase_range(stored_records(s, d), view(s, d, "retained_edges"), 600 * 600 * SECOND, 900 * 600 * SECOND, True)


@query
def range_erase(s, d):
    return _range_erased(s, d).rows.select(*STORED)


@query
def erase_tree(s, d):
    """The tree over the segments after an erasure, of which only paths above changed segments are hashed again."""
    return _range_erased(s, d).tree


@query
def erase_edges(s, d):
    """The edges that an erasure leaves."""
    return _range_erased(s, d).edges.select("derived_id", "source_id", "ordinal")


@query
def claim_violations(s, d):
    return lineage.claim_violations(view(s, d, "claims"), view(s, d, "claim_evidence"))


@query
def role_violations(s, d):
    return lineage.role_violations(view(s, d, "claims"), view(s, d, "claim_evidence"))


@query
def agent_evidence(s, d):
    return lineage.agent_evidence(ledger(s, d), "skeptic", AGENT_US)[0]


# Retention, export, privacy


def _now(s: SparkSession, d: str, after: int) -> int:
    return view(s, d, "retained_records").agg(F.max("recorded_us")).first()[0] + after


@query
def retention_eligible(s, d):
    return retention.eligible(view(s, d, "retained_records"), _now(s, d, 3600 * SECOND)).select("id", "kind")


@query
def retention_preview(s, d):
    return retention.preview(view(s, d, "retained_records"), _now(s, d, 364 * DAY))


@query
def retention_plan(s, d):
    return retention.plan(view(s, d, "retained_records"), view(s, d, "retained_edges"), _now(s, d, 28 * DAY)).select("id", "kind", F.array_join("sources", ",").alias("sources"))


@query
def retention_apply(s, d):
    return retention.applied(stored_records(s, d), view(s, d, "retained_edges"), _now(s, d, 3600 * SECOND), True).rows.select(*STORED)


@query
def export_bundle(s, d):
    rows = records(s, d).withColumn("payload", F.format_string('{"ts_us":%d}', "recorded_us"))
    return retention.export_bundle(rows, view(s, d, "retained_edges"), 100 * 600 * SECOND, 5000 * 600 * SECOND).select("id", "kind", "ts_us", F.array_join("sources", ",").alias("sources"))


@query
def retention_plan_sink(s, d):
    """The plan written as JSON and read back."""
    rows = retention.plan(view(s, d, "retained_records"), view(s, d, "retained_edges"), _now(s, d, 28 * DAY)).select("id", "kind", F.array_join("sources", ",").alias("sources"))
    path = tables.shared_path(s, "retention-plan")
    tables.write_report(rows, path)
    return s.read.schema(rows.schema).json(path)


@query
def export_sink(s, d):
    """The bundle written as JSON beside its manifest, and read back with the manifest's count."""
    rows = records(s, d).withColumn("payload", F.format_string('{"ts_us":%d}', "recorded_us"))
    bundle = retention.export_bundle(rows, view(s, d, "retained_edges"), 100 * 600 * SECOND, 5000 * 600 * SECOND).select("id", "kind", "ts_us")
    path = tables.shared_path(s, "export")
    tables.export(bundle, path)
    manifest = s.read.schema("schema string, records long").json(f"{path}/manifest").select("records")
    return s.read.schema(bundle.schema).json(f"{path}/records").join(F.broadcast(manifest))  # one row


@query
def pseudonymize(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", C.pseudonym(HMAC_KEY, F.col("c_custkey").cast("string"), "ble").alias("pseudonym"))


@query
def hash_id(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", C.hashed_id(F.col("c_custkey").cast("string"), "id").alias("hashed"))


@query
def privacy_audit(s, d):
    return privacy.audit(view(s, d, "audit_json"))


@query
def wifi_mode_a(s, d):
    rows = privacy.wifi_mode_a(view(s, d, "wifi_hits"))
    return rows.select("scan_id", r("rssi_mean").alias("rssi_mean"), r("noise_mean").alias("noise_mean"), "visible_network_count", "strongest_1", "strongest_2", "strongest_3")


# Feature windows


def frames(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("samples"), F.lit(RATE).alias("sample_rate"))


def spectra(s: SparkSession, d: str) -> DataFrame:
    return frames(s, d).select("frame_id", "sample_rate", features.magnitude_spectrum("samples").alias("mags"))


@query
def frame_samples(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").select(F.lit(0).alias("stream"), F.col("event_id").alias("idx"), "value")
    got = features.frame_samples(rows, FRAME)
    return got.select("frame", F.size("samples").alias("n"), r(F.element_at("samples", 1)).alias("first"), r(F.element_at("samples", -1)).alias("last"))


@query
def audio_energy(s, d):
    return frames(s, d).select("frame_id", r(features.rms()).alias("rms"), r(features.peak()).alias("peak"))


@query
def zero_crossing_rate(s, d):
    return frames(s, d).select("frame_id", r(features.zero_crossing_rate()).alias("zcr"))


@query
def magnitude_spectrum(s, d):
    return spectra(s, d).select("frame_id", F.posexplode("mags").alias("bin", "m")).select("frame_id", "bin", r("m", 5).alias("magnitude"))


@query
def spectral_centroid(s, d):
    return spectra(s, d).select("frame_id", r(features.centroid("mags", F.lit(FRAME), F.col("sample_rate")), 3).alias("hz"))


@query
def spectral_rolloff(s, d):
    return spectra(s, d).select("frame_id", r(features.rolloff("mags", F.lit(FRAME), F.col("sample_rate")), 3).alias("hz"))


@query
def spectral_flatness(s, d):
    return spectra(s, d).select("frame_id", r(features.flatness("mags")).alias("flatness"))


@query
def voice_activity(s, d):
    return features.audio_features(frames(s, d)).select("frame_id", r("voice_activity_probability").alias("vad"))


@query
def audio_features(s, d):
    rows = features.audio_features(frames(s, d))
    return rows.select("frame_id", *[r(c, 3 if c.endswith("_hz") else 6).alias(c) for c in rows.columns if c != "frame_id"])


@query
def ble_windows(s, d):
    rows = view(s, d, "ble_hits").withColumn("pseudonym", C.hashed_id(F.col("device").cast("string"), "ble"))
    got = features.ble_windows(rows)
    return got.select("window_us", "cluster_count", F.aggregate("clusters", F.lit(0).cast("long"), lambda a, c: a + c["rssi"]).alias("rssi_sum"), F.element_at(F.transform("clusters", lambda c: c["pseudonym"]), F.when(F.size("clusters") > 0, 1)).alias("first_pseudonym"))


def poses(s: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.struct(F.lit(f"j{i}").alias("name"), F.element_at("embedding", 3 * i + 1).cast("double").alias("x"), F.element_at("embedding", 3 * i + 2).cast("double").alias("y"), F.abs(F.element_at("embedding", 3 * i + 3)).cast("double").alias("confidence"))
    joints = F.when(F.col("vec_id") % 10 == 0, F.array().cast("array<struct<name:string,x:double,y:double,confidence:double>>")).otherwise(F.array(*[at(i) for i in range(20)]))
    return s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", joints.alias("joints"))


@query
def pose_filter(s, d):
    return poses(s, d).select("vec_id", F.posexplode(features.pose_filter()).alias("at", "j")).select("vec_id", "at", F.col("j.name").alias("name"), r("j.confidence").alias("confidence"))


@query
def pose_observation(s, d):
    return poses(s, d).select("vec_id", features.pose_observation().alias("body_count"))


def conflated(s: SparkSession, d: str) -> DataFrame:
    return features.conflate_latest(env(s, d), F.floor(F.col("arrival") / 100))


@query
def conflate_latest(s, d):
    return conflated(s, d).select("ledger_id", "batch", "sensor_stream_id", "message_id", "arrival")


@query
def assign_sequence(s, d):
    return features.assign_sequence(conflated(s, d)).select("ledger_id", "sensor_stream_id", "arrival", "sequence")


@query
def acceptance_status(s, d):
    rows = env(s, d)
    startup = F.when(F.col("ledger_id") % 2 == 0, "running").otherwise("unauthorized")
    expected = rows.select(F.concat_ws("/", "ledger_id", "sensor_stream_id").alias("stream"), startup.alias("startup"), (F.col("ledger_id") % 3).alias("discovered")).distinct()
    got = validate.accepted(rows).groupBy(F.concat_ws("/", "ledger_id", "sensor_stream_id").alias("stream")).agg(F.count(F.lit(1)).alias("n"))
    return features.acceptance_status(expected, got)


# Roll-ups


@query
def ledger_counts(s, d):
    return rollups.counts(ingest.entries(*stored(s, d)))


@query
def stream_counts(s, d):
    return rollups.stream_counts(ingest.entries(*stored(s, d)))


@query
def recent_records(s, d):
    found, held = stored(s, d)
    held = cut_lineage(held)
    rows = ingest.entries(found, held).drop("payload", "probability")
    return rollups.recent_records(ingest.recent(rows, rollups.RECORDS), ingest.evidence_edges(held))


@query
def recent_observations(s, d):
    return recent(s, d)


@query
def recent_zoom(s, d):
    return recent(s, d, rollups.ZOOMS[1])


for _n in (n for n in rollups.ZOOMS if n != rollups.ZOOMS[1]):
    QUERIES[f"recent_zoom_{_n}"] = lambda s, d, n=_n: recent(s, d, n)


@query
def latest_ts(s, d):
    return rollups.latest_ts(ingest.entries(*stored(s, d)))


@query
def observation_age(s, d):
    return rollups.latest_ts(ingest.entries(*stored(s, d))).select("ledger_id", "stream_id", rollups.age_seconds(F.lit(ACK_US), F.col("ts_us")).alias("seconds"))


@query
def observation_rates(s, d):
    return rollups.rates(ingest.entries(*stored(s, d))).select("ledger_id", "stream_id", r("rate").alias("rate"))


@query
def day_buckets(s, d):
    rows = view(s, d, "retained_records").select("ledger_id", F.when(F.col("kind") == "sensor_gap", "x").otherwise("observation").alias("kind"), (F.col("recorded_us") * 2).alias("ts_us"))
    return rollups.day_buckets(rows)


@query
def telemetry(s, d):
    rows = rollups.telemetry(ledger(s, d, True))
    return rows.select("ledger_id", *[r(c).alias(c) for c in rows.columns if c != "ledger_id"])


@query
def latest_belief(s, d):
    found = cut_lineage(beliefs(s, d))
    return rollups.latest_belief(found, ingest.evidence_edges(found)).select("ledger_id", "id", *[r(c).alias(c) for c in ("probability", "confidence", "disagreement", "health")], "modalities", "state", "evidence")


@query
def latest_joints(s, d):
    weighed = F.aggregate("joints", F.lit(0.0), lambda a, j: a + j["x"] + 10 * j["y"] + 100 * j["confidence"])
    return rollups.latest_camera(ledger(s, d, True)).select("ledger_id", "id", "kind", F.size("joints").alias("joints"), r(weighed).alias("weighed"))


@query
def agent_runs(s, d):
    rows = cut_lineage(ingest.entries(*stored(s, d)).select("ledger_id", "id", "kind", "stream_id"))
    parts = [lineage.agent_evidence(rows, role, AGENT_US + i)[0].select("ledger_id", F.lit(i).cast("long").alias("sequence"), "id", F.lit(role).alias("role"), "layer", "status", "evidence") for i, role in enumerate(sorted(lineage.ROLE_OUTPUT))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return rollups.agent_runs(every, 3)


@query
def density_histogram(s, d):
    return rollups.density_histogram(ledger(s, d))


@query
def events_list(s, d):
    return ledger(s, d).select("ledger_id", "sequence", "id", "kind", "ts_us")


@query
def event_show(s, d):
    return ledger(s, d, True).where("id = 'm75'").select("ledger_id", "sequence", "id", "kind", "stream_id", "payload")


@query
def ledger_summary(s, d):
    rows = cut_lineage(ledger(s, d))
    found = cut_lineage(episodes(s, d))
    ep = found.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("episodes"))
    pa = sessions.patterns(found).groupBy("ledger_id").agg(F.count(F.lit(1)).alias("patterns"))
    streams = rollups.stream_counts(rows).groupBy("ledger_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "stream_id", "n"))), " ").alias("streams"))
    waiting = ingest.gap_state(gapped(s, d)).where("pending").groupBy("ledger_id").agg(F.array_join(F.array_sort(F.collect_list("sensor_stream_id")), ",").alias("pending"))
    out = rollups.counts(rows)
    for part in (ep, pa, streams, waiting):
        out = out.join(part, "ledger_id", "left")
    return out.fillna(0, ["episodes", "patterns"]).fillna("", ["streams", "pending"])
