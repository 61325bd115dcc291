"""Golden cases of the sensor-evidence operators."""

import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from tracefold.config import DAY, SECOND, Ingest, Sessions
from tracefold.functions.columns import clamp, hashed_id, pseudonym
from tracefold.functions.scan import scan
from tracefold.operators import calibration, chain, features, ingest, lineage, privacy, retention, rollups, sessions, validate
from tracefold.sources import tables

ENV = "ledger_id long, arrival long, schema_version int, message_id string, sensor_stream_id string, monotonic_sequence long, captured_at_utc_us long, payload string"


def envelopes(spark, rows):
    return spark.createDataFrame([(0, i, 1, *r) for i, r in enumerate(rows)], ENV)


def test_scan_equals_plain_window(spark):
    r = random.Random(1)
    rows = [(r.randrange(3), i, r.choice([None, r.randrange(50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    values = {"l": ("last", F.col("v")), "lb": ("last_before", F.col("v")), "m": ("max", F.col("v")), "mb": ("max_before", F.col("v")), "s": ("sum", F.col("v")), "sb": ("sum_before", F.lit(1).cast("long"))}
    want = sorted(map(tuple, scan(df, ["k"], ["o"], F.col("o"), values).collect()), key=str)
    for size in (1, 7, 1000):
        got = scan(df, ["k"], ["o"], F.floor(F.col("o") / size), values, small=False)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_reject_reasons(spark):
    good = '{"body_count":"one","joints":[{"name":"nose","x":0.5,"y":1,"confidence":0.9}]}'
    ble = '{"cluster_count":1,"clusters":[{"pseudonym":"%s","rssi":-40}]}'
    cases = [
        ("a", "camera", good, None),
        ("b", "camera", '{"joints":[]}', "shape"),
        ("c", "camera", '{"body_count":"one","joints":[{"name":"n","x":1,"y":1,"confidence":1,"z":2}]}', "shape"),
        ("d", "bluetooth", ble % ("ble:" + "0a" * 32), None),
        ("e", "bluetooth", ble % "00:11:22:33:44:55", "shape"),
        ("f", "microphone", '{"rms":"loud"}', "shape"),
        ("g", "wifi", '{"ssid":"x"}', "field"),
        ("h", "lidar", "{}", "stream"),
        ("i", "wifi", "[1]", "shape"),
        ("j", "wifi", "{", "json"),
        ("k" * 129, "wifi", "{}", "message_id"),
        ("", "wifi", "{}", "message_id"),
        ("l", "wifi", None, "size"),
    ]
    df = envelopes(spark, [(m, s, 1, 0, p) for m, s, p, _ in cases])
    got = [r.x for r in df.select("arrival", validate.reject_reason().alias("x")).orderBy("arrival").collect()]
    assert got == [c[3] for c in cases]


def test_gaps_and_duplicates(spark):
    rows = [("m1", "wifi", 1, 0, "{}"), ("m3", "wifi", 3, 1, "{}"), ("m2", "wifi", 2, 2, "{}"), ("m4", "wifi", 4, 3, "{}"), ("m4", "wifi", 9, 9, "{"), ("m5", "wifi", 5, 40 * SECOND, "{}")]
    kept = validate.accepted(envelopes(spark, rows))
    got = ingest.with_gaps(kept).orderBy("arrival").collect()
    assert [r.message_id for r in got] == ["m1", "m3", "m2", "m4", "m5"]
    assert [r.jump for r in got] == [False, True, False, False, False] and [r.silent for r in got] == [False] * 4 + [True]
    assert [r.id for r in ingest.gap_rows(ingest.with_gaps(kept)).collect()] == ["gap:wifi:1-3"]
    acks = ingest.acknowledged(ingest.with_gaps(kept), None, 7).collect()
    assert [r.id for r in acks] == ["operator-gap-ack-wifi-7-0"]


def test_fusion(spark):
    rows = [("c1", "camera", 1, 0, '{"body_count":"one"}'), ("m1", "microphone", 1, 0, '{"voice_activity_probability":0.0}')]
    last = ingest.belief_table(ingest.beliefs(envelopes(spark, rows))).orderBy("arrival").collect()[-1]
    assert last.probability == pytest.approx(0.65 / 0.85) and last.health == 1 and last.state == "contested" and last.disagreement > 0.9
    assert last.derived_from == ["c1", "m1"]
    stale = [("c1", "camera", 1, 0, '{"body_count":"one"}'), ("w", "wifi", 1, 10 * SECOND + 1, "{}")]
    assert ingest.beliefs(envelopes(spark, stale)).count() == 1  # the camera's own
    decayed = [("c", "camera", 1, 0, '{"body_count":"zero"}'), ("m", "microphone", 1, 9 * SECOND, '{"voice_activity_probability":0}'), ("w", "wifi", 1, 10 * SECOND, "{}")]
    b = ingest.belief_table(ingest.beliefs(envelopes(spark, decayed))).orderBy("arrival").collect()[-1]
    assert b.probability == 0 and b.health > 0


def hysteresis(points, c):
    """A plain sequential version."""
    kind = start = opened = None
    out = []
    for ts, p in points:
        now = "E" if p >= c.enter else "X" if p <= 1.0 - c.exit_confidence else "-"
        if now != kind:
            kind, start = now, ts
        if kind == "E" and opened is None and ts - start >= c.enter_us:
            opened = start
        elif kind == "X" and opened is not None and ts - start >= c.exit_us:
            out.append((opened, start))
            opened = None
    return out + ([(opened, points[-1][0])] if opened is not None else [])


def test_sessions_equal_a_sequential_version(spark):
    r = random.Random(3)
    c, rows, want = Sessions(), [], set()
    for ledger in range(25):
        t, points = 0, []
        for _ in range(60):
            t += r.randrange(1, 4) * SECOND
            points.append((t, r.choice([0.05, 0.2, 0.5, 0.7, 0.9]) if r.random() < 0.4 or not points else points[-1][1]))
        rows += [(ledger, ts, i, p) for i, (ts, p) in enumerate(points)]
        want |= {(ledger, a, b) for a, b in hysteresis(points, c)}
    got = sessions.occupancy(spark.createDataFrame(rows, "ledger_id long, ts_us long, sequence long, p double"))
    assert {tuple(x) for x in got.collect()} == want and want


def test_session_goldens(spark):
    def run(points, c=Sessions()):
        df = spark.createDataFrame([(0, int(t * SECOND), i, p) for i, (t, p) in enumerate(points)], "ledger_id long, ts_us long, sequence long, p double")
        return [(r.start_us / SECOND, r.end_us / SECOND) for r in sessions.merged(sessions.occupancy(df, c), c).orderBy("start_us").collect()]

    assert run([(0, 0.05), (1, 0.05)] + [(t, 0.95) for t in range(2, 8)]) == [(2, 7)]
    assert run([(0, 0.9), (1, 0.9)]) == [] and run([(0, 0.7), (3, 0.7)]) == [(0, 3)]
    minute = 60 * SECOND
    df = spark.createDataFrame([(0, 0, minute), (0, 10 * minute, 11 * minute), (0, 120 * minute, 180 * minute)], "ledger_id long, start_us long, end_us long")
    eps = sessions.episodes(df)
    assert [r.members for r in eps.orderBy("episode").collect()] == [[0, 1], [2]]
    pats = sessions.patterns(eps)
    assert {r.signature for r in pats.collect()} == {"Occupied:11min", "Occupied:60min"}
    records = sessions.memory_records(eps, pats)
    assert records.count() == 4 and sessions.to_write(records, records).count() == 0


def test_calibration(spark):
    pairs = spark.createDataFrame([(0.9, True), (0.2, False), (0.8, False), (0.4, True)], "p double, occupied boolean")
    m = calibration.metrics(pairs).first()
    assert (m.accuracy, m.precision, m.recall, round(m.brier, 6)) == (0.5, 0.5, 0.5, 0.2625)
    assert tuple(calibration.metrics(pairs.where("false")).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    r = random.Random(9)
    sample = [(0, r.randrange(200), i, r.random()) for i in range(60)]
    labels = [(0, i, r.randrange(200), r.random() < 0.5) for i in range(40)]
    got = calibration.matched(spark.createDataFrame(sample, "ledger_id long, ts_us long, sequence long, p double"), spark.createDataFrame(labels, "ledger_id long, line_no long, ts_us long, occupied boolean"), 3)
    free, want = dict((s[2], s[1]) for s in sample), set()
    for _, line, ts, _ in labels:
        near = sorted((abs(t - ts), i) for i, t in free.items() if abs(t - ts) <= 3)
        if near:
            want.add((line, near[0][1]))
            del free[near[0][1]]
    assert {(x.line_no, x.sequence) for x in got.collect()} == want
    with pytest.raises(ValueError):
        calibration.matched(got, got, -1)


def test_chain(spark):
    rows = spark.createDataFrame([(0, i, f"e{i}", json.dumps({"n": i})) for i in range(10)], "ledger_id long, sequence long, id string, payload string")
    built = chain.build(rows, 4)
    before = "0"
    for x in built.where("segment = 0").orderBy("sequence").collect():
        assert x.previous_hash == before
        before = hashlib.sha256((before + x.payload).encode()).hexdigest()
        assert x.hash == before
    assert chain.broken(built).count() == 0 and chain.heads(built).count() == 3
    spoilt = built.withColumn("payload", F.when(F.col("sequence") == 5, F.lit("{}")).otherwise(F.col("payload")))
    assert [(x.segment, x.first_broken) for x in chain.broken(spoilt).collect()] == [(1, 5)]


def test_lineage(spark):
    nodes = spark.createDataFrame([("pattern",), ("episode",), ("obs",), ("other",)], "id string")
    edges = spark.createDataFrame([("pattern", "episode", 0), ("pattern", "obs", 1), ("episode", "obs", 0), ("episode", "ghost", 1)], "derived_id string, source_id string, ordinal int")
    walk = lineage.tree(nodes.where("id = 'pattern'"), nodes, edges).orderBy("place").collect()
    assert [(x.id, x.depth) for x in walk] == [("pattern", 0), ("episode", 1), ("obs", 2)]
    assert {x.id for x in lineage.cascade(nodes.where("id = 'obs'"), nodes, edges).collect()} == {"obs", "episode", "pattern"}
    with pytest.raises(KeyError):
        lineage.cascade(spark.createDataFrame([("nobody",)], "id string"), nodes, edges)
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate(("obs", "other", "episode", "pattern"))], "ledger_id long, sequence long, id string")
    left, kept, _ = lineage.compacted(rows, edges, spark.createDataFrame([("obs",), ("episode",), ("pattern",)], "id string"))
    assert [(x.id, x.sequence) for x in left.collect()] == [("other", 0)] and kept.count() == 0


def test_retention_and_export(spark):
    now = 365 * DAY
    rec = spark.createDataFrame([("o", "observation", 0), ("b", "belief", 0), ("e", "event", 0), ("p", "episode", 0), ("g", "sensor_gap", 0), ("n", "observation", now - 7 * DAY + 1)], "id string, kind string, recorded_us long")
    assert tuple(retention.preview(rec, now).first()) == (1, 1, 1, 1)
    rows = spark.createDataFrame([("a", "observation", 0, '{"ts_us":0}'), ("b", "observation", 10, '{"ts_us":10}'), ("c", "pattern", None, "{}")], "id string, kind string, ts_us long, payload string")
    edges = spark.createDataFrame([("b", "a", 0)], "derived_id string, source_id string, ordinal int")
    assert [(x.id, x.sources) for x in retention.export_bundle(rows, edges, 10, 10).collect()] == [("b", ["a"])]
    assert retention.export_bundle(rows, edges).count() == 3
    with pytest.raises(PermissionError):
        retention.export_bundle(rows.withColumn("payload", F.lit('{"a":[{"SSID":1}]}')), edges)
    body = tables.ledger_scan(spark.createDataFrame([('{"ts_us":1.5,"timestamp_us":4}',), ('{"ts_us":3}',), ("{",)], "payload string"))
    assert [x[0] for x in body.select(retention.event_time()).collect()] == [4, 3, None]


def test_privacy(spark):
    rows = spark.createDataFrame([("x", '{"rssi_mean":-40,"ssid":"n","a":{"b":[1,{"Raw_PCM":{"bssid":2}}]}}'), ("y", "{broken"), ("z", '{"ok":[[{"transcript":1}]]}')], "id string, payload string")
    got = {(x.id, x.path) for x in privacy.audit(rows).collect()}
    assert got == {("x", "$.ssid"), ("x", "$.a.b[1].Raw_PCM"), ("x", "$.a.b[1].Raw_PCM.bssid"), ("z", "$.ok[0][0].transcript")}
    hits = spark.createDataFrame([(1, -40, -90), (1, -60, -80), (1, -80, -70)], "scan_id long, rssi int, noise int")
    scans = spark.createDataFrame([(1,), (2,)], "scan_id long")
    one, none = (tuple(x) for x in privacy.wifi_mode_a(hits, scans).orderBy("scan_id").collect())
    assert one == (1, -60.0, -80.0, 3, -40, -60, -80) and none == (2, 0.0, 0.0, 0, -(2**31), -(2**31), -(2**31))
    key = b"k" * 70
    x = spark.createDataFrame([("id-1",)], "i string").select(pseudonym(key, F.col("i"), "ble"), hashed_id(F.col("i"), "h"), clamp(F.lit(None).cast("double"))).first()
    assert x[0] == "ble:" + hmac.new(key, b"id-1", hashlib.sha256).hexdigest() and x[1] == "h:" + hashlib.sha256(b"id-1").hexdigest() and x[2] is None


def test_features(spark):
    import math

    tone = [math.sin(2 * math.pi * 8 * i / 256) for i in range(256)]
    df = spark.createDataFrame([(1, tone, 256.0), (2, [0.0] * 64, 64.0)], "frame_id long, samples array<float>, sample_rate double")
    one, silent = features.audio_features(df).orderBy("frame_id").collect()
    assert abs(one.spectral_centroid_hz - 8) < 0.5 and one.spectral_rolloff_hz in (8.0, 9.0) and one.spectral_flatness < 0.2
    assert one.rms == pytest.approx(math.sqrt(0.5), abs=1e-3) and silent.voice_activity_probability == 0 == silent.spectral_centroid_hz
    hits = spark.createDataFrame([("a", 0, -41), ("a", 1, -42), ("b", 2, -50), ("a", 12 * SECOND, -60)], "pseudonym string, ts_us long, rssi int")
    got = features.ble_windows(hits).orderBy("window_us").collect()
    assert [x.cluster_count for x in got] == [2, 0, 1] and got[0].clusters[0].rssi == -41


def test_rollups(spark):
    rows = spark.createDataFrame([(0, 0, "a", "observation", "camera", SECOND), (0, 1, "b", "observation", "camera", 2 * SECOND), (0, 2, "c", "observation", "wifi", 30), (0, 3, "d", "sensor_gap", "camera", 5)], "ledger_id long, sequence long, id string, kind string, stream_id string, ts_us long")
    assert {x.stream_id: x.rate for x in rollups.rates(rows).collect()} == {"camera": 2.0, "wifi": 0.0}
    assert {x.stream_id: x.ts_us for x in rollups.latest_ts(rows).collect()} == {"camera": 2 * SECOND, "wifi": 30}
    days = rows.withColumn("ts_us", F.col("sequence") * DAY)
    assert [(x.day, x.n) for x in rollups.day_buckets(days, 2).orderBy("day").collect()] == [(1, 1), (2, 1)]
    assert spark.range(1).select(rollups.age_seconds(F.lit(5), F.lit(9)), ingest.anchor_downgrade(F.lit(0.9), F.lit(0.95), 0.5)).first() == (0, 0.2)


def test_claims(spark):
    claims = spark.createDataFrame([(1, "archivist", "observed"), (2, "skeptic", "interpreted"), (3, "poet", "imagined"), (4, "poet", "observed")], "claim_id long, role string, layer string")
    evidence = spark.createDataFrame([(1, 1, "e", "observed"), (2, 1, "f", "inferred"), (2, 2, "g", "imagined"), (3, 1, "h", "imagined")], "claim_id long, ordinal int, evidence_id string, layer string")
    assert {tuple(x) for x in lineage.claim_violations(claims, evidence).collect()} == {(1, "observed_cites", None), (2, "imagined_as_fact", "g")}
    assert {tuple(x) for x in lineage.role_violations(claims, evidence).collect()} == {(1, "observed_cites"), (2, "imagined_as_fact"), (4, "role_layer")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "labels.jsonl").write_text('{"ts_us":1,"occupied":true}\n\n{"ts_us":2,"occupied":false}\n')
    assert [tuple(x) for x in tables.labels(spark, str(tmp_path / "labels.jsonl")).collect()] == [(1, 1, True), (3, 2, False)]
    (tmp_path / "bad.jsonl").write_text('{"ts_us":1,"occupied":true}\n{"ts_us":1.5}\n')
    with pytest.raises(Exception, match="line 2"):
        tables.labels(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "m" / "n").mkdir(parents=True)
    for name in ("a.WAV", "n/b.png", "c.txt", ".wav", "wav"):
        (tmp_path / "m" / name).write_text("x")
    assert [x.path.rsplit("/", 1)[1] for x in tables.raw_media(spark, str(tmp_path / "m")).collect()] == ["a.WAV", "b.png"]
    assert tables.raw_media(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([(0, "e1", "x"), (0, "e2", "y")], "ledger_id long, id string, kind string")
    edges = spark.createDataFrame([(0, "e2", "e1")], "ledger_id long, derived_id string, source_id string")
    store = str(tmp_path / "store")
    for batch in ("1", "2"):
        tables.append(rows, edges, store, batch)
    assert tables.committed(spark, store, "events").count() == 2 and tables.committed(spark, store, "edges").count() == 1
    tables.export(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/manifest")).first().records == 2


def test_size_limit(spark):
    df = envelopes(spark, [("a", "wifi", 1, 0, "{}"), ("b", "wifi", 2, 0, '{"rssi_mean":1}')])
    assert [x[0] for x in df.orderBy("arrival").select(validate.size_ok(Ingest(most_payload_bytes=2))).collect()] == [True, False]


def test_dropped_and_swapped_segments_are_seen(spark):
    rows = spark.createDataFrame([(1, i, f"e{i}", f"p{i}") for i in range(40)], "ledger_id long, sequence long, id string, payload string")
    whole = chain.build(rows, 10)
    stored = chain.heads(whole)
    assert chain.broken(whole).collect() == [] and chain.broken_heads(whole, stored).collect() == []
    faults = lambda c, s=stored: {(r.segment, r.fault) for r in chain.broken_heads(c, s).collect()}
    assert faults(whole.where("segment <> 2")) == {(2, "missing")}
    assert faults(whole, stored.where("segment <> 3")) == {(3, "unknown")}
    assert faults(whole.where("sequence <> 39")) == {(3, "changed")}
    swapped = whole.withColumn("segment", F.expr("CASE segment WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE segment END"))
    assert chain.broken(swapped).collect() == [] and faults(swapped) == {(1, "changed"), (2, "changed")}
    heads = stored.withColumn("segment", F.expr("CASE segment WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE segment END"))
    assert {s for s, _ in faults(swapped, heads)} == {1, 2, 3}, "swapped heads don't follow each other"


def test_chain_is_built_anew_after_erasure(spark):
    rows = spark.createDataFrame([(1, i, f"e{i}", f"p{i}") for i in range(30)], "ledger_id long, sequence long, id string, payload string")
    edges = spark.createDataFrame([("e7", "e3", 0), ("e9", "e8", 0)], "derived_id string, source_id string, ordinal int")
    left, links, _ = lineage.compacted(chain.build(rows, 10), edges, spark.createDataFrame([("e3",), ("e7",)], "id string"))
    got = left.orderBy("sequence").collect()
    assert [r.id for r in got] == [f"e{i}" for i in range(30) if i not in (3, 7)] and [r.sequence for r in got] == list(range(28))
    assert chain.broken(left).collect() == [] and [r.derived_id for r in links.collect()] == ["e9"]


def test_matching_in_one_dense_island(spark):
    """Against the plain rule, with ties in time and distance."""
    r = random.Random(8)
    beliefs = [(1, r.randrange(0, 4000), i, 0.5) for i in range(300)]
    labels = [(1, r.randrange(0, 4000), i, True) for i in range(250)]
    used, want = set(), []
    for _, t, line, _ in labels:
        near = [(abs(b - t), i) for _, b, i, _ in beliefs if i not in used and abs(b - t) <= 60]
        if near:
            used.add(min(near)[1])
            want.append((line, min(near)[1]))
    got = calibration.matched(spark.createDataFrame(beliefs, "ledger_id long, ts_us long, sequence long, p double"), spark.createDataFrame(labels, "ledger_id long, ts_us long, line_no long, occupied boolean"), 60)
    assert sorted((x.line_no, x.sequence) for x in got.collect()) == want


def in_turn(beliefs, labels, reach):
    """Labels in file order, each the nearest unused belief."""
    used, want = set(), []
    for led, t, line, _ in sorted(labels, key=lambda x: (x[0], x[2])):
        near = [(abs(b - t), i) for bl, b, i, _ in beliefs if bl == led and i not in used and abs(b - t) <= reach]
        if near:
            used.add(min(near)[1])
            want.append((line, min(near)[1]))
    return sorted(want)


@pytest.mark.parametrize("slot,seed", [(1, 1), (130, 2), (400, 3), (10_000, 4)])
def test_matching_over_slots_equals_choosing_in_turn(spark, slot, seed):
    """Files in and out of time order, dense points, narrow slots over whose borders labels compete."""
    r = random.Random(seed)
    beliefs = [(seed % 2 + i % 2, r.randrange(0, 3000), i, i / 500) for i in range(260)]
    labels = [(seed % 2 + i % 2, r.randrange(0, 3000) if seed % 2 else 12 * i, i, i % 3 == 0) for i in range(240)]
    got = calibration.matched(spark.createDataFrame(beliefs, "ledger_id long, ts_us long, sequence long, p double"), spark.createDataFrame(labels, "ledger_id long, ts_us long, line_no long, occupied boolean"), 60, slot).collect()
    assert sorted((x.line_no, x.sequence) for x in got) == in_turn(beliefs, labels, 60)
    assert all(x.p == beliefs[x.sequence][3] and x.occupied == labels[x.line_no][3] for x in got)


def test_matching_without_beliefs_or_labels(spark):
    b, lab = "ledger_id long, ts_us long, sequence long, p double", "ledger_id long, ts_us long, line_no long, occupied boolean"
    one = spark.createDataFrame([(1, 5, 0, 0.5)], b)
    assert calibration.matched(spark.createDataFrame([], b), spark.createDataFrame([(1, 5, 0, True)], lab)).collect() == []
    assert calibration.matched(one, spark.createDataFrame([], lab)).collect() == []
    assert [tuple(x) for x in calibration.matched(one, spark.createDataFrame([(1, 500_005, 7, True), (1, 500_006, 8, True)], lab)).collect()] == [(1, 7, 0, 0.5, True)]
    with pytest.raises(ValueError):
        calibration.matched(one, spark.createDataFrame([], lab), -1)


def test_ble_windows_fill_gaps_in_chunks(spark):
    hits = [("a", 0, -5), ("b", 23_000_000, -7), ("a", 400_000_000, -9)]
    rows = features.ble_windows(spark.createDataFrame(hits, "pseudonym string, ts_us long, rssi int"), chunk=7).collect()
    assert sorted((r.window_us, r.cluster_count) for r in rows) == [(w, int(w in (0, 20_000_000, 400_000_000))) for w in range(0, 400_000_001, 5_000_000)]
    assert features.ble_windows(spark.createDataFrame([], "pseudonym string, ts_us long, rssi int")).collect() == []
    one = features.ble_windows(spark.createDataFrame([("a", 0, -5), ("a", 5_000_000 * 2_000_000, -5)], "pseudonym string, ts_us long, rssi int"))
    assert one.count() == 2_000_001


def test_samples_of_fusion_or_of_every_stream(spark):
    rows = spark.createDataFrame([(1, 5, 0, "belief", "fusion", 0.5), (1, 6, 1, "belief", "other", 0.7), (1, 7, 2, "observation", "camera", None), (1, 8, 3, "belief", "fusion", None)], "ledger_id long, ts_us long, sequence long, kind string, stream_id string, probability double")
    assert [r.sequence for r in sessions.samples(rows).collect()] == [0]
    assert [r.sequence for r in sessions.samples(rows, fusion_only=False).collect()] == [0, 1]


def test_persisted_ids_are_duplicates(spark):
    env = "ledger_id long, arrival long, schema_version int, message_id string, sensor_stream_id string, monotonic_sequence long, captured_at_utc_us long, payload string"
    rows = [(1, i, 2 if m == "v" else 1, m, "wifi", i, i, '{"rssi_mean":-1}' if m != "bad" else "{") for i, m in enumerate(["old", "new", "bad", "gap:x", "v", "new"])]
    stored = spark.createDataFrame([(1, "old"), (1, "bad"), (1, "gap:x"), (2, "new"), (1, "v"), (1, "old")], "ledger_id long, id string")
    got = {r.arrival: r.status for r in validate.classified(spark.createDataFrame(rows, env), persisted=stored).collect()}
    assert got == {0: "duplicate", 1: "accepted", 2: "duplicate", 3: "duplicate", 4: "version", 5: "duplicate"}
