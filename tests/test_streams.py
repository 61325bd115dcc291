"""Streams against their batch operators, over several splits of the input."""

import random

import pytest
from pyspark.sql import functions as F

from tracefold.config import SECOND, Sessions
from tracefold.operators import features, ingest, sessions, validate
from tracefold.plans import queries
from tracefold.plans.views import view
from tracefold.sources import offsets, tables
from tracefold.sources.tables import cut_lineage
from tracefold.streaming import ingest as streaming
from tracefold.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def rocks(spark):
    keys = {"spark.sql.streaming.stateStore.providerClass": streaming.STATE_STORE, "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def files(spark, batches, schema, folder):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def replay(spark, batches, schema, folder, make):
    name = f"r{abs(hash(str(folder)))}"
    q = make(files(spark, batches, schema, folder)).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name).collect(), q


def cuts(rows, parts):
    """rows in order, in so many batches of uneven sizes."""
    ends = [0, *sorted(random.Random(parts).sample(range(1, len(rows)), parts - 1)), len(rows)]
    return [rows[a:b] for a, b in zip(ends, ends[1:])]


SAMPLE = "stream long, idx long, value double"


@pytest.mark.parametrize("parts", [1, 3, 5])
def test_frames_whatever_the_split(spark, tmp_path, parts):
    rows = [(s, i, (s + 1) * i / 7) for s in range(3) for i in range(100 + 13 * s)]
    random.Random(parts).shuffle(rows)
    got, _ = replay(spark, cuts(rows, parts), SAMPLE, tmp_path, lambda x: windows.frames(x, 16))
    want = features.frame_samples(spark.createDataFrame(rows, SAMPLE), 16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 15


def test_frames_far_behind_are_given_up(spark, tmp_path):
    batches = [[(0, 0, 1.0)], [(0, i, 1.0) for i in range(40, 44)], [(0, i, 1.0) for i in range(1, 4)]]
    got, _ = replay(spark, batches, SAMPLE, tmp_path, lambda x: windows.frames(x, 4, most_open=5))
    assert [r.frame for r in got] == [10]


HIT = "pseudonym string, ts_us long, rssi int"


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_ble_windows_whatever_the_split(spark, tmp_path, parts):
    r = random.Random(3)
    rows = sorted([(f"d{r.randrange(6)}", t * SECOND + r.randrange(SECOND), -r.randrange(30, 90)) for t in [*range(40), *range(200, 230), *range(1000, 1010)] for _ in range(2)], key=lambda x: x[1])
    rows = [rows[i + (1 if i % 2 == 0 and i + 1 < len(rows) else -1 if i % 2 else 0)] for i in range(len(rows))]  # a little out of order
    got, q = replay(spark, cuts(rows, parts), HIT, tmp_path, lambda x: windows.ble_windows(x, late_us=30 * SECOND))
    passed = max(x[1] for x in rows) - 30 * SECOND
    want = [w for w in features.ble_windows(spark.createDataFrame(rows, HIT)).collect() if w.window_us + 5 * SECOND <= passed]
    plain = lambda xs: sorted((w.window_us, w.cluster_count, [(c.pseudonym, c.rssi) for c in w.clusters]) for w in xs)
    last = max((w.window_us for w in want if w.cluster_count), default=0)  # empty ones behind it wait for the next
    assert plain(got) == [w for w in plain(want) if w[0] <= last] and len(got) > 40 and windows.late_rows(q) == 0


def test_late_hits_are_counted(spark, tmp_path):
    batches = [[("a", 100 * SECOND, -5)], [("a", 300 * SECOND, -5)], [("b", SECOND, -5), ("b", 2 * SECOND, -5), ("a", 301 * SECOND, -5)]]
    got, q = replay(spark, batches, HIT, tmp_path, lambda x: windows.ble_windows(x))
    assert windows.late_rows(q) >= 1 and all(w.window_us >= 100 * SECOND for w in got)


@pytest.fixture(scope="module")
def envelopes(spark):
    rows = cut_lineage(view(spark, SF, "envelopes").where("ledger_id < 2"))
    return rows.orderBy("arrival").collect(), rows.schema


@pytest.mark.parametrize("parts", [1, 4])
def test_fusion_in_stages_equals_the_batch(spark, tmp_path, envelopes, parts):
    rows, schema = envelopes
    got, _ = replay(spark, cuts(rows, parts), schema, tmp_path, streaming.fused)
    df = spark.createDataFrame(rows, schema)
    batch = ingest.with_gaps(validate.accepted(df))
    assert {(r.message_id, r.jump, r.silent) for r in got} == {(r.message_id, r.jump, r.silent) for r in batch.collect()}
    want = {r.source_observation_id: r for r in ingest.belief_table(ingest.beliefs(df)).collect()}
    found = {r.message_id: r for r in got if r.probability is not None}
    assert set(found) == set(want) and len(want) > 50
    for i, r in found.items():
        w = want[i]
        assert (r.probability, r.confidence, r.disagreement, r.health) == pytest.approx((w.probability, w.confidence, w.disagreement, w.health), abs=1e-9) and r.state == w.state


def test_ids_are_forgotten_by_event_time(spark, tmp_path):
    """An id that comes again is a replay inside the time that ids are kept, and new beyond."""
    env = "ledger_id long, arrival long, schema_version int, message_id string, sensor_stream_id string, monotonic_sequence long, captured_at_utc_us long, payload string"
    row = lambda a, i, s, t: (1, a, 1, i, "camera", s, t * SECOND, '{"body_count":"one"}')
    batches = [[row(1, "x", 1, 10)], [row(2, "x", 2, 20), row(3, "y", 3, 25)], [row(4, "z", 4, 500)], [row(5, "x", 5, 510)], [row(6, "x", 6, 520)]]
    got, _ = replay(spark, batches, env, tmp_path, lambda s: streaming.fused(s, keep_ids_us=60 * SECOND))
    assert sorted((r.message_id, r.arrival) for r in got) == [("x", 1), ("x", 5), ("y", 3), ("z", 4)]


BELIEF = "ledger_id long, ts_us long, sequence long, p double"


@pytest.mark.parametrize("parts", [1, 3])
def test_silent_ledgers_emit_their_last_session(spark, tmp_path, parts):
    r = random.Random(5)
    rows, t = [], 0
    for led in range(4):
        t, p = 0, 0.9
        for i in range(150):
            t += r.randrange(SECOND // 2, 2 * SECOND)
            if r.random() < 0.12:
                p = r.choice([0.95, 0.1, 0.5])
            rows.append((led, t, i, p))
    rows = sorted(rows, key=lambda x: x[1])
    batches = [*cuts(rows, parts), [(99, 10_000 * SECOND, 0, 0.5)], [(99, 20_000 * SECOND, 1, 0.5)]]
    got, _ = replay(spark, batches, BELIEF, tmp_path, lambda x: streaming.sessions(x, Sessions(), idle_us=600 * SECOND))
    want = sessions.merged(sessions.occupancy(spark.createDataFrame(rows, BELIEF)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and len(got) > 4


def test_quarantine_counts_a_replayed_batch_once(spark, tmp_path, envelopes, monkeypatch):
    """The write fails between both tables, then after the commit; each time the stream starts again."""
    rows, schema = envelopes
    source = files(spark, cuts(rows, 3), schema, tmp_path)
    real, calls = tables.write_batch, []

    def flaky(parts, path, batch):
        calls.append(batch)
        if len(calls) == 1:
            name, df = next(iter(parts.items()))
            df.limit(1).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
            raise OSError("between the writes")
        done = real(parts, path, batch)
        if len(calls) == 3:
            raise OSError("after the commit")
        return done

    monkeypatch.setattr(streaming, "write_batch", flaky)
    for attempt in range(3):
        q = source.writeStream.foreachBatch(streaming.quarantined(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        try:
            q.awaitTermination(300)
        except Exception as e:  # noqa: BLE001
            assert attempt < 2 and "OSError" in str(e)
    good, bad = streaming.quarantine(spark.createDataFrame(rows, schema))
    for name, want in (("accepted", good), ("rejected", bad)):
        got = tables.committed(spark, f"{tmp_path}/out", name).drop("batch")
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 10
    assert calls == ["0", "0", "1", "1", "2"]


def test_conflation_as_a_stream(spark, tmp_path, envelopes):
    rows, schema = envelopes
    batches = cuts(rows, 4)
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/n={n}")
    files(spark, batches, schema, tmp_path).writeStream.foreachBatch(streaming.conflated(write)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(300)
    got = spark.read.parquet(f"{tmp_path}/out").drop("n")
    numbered = spark.createDataFrame([(*r, n) for n, b in enumerate(batches) for r in b], schema.add("n", "long") if "n" not in schema.names else schema)
    want = features.conflate_latest(numbered, F.col("n")).drop("n")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


ROWS = "ledger_id long, sensor_stream_id string, arrival long"


def test_sequences_go_on_after_restarts_and_lost_races(spark, tmp_path):
    part = lambda a, b: spark.createDataFrame([(i % 2, "camera" if i % 3 else "wifi", i) for i in range(a, b)], ROWS)
    path = f"{tmp_path}/marks"
    first = offsets.allocated(part(0, 20), path, "a")
    again = offsets.allocated(part(0, 20), path, "a")  # the same batch after a restart
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    raced = []

    def other_run_wins():
        if not raced:
            raced.append(offsets.allocated(part(20, 33), path, "b").collect())

    late = offsets.allocated(part(33, 50), path, "c", before_commit=other_run_wins)

    def fails():
        raise OSError("before the commit")

    with pytest.raises(OSError):
        offsets.allocated(part(50, 60), path, "d", before_commit=fails)
    last = offsets.allocated(part(50, 60), path, "d")
    by = {}
    for r in [*first.collect(), *raced[0], *late.collect(), *last.collect()]:
        by.setdefault((r.ledger_id, r.sensor_stream_id), []).append((r.arrival, r.sequence))
    assert all(sorted(s for _, s in v) == list(range(1, len(v) + 1)) for v in by.values()) and sum(map(len, by.values())) == 60
    assert all(sorted(v) == sorted(v, key=lambda x: x[1]) for v in by.values())
    assert [c["batch"] for c in offsets.commits(spark, path)] == ["a", "b", "c", "d"]
    assert {(r.ledger_id, r.sensor_stream_id): r.mark for r in offsets.marks(spark, path).collect()} == {k: len(v) for k, v in by.items()}
