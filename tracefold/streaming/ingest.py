"""Streaming ingest: quarantine, fusion in stages of keyed state, conflation and sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import MODALITIES, Fusion, Ingest, Sessions
from ..operators.ingest import signal
from ..operators.validate import PARSE, reject_reason
from ..sources.tables import cut_lineage, write_batch

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _reasoned(envelopes: DataFrame, c: Ingest) -> DataFrame:
    """envelopes with reason; a payload is parsed once."""
    return envelopes.withColumn("_body", F.expr(PARSE)).withColumn("reason", reject_reason(c, "_body")).drop("_body")


def quarantine(envelopes: DataFrame, c: Ingest = Ingest()) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the others with their reason; stateless, for batches and streams."""
    rows = _reasoned(envelopes, c)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def quarantined(path: str, c: Ingest = Ingest()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over envelopes: valid rows into the table accepted and others, with their reason, into rejected.

    Both are written under the batch's number and count once it is committed (sources.tables.committed), so a batch that
    is replayed, after a failure between the writes or after its commit, changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        rows = cut_lineage(_reasoned(batch, c))
        write_batch({"accepted": rows.where("reason IS NULL").drop("reason"), "rejected": rows.where("reason IS NOT NULL")}, path, str(number))

    return run


BELIEF = "ledger_id long, arrival long, message_id string, jump boolean, silent boolean, probability double, confidence double, disagreement double, health double, state string"
ROW = "ledger_id long, arrival long, message_id string, sensor_stream_id string, monotonic_sequence long, captured_at_utc_us long, signal double"
MARKED = ROW + ", jump boolean, silent boolean, pending boolean"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class _FirstOfId(StatefulProcessor):
    """State of a share of a ledger's ids: those seen, with their time; forgotten keep_us of event time later."""

    def __init__(self, keep_us: int | None) -> None:
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "id string", "ts_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        now: dict[str, int] = {}
        fresh = []
        for i, ts in zip(every.message_id, every.captured_at_utc_us.tolist()):
            if i not in now and self.seen.containsKey((i,)):
                now[i] = self.seen.getValue((i,))[0]
            new = i not in now or (self.keep_us is not None and ts - now[i] > self.keep_us)
            fresh.append(new)
            if new:
                now[i] = ts
                self.seen.updateValue((i,), (ts,))
        every = every[fresh]
        if self.keep_us is not None:
            span = max(1000, self.keep_us // 4000)  # one timer for the ids of a quarter of the time
            for at in {(int(ts) + self.keep_us) // 1000 // span * span + span for ts in every.captured_at_utc_us}:
                self.handle.registerTimer(at)
        yield every.drop(columns=["bucket"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        old = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.keep_us
        for (i,), (ts,) in list(self.seen.iterator()):
            if ts <= old:
                self.seen.removeKey((i,))
        return iter([])

    def close(self) -> None:
        pass


class _Gaps(StatefulProcessor):
    """State of one stream of a ledger: its last time, largest sequence and pending flag; read and written once a batch."""

    def __init__(self, c: Ingest) -> None:
        self.c = c

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "ts_us long, sequence long, pending boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        ts, seq = every.captured_at_utc_us.to_numpy(np.int64), every.monotonic_sequence.to_numpy(np.int64)
        held = self.state.get() if self.state.exists() else None
        known = np.append(held is not None, np.ones(len(ts) - 1, bool))
        largest = np.maximum.accumulate(np.append(held[1] if held else seq[0], seq))
        before = np.append(held[0] if held else ts[0], ts[:-1])
        jump = known & (seq > largest[:-1] + 1)
        silent = known & ~jump & (ts - before > self.c.silent_gap_us)
        marked = np.maximum.accumulate(np.where(jump | silent, np.arange(len(ts)), -1))
        pending = np.where(marked >= 0, silent[marked], bool(held[2]) if held else False)
        self.state.update((int(ts[-1]), int(largest[-1]), bool(pending[-1])))
        yield every.assign(jump=jump, silent=silent, pending=pending)[_columns(MARKED)]

    def close(self) -> None:
        pass


class _Beliefs(StatefulProcessor):
    """State of a ledger: each modality's latest time, signal and pending flag; read and written once a batch."""

    def __init__(self, c: Fusion) -> None:
        self.c = c

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", ", ".join(f"{m}_ts long, {m}_signal double, {m}_pending boolean" for m in MODALITIES))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        c = self.c
        every = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        now, said = every.captured_at_utc_us.to_numpy(np.int64), every.signal.to_numpy(np.float64)
        held = self.state.get() if self.state.exists() else (None, None, None) * len(MODALITIES)
        out, waiting, weight, total, health, present, known = [], False, 0.0, 0.0, 0.0, 0, 0
        signals = []
        for k, m in enumerate(MODALITIES):
            ts0, signal0, pending0 = held[3 * k : 3 * k + 3]
            at = np.maximum.accumulate(np.where(every.sensor_stream_id == m, np.arange(len(now)), -1))
            own = at >= 0
            there = own | (ts0 is not None)
            ts = np.where(own, now[at], ts0 or 0)
            value = np.where(own, said[at], np.nan if signal0 is None else signal0)
            pending = np.where(own, every.pending.to_numpy(bool)[at], bool(pending0))
            fresh = np.where(there, np.clip(1.0 - np.maximum(now - ts, 0) / c.fresh_us, 0.0, 1.0), 0.0)
            speaks = there & ~np.isnan(value)
            waiting = waiting | (there & pending)
            health, present, known = health + fresh, present + there, known + speaks
            share = np.where(speaks, c.weights[m] * fresh, 0.0)
            weight, total = weight + share, total + np.where(speaks, value, 0.0) * share
            signals.append(np.where(speaks, value, np.nan))
            last = -1
            out += [int(ts[last]), None if np.isnan(value[last]) else float(value[last]), bool(pending[last])] if there[last] else [None, None, None]
        self.state.update(tuple(out))
        with np.errstate(all="ignore"):
            health = health / present
            many = np.array(signals)
            spread = np.where(known > 0, np.where(np.isnan(many), -np.inf, many).max(0) - np.where(np.isnan(many), np.inf, many).min(0), np.nan)
            probability = total / weight
        believed = (known > 0) & (weight > 0) & ~waiting
        state = np.where((spread > c.contested_over) | (health < c.weak_health), "contested", "stable")
        told = {"probability": probability, "confidence": np.clip(weight * health * (1 - 0.5 * spread), 0.0, 1.0), "disagreement": spread, "health": health}
        yield every.assign(**{n: np.where(believed, v, np.nan) for n, v in told.items()}, state=np.where(believed, state, None))[_columns(BELIEF)].replace({np.nan: None})

    def close(self) -> None:
        pass


def fused(envelopes: DataFrame, ingest: Ingest = Ingest(), fusion: Fusion = Fusion(), keep_ids_us: int | None = None, late_us: int = 0, id_shares: int = 16) -> DataFrame:
    """One row for each first valid envelope of an id, with its belief if there is one.

    Three stages, each keyed by no more than it needs: ids by ledger and a hash of the id (id_shares of them), gaps by ledger and
    stream, and the latest signals by ledger, where a batch's rows are worked on as columns with one read and one
    write of state. Rows are ordered by arrival inside a batch, so batches must come in arrival order. Ids are remembered
    for ever, or for keep_ids_us of event time, by timers; then rows more than late_us behind the newest are late and dropped. Needs
    the state store STATE_STORE."""
    valid, _ = quarantine(envelopes.withColumn("at", F.timestamp_micros("captured_at_utc_us")), ingest)
    if keep_ids_us is not None:
        valid = valid.withWatermark("at", f"{late_us} microseconds")
    bucket = F.pmod(F.xxhash64("message_id"), F.lit(id_shares)).cast("int")
    rows = valid.select("ledger_id", "arrival", "message_id", "sensor_stream_id", "monotonic_sequence", "captured_at_utc_us", signal(fusion).alias("signal"), bucket.alias("bucket"), "at")
    if keep_ids_us is None:
        first = rows.drop("at").groupBy("ledger_id", "bucket").transformWithStateInPandas(_FirstOfId(None), outputStructType=ROW, outputMode="Append", timeMode="None")
    else:
        first = rows.groupBy("ledger_id", "bucket").transformWithStateInPandas(_FirstOfId(keep_ids_us), outputStructType=ROW + ", at timestamp", outputMode="Append", timeMode="EventTime", eventTimeColumnName="at").drop("at")
    marked = first.groupBy("ledger_id", "sensor_stream_id").transformWithStateInPandas(_Gaps(ingest), outputStructType=MARKED, outputMode="Append", timeMode="None")
    return marked.groupBy("ledger_id").transformWithStateInPandas(_Beliefs(fusion), outputStructType=BELIEF, outputMode="Append", timeMode="None")


class _Sessions(StatefulProcessor):
    """State of a ledger: the run of samples, the open session and the closed one that may still grow."""

    def __init__(self, c: Sessions, idle_us: int | None) -> None:
        self.c, self.idle_us = c, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "kind string, run_start long, occupied boolean, open_start long, held_start long, held_end long, last long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        c, out = self.c, []
        kind, run_start, occupied, open_start, held_start, held_end, last, timer = self.state.get() if self.state.exists() else (None,) * 8
        for r in pd.concat(list(rows)).sort_values(["ts_us", "sequence"]).itertuples():
            ts = last = int(r.ts_us)
            now = "E" if r.p >= c.enter else "X" if r.p <= 1.0 - c.exit_confidence else "-"
            if now != kind:
                kind, run_start = now, ts
            if kind == "E" and not occupied and ts - run_start >= c.enter_us:
                occupied, open_start = True, run_start
                if held_start is not None and open_start - held_end > c.merge_us:
                    out.append((int(key[0]), held_start, held_end))
                    held_start = None
            elif kind == "X" and occupied and ts - run_start >= c.exit_us:
                occupied = False
                held_start, held_end = open_start if held_start is None else held_start, run_start
        if self.idle_us is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (last + self.idle_us) // 1000
            self.handle.registerTimer(timer)
        self.state.update((kind, run_start, occupied, open_start, held_start, held_end, last, timer))
        yield pd.DataFrame(out, columns=["ledger_id", "start_us", "end_us"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """The ledger has been silent: what is open ends at its last sample, and its state goes."""
        _, _, occupied, open_start, held_start, held_end, last, _ = self.state.get()
        self.state.clear()
        start, end = (open_start if held_start is None else held_start, last) if occupied else (held_start, held_end)
        yield pd.DataFrame([] if start is None else [(int(key[0]), start, end)], columns=["ledger_id", "start_us", "end_us"])

    def close(self) -> None:
        pass


SESSION = "ledger_id long, start_us long, end_us long"


def sessions(samples: DataFrame, c: Sessions = Sessions(), idle_us: int | None = None, late_us: int = 0) -> DataFrame:
    """Sessions that can no longer change, as (ledger_id, start_us, end_us): one is held until the next starts over merge_us later.

    Batches must come in time order. With idle_us, a ledger's held or open session is emitted, and its state forgotten, once
    the watermark (late_us behind the newest sample of all ledgers) is idle_us past the ledger's last sample; samples behind the
    watermark are dropped. Without it the last session is never emitted. Needs the state store STATE_STORE."""
    if idle_us is None:
        return samples.groupBy("ledger_id").transformWithStateInPandas(_Sessions(c, None), outputStructType=SESSION, outputMode="Append", timeMode="None")
    timed = samples.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", f"{late_us} microseconds")
    return timed.groupBy("ledger_id").transformWithStateInPandas(_Sessions(c, idle_us), outputStructType=SESSION, outputMode="Append", timeMode="EventTime")


def conflated(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands write the latest row of each stream of each micro-batch."""
    from ..operators.features import conflate_latest

    def run(batch: DataFrame, number: int) -> None:
        write(conflate_latest(batch, F.lit(number).cast("long")), number)

    return run
