"""Windows over streams: frames of samples by count, and device windows by event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import SECOND

FRAME = "stream long, frame long, samples array<double>"
#: Rows of a stream of empty windows that are handed on at once.
CHUNK = 10_000


class _Frames(StatefulProcessor):
    """State of a stream: the samples of frames that aren't full yet."""

    def __init__(self, size: int, most_open: int) -> None:
        self.size, self.most_open = size, most_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "idx long, value double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        kept = [(i, v) for i, v in self.open.get()] if self.open.exists() else []
        every = pd.concat([pd.DataFrame(kept, columns=["idx", "value"]).astype({"idx": np.int64, "value": np.float64}), *[r[["idx", "value"]] for r in rows]]).sort_values("idx", kind="stable")
        frame = every.idx.to_numpy(np.int64) // self.size
        frames, first, n = np.unique(frame, return_index=True, return_counts=True)
        full = n == self.size
        values = every.value.to_numpy(np.float64)
        done = pd.Series([values[a : a + self.size] for a in first[full]], dtype=object)
        yield pd.DataFrame({"stream": np.full(len(done), int(key[0])), "frame": frames[full], "samples": done})
        rest = ~full & (frames > frames[-1] - self.most_open)
        left = every[np.isin(frame, frames[rest])]
        if len(left):
            self.open.put([(int(i), float(v)) for i, v in zip(left.idx, left.value)])
        elif kept:
            self.open.clear()

    def close(self) -> None:
        pass


def frames(samples: DataFrame, size: int, most_open: int = 1024) -> DataFrame:
    """stream, frame, samples: what operators.features.frame_samples() gives, as soon as a frame's size samples (stream, idx, value) are there.

    Samples may come in any order and split: a stream's state holds those of frames that aren't full. Frames that are most_open
    or more behind the stream's newest one are given up. Each idx must come once. Needs a state store with lists."""
    return samples.groupBy("stream").transformWithStateInPandas(_Frames(size, most_open), outputStructType=FRAME, outputMode="Append", timeMode="None")


WINDOW = "window_us long, cluster_count long, clusters array<struct<pseudonym:string,rssi:int>>"


class _Filled(StatefulProcessor):
    """State: the last window that was handed on. The windows between it and the next are empty ones."""

    def __init__(self, window_us: int) -> None:
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "window_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("window_us")
        last = self.last.get()[0] if self.last.exists() else None
        for at in every.window_us.tolist():
            low = at if last is None else last + self.window_us
            for a in range(low, at, CHUNK * self.window_us):
                empty = np.arange(a, min(at, a + CHUNK * self.window_us), self.window_us)
                yield pd.DataFrame({"window_us": empty, "cluster_count": np.zeros(len(empty), np.int64), "clusters": pd.Series([[]] * len(empty), dtype=object)})
            last = at
        self.last.update((last,))
        yield every[["window_us", "cluster_count", "clusters"]]

    def close(self) -> None:
        pass


def ble_windows(hits: DataFrame, window_us: int = 5 * SECOND, late_us: int = 30 * SECOND, empty: bool = True) -> DataFrame:
    """window_us, cluster_count, clusters of hits (pseudonym, ts_us, rssi): operators.features.ble_windows() for windows that the watermark has passed.

    Two aggregations follow each other in append mode, the devices' means in a window and then the window's clusters; a
    third stage, one row a window, hands on the empty windows up to each in chunks. Hits that are late_us or more behind the newest
    are dropped, see late_rows()."""
    timed = hits.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", f"{late_us} microseconds")
    length = f"{window_us} microseconds"
    each = timed.groupBy(F.window("at", length).alias("w"), "pseudonym").agg(F.expr("sum(rssi) div count(1)").cast("int").alias("rssi"))
    rows = each.groupBy(F.window("w", length).alias("v")).agg(F.count(F.lit(1)).alias("cluster_count"), F.array_sort(F.collect_list(F.struct("pseudonym", "rssi"))).alias("clusters"))
    found = rows.select(F.unix_micros("v.start").alias("window_us"), "cluster_count", "clusters")
    if not empty:
        return found
    return found.withColumn("all", F.lit(0)).groupBy("all").transformWithStateInPandas(_Filled(window_us), outputStructType=WINDOW, outputMode="Append", timeMode="None")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators of the query's recent batches dropped as late."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])
