"""Windowed reductions of raw samples to features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SECOND
from ..functions.scan import scan
from ..sources.shared import cut_lineage

ROLLOFF, JOINT_CONFIDENCE = 0.85, 0.25


def frame_samples(samples: DataFrame, size: int) -> DataFrame:
    """stream, frame, samples: frames of size consecutive samples (stream, idx, value); a partial last one is dropped."""
    cut = samples.withColumn("frame", F.floor(F.col("idx") / size))
    rows = cut.groupBy("stream", "frame").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("rows"))
    return rows.where(F.size("rows") == size).select("stream", "frame", F.transform("rows", lambda r: r["value"]).alias("samples"))


def _double(samples: str) -> Column:
    return F.transform(samples, lambda x: x.cast("double"))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def rms(samples: str = "samples") -> Column:
    x = _double(samples)
    return F.when(F.size(samples) > 0, F.sqrt(_sum(F.transform(x, lambda v: v * v)) / F.size(samples))).otherwise(0.0)


def peak(samples: str = "samples") -> Column:
    return F.coalesce(F.array_max(F.transform(_double(samples), lambda x: F.abs(x))), F.lit(0.0))


def zero_crossing_rate(samples: str = "samples") -> Column:
    positive = F.transform(samples, lambda x: x >= 0)
    shifted = F.slice(positive, 2, F.greatest(F.size(samples) - 1, F.lit(0)))
    flips = F.aggregate(F.zip_with(F.slice(positive, 1, F.greatest(F.size(samples) - 1, F.lit(0))), shifted, lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(samples) > 1, flips / (F.size(samples) - 1)).otherwise(0.0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def magnitude_spectrum(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Magnitudes of the Hann-windowed power-of-two prefix, half as many bins; bin 0 holds the constant and the Nyquist part together."""
    for batch in frames:
        out = [None] * len(batch)
        sizes = batch.map(lambda x: 0 if x is None or len(x) < 2 else 1 << (len(x).bit_length() - 1))
        for n in sizes.unique():
            at = np.flatnonzero(sizes.to_numpy() == n)
            if n == 0:
                for i in at:
                    out[i] = np.zeros(0)
                continue
            x = np.stack([np.asarray(batch.iloc[i][:n], np.float64) for i in at]) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n))
            f = np.fft.rfft(x)
            m = np.abs(f[:, : n // 2])
            m[:, 0] = np.hypot(f[:, 0].real, f[:, -1].real)
            for i, row in zip(at, m):
                out[i] = row
        yield pd.Series(out)


def centroid(mags: str, size: Column, rate: Column) -> Column:
    total = _sum(F.col(mags))
    return F.when(total > 0, _sum(F.transform(mags, lambda m, i: m * i * rate / size)) / total).otherwise(0.0)


def rolloff(mags: str, size: Column, rate: Column, share: float = ROLLOFF) -> Column:
    """The frequency of the first bin by which share of the magnitudes is reached."""
    total = _sum(F.col(mags))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("bins"))
    below = F.aggregate(mags, start, lambda a, m: F.struct((a["run"] + m).alias("run"), (a["bins"] + F.when(a["run"] + m < total * share, 1).otherwise(0)).alias("bins")))["bins"]
    return F.when(total > 0, F.least(below, F.size(mags) - 1) * rate / size).otherwise(0.0)


def flatness(mags: str) -> Column:
    some = F.filter(mags, lambda m: m > 0)
    n = F.size(some)
    return F.when(n > 0, F.exp(_sum(F.transform(some, lambda m: F.log(m))) / n) / (_sum(some) / n)).otherwise(0.0)


def voice_activity(energy: Column, crossings: Column, flat: Column) -> Column:
    voiced = ((crossings > 0.02) & (crossings < 0.35)).cast("double")
    return F.when(energy > 0.001, (voiced + (1.0 - F.least(flat, F.lit(1.0))) + F.least(energy * 10, F.lit(1.0))) / 3.0).otherwise(0.0)


def audio_features(frames: DataFrame, id_col: str = "frame_id") -> DataFrame:
    """All features of frames (id, samples, sample_rate)."""
    size = F.expr("CAST(pow(2, floor(log2(greatest(size(samples), 2)))) AS INT)")
    rows = frames.select(id_col, "samples", "sample_rate", magnitude_spectrum("samples").alias("mags"), rms().alias("rms"), peak().alias("peak"), zero_crossing_rate().alias("zero_crossing_rate"))
    rows = rows.withColumns({"spectral_centroid_hz": centroid("mags", size, F.col("sample_rate")), "spectral_rolloff_hz": rolloff("mags", size, F.col("sample_rate")), "spectral_flatness": flatness("mags")})
    return rows.withColumn("voice_activity_probability", voice_activity(F.col("rms"), F.col("zero_crossing_rate"), F.col("spectral_flatness"))).drop("samples", "sample_rate", "mags")


def ble_windows(hits: DataFrame, window_us: int = 5 * SECOND, empty: bool = True, chunk: int = 10_000) -> DataFrame:
    """window_us, cluster_count, clusters (pseudonym, mean rssi cut toward zero) of hits (pseudonym, ts_us, rssi); empty windows count 0.

    Each window makes the empty ones since the one before it, in rows of at most chunk windows that are dealt out before
    they are unfolded: a hit that is far from all others costs its empty windows, but no array or task of all of them."""
    at = (F.floor(F.col("ts_us") / window_us) * window_us).alias("window_us")
    each = hits.groupBy(at, "pseudonym").agg(F.expr("sum(rssi) div count(1)").cast("int").alias("rssi"))
    rows = each.groupBy("window_us").agg(F.count(F.lit(1)).alias("cluster_count"), F.array_sort(F.collect_list(F.struct("pseudonym", "rssi"))).alias("clusters"))
    if not empty:
        return rows
    rows = cut_lineage(rows)
    back = scan(rows.select("window_us"), [], ["window_us"], F.floor(F.col("window_us") / (window_us * 1_000_000)), {"_before": ("last_before", F.col("window_us"))})
    step = F.lit(window_us).cast("long")
    gaps = back.where(F.col("window_us") - F.col("_before") > window_us)
    starts = gaps.select(F.explode(F.sequence(F.col("_before") + step, F.col("window_us") - step, step * chunk)).alias("low"), F.col("window_us").alias("_high"))
    dealt = starts.repartition(F.col("low"))
    gap = dealt.select(F.explode(F.sequence("low", F.least(F.col("low") + step * (chunk - 1), F.col("_high") - step), step)).alias("window_us"))
    none = gap.select("window_us", F.lit(0).cast("long").alias("cluster_count"), F.array().cast("array<struct<pseudonym:string,rssi:int>>").alias("clusters"))
    return rows.unionByName(none)


def pose_filter(joints: str = "joints", least: float = JOINT_CONFIDENCE) -> Column:
    return F.filter(joints, lambda j: j["confidence"] >= least)


def pose_observation(joints: str = "joints") -> Column:
    return F.when(F.coalesce(F.size(joints), F.lit(0)) > 0, "one").otherwise("zero")


def conflate_latest(rows: DataFrame, batch: Column) -> DataFrame:
    """Of each drain batch the latest row by arrival of each stream."""
    fields = F.struct(*[c for c in rows.columns if c not in ("ledger_id", "sensor_stream_id")])
    return rows.groupBy("ledger_id", batch.alias("batch"), "sensor_stream_id").agg(F.max_by(fields, "arrival").alias("row")).select("ledger_id", "batch", "sensor_stream_id", "row.*")


def assign_sequence(rows: DataFrame, start: int = 1) -> DataFrame:
    """rows with sequence: each stream's count of its rows by arrival, after conflation."""
    return scan(rows, ["ledger_id", "sensor_stream_id"], ["arrival"], F.floor(F.col("arrival") / 1_000_000), {"sequence": ("sum_before", F.lit(1).cast("long"))}).withColumn("sequence", F.col("sequence") + start)


def acceptance_status(expected: DataFrame, counts: DataFrame) -> DataFrame:
    """stream, status for expected (stream, startup, discovered) given counts (stream, n)."""
    n = F.coalesce(F.col("n"), F.lit(0))
    # The words of a status.
    status = F.when(n > 0, "observed").when((F.col("discovered") > 0) & (F.col("startup") != "running"), "advertisers_detected_keychain_unavailable").when(F.col("startup") == "running", "no_advertisers_observed").otherwise(F.col("startup"))
    return expected.join(counts, "stream", "left").select("stream", n.alias("n"), status.alias("status"))
