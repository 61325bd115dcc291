"""Periodic runs of words: tiles for each octave of periods, boundary Z-functions in each, fragments stitched by document and period."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, small_batches, text_or_empty, written

#: A run holds at least so many words, and its period at least so many times.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Boundaries of a tile.
BOUNDARIES = 16
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

EXPLODED = "part int, row long, doc_id {id}, n long, words string, collapsed_sha256 string, least int, most int, at long, bounds array<int>, codes array<int>"


def octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """(least, most, step): octaves of periods that runs of n words can have, and the distance of boundaries.

    Words q apart are equal over a stretch of at least 2 * step words in every run of such a period q: so each run has a
    boundary in its stretch with step more words of the stretch behind it."""
    most = LEAST_WORDS // LEAST_TIMES
    least = 1
    while LEAST_TIMES * least <= n and n >= LEAST_WORDS:
        yield least, most, max(8, most // 2)
        least, most = most + 1, 2 * most


def _widened(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of twice as many words from those of `width` words; equal words have equal hashes, whatever else does."""
    with np.errstate(over="ignore"):
        mixed = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * np.uint64(_ODD[0])
        return mixed * np.uint64(_ODD[1]) + h[width:]


def tiles(codes: np.ndarray) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(least, most, at, bounds, codes): overlapping tiles of a document's words, for each octave of periods.

    A tile has the boundaries (relative to at) behind which the next step words come again within the octave's periods, and
    reaches two steps over them on both sides, and a period more. Tiles without such boundaries hold no run, nor part of one that
    another tile doesn't hold."""
    n = len(codes)
    out = []
    h, width = codes.astype(np.uint64), 1
    for least, most, step in octaves(n):
        while width < step and len(h) > width:
            h, width = _widened(h, width), 2 * width
        if width < step:
            break
        if step == 8:
            seen = np.sort(h)
            if not (seen[1:] == seen[:-1]).any():
                break  # no eight words come twice
        count = len(h)
        padded = np.append(h, np.zeros(most + 1, np.uint64))
        ahead = np.lib.stride_tricks.sliding_window_view(padded[least:], most - least + 1)[:count:step]
        hit = np.flatnonzero((ahead == h[::step, None]).any(axis=1)) * step
        if not len(hit):
            continue
        for tile in np.split(hit, np.flatnonzero(np.diff(hit // (step * BOUNDARIES))) + 1):
            low = max(0, int(tile[0]) - 2 * step)
            high = min(n, int(tile[-1]) + 2 * step + most)
            out.append((least, most, low, tile - low, codes[low:high]))
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place of s how many items from there equal those from its start (0 for place 0)."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def solve(least: int, most: int, bounds: list[int], codes: list[int]) -> list[tuple[int, int, int]]:
    """(period, low, high): fragments [low, high) over which words a period apart are equal, two steps from a boundary at most.

    Left out are fragments that end on both sides within that reach and are too short for a run."""
    step = max(8, most // 2)
    reach = 2 * step
    found: dict[int, list[list[int]]] = {}
    for m in bounds:
        forth = z_function(codes[m : m + reach + most])
        ahead = min(most, len(codes) - m)
        past = codes[max(0, m - reach) : m][::-1]
        back = z_function([*past, -1, *codes[max(0, m - reach) : m + ahead][::-1]])
        for q in range(least, min(most, len(forth) - 1) + 1):
            right = min(forth[q], reach)
            if right < step:
                continue
            left = back[len(past) + 1 + ahead - q]
            held = found.setdefault(q, [])
            if held and m - left <= held[-1][1]:
                held[-1][1] = max(held[-1][1], m + right)
                held[-1][2] |= int(left == reach or right == reach)
            else:
                held.append([m - left, m + right, int(left == reach or right == reach)])
    return [(q, a, b) for q, held in found.items() for a, b, open_ in held if open_ or b - a >= max(LEAST_WORDS - q, (LEAST_TIMES - 1) * q)]


def _explode(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """A settled row for each document without tiles, else a row with its words and one for each of its tiles."""
    names = [c.split()[0] for c in EXPLODED.split(", ")]
    for b in batches:
        kinds = [pa.int32(), pa.int64(), b.schema.types[1], pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        rows = []
        for key, doc, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            words = text.as_buffer().to_pybytes().split()  # at ASCII blanks
            known: dict[bytes, int] = {}
            codes = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
            found = tiles(codes) if len(known) < len(words) else []
            if found:
                rows.append((1, key, doc.as_py(), len(words), b" ".join(words).decode(), None, None, None, None, None, None))
                rows += [(2, key, None, None, None, None, least, most, at, bounds, part) for least, most, at, bounds, part in found]
            else:
                line = b" ".join(words)
                rows.append((0, key, doc.as_py(), len(words), line.decode() if with_text else None, hashlib.sha256(line).hexdigest(), None, None, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(key, q, at + low, at + high) for key, least, most, at, bounds, codes in zip(*[c.to_pylist() for c in b.columns]) for q, low, high in solve(least, most, bounds, codes)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["row", "period", "low", "high"])


def stitched(fragments: DataFrame) -> DataFrame:
    """row, start, length, period of the runs from fragments (row, period, low, high), which overlap or touch where they belong together.

    A stretch that is long enough for a multiple of its smallest period appears with both, and keeps the smallest."""
    one = Window.partitionBy("row", "period").orderBy("low", "high")
    reached = F.max("high").over(one.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("fresh", F.when(reached >= F.col("low"), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("row", "period", "island").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    long = whole.withColumn("length", F.col("high") - F.col("start") + F.col("period")).where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_TIMES * F.col("period")))
    return long.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def _best(runs: list[dict]) -> dict:
    return max(runs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]))


def collapsed(words: list[str], runs: list[dict]) -> str:
    """The words that no run holds after its first period, joined by one blank."""
    gone = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        gone[r["start"] + r["period"]] += 1
        gone[r["start"] + r["length"]] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return " ".join([w for w, k in zip(words, keep.tolist()) if k])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs,
    and with_text also collapsed.

    runs holds (start, length, period) by start, then period; start to exponent_milli tell the run with the greatest
    exponent, and are null where there is none. Null and empty texts have no words and no runs. Rows stand alone: repeated
    rows, null ids and ties pass through, other columns are not read, and an empty table gives no rows. Whole texts are
    read, however long: Python's work is linear in a document's words for each octave of periods, of which there are as many as
    its length has binary digits.
    """
    spark = docs.sparkSession
    small_batches(spark, size="4m")
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    every = written(rows.mapInArrow(lambda bs: _explode(bs, with_text), EXPLODED.format(id=kind)), "tiles")  # row numbers hold from here on
    tile = every.where("part = 2").select("row", "least", "most", "at", "bounds", "codes")
    runs = stitched(tile.mapInArrow(_fragments, "row long, period long, low long, high long"))
    lists = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    open_ = every.where("part = 1").select("row", "doc_id", "n", "words").join(lists, "row", "left")
    out = f"doc_id {kind}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    told = open_.select("doc_id", "n", "words", "runs").mapInArrow(_told, out)
    none = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    no_runs = F.array().cast("array<struct<start:long,length:long,period:long>>")
    plain = every.where("part = 0").select("doc_id", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_runs"), *none, F.sha2(F.lit(""), 256).alias("runs_sha256"), "collapsed_sha256", no_runs.alias("runs"), F.col("words").alias("collapsed"))
    found = plain.unionByName(told)
    return found if with_text else found.drop("collapsed")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [run, pa.string()]
    names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
    for b in batches:
        out = []
        for n, words, runs in zip(*[b.column(c).to_pylist() for c in ("n", "words", "runs")]):
            runs = runs or []
            said = "".join([f"{r['start']},{r['length']},{r['period']}\n" for r in runs])
            left = collapsed(words.split(" "), runs)
            best = _best(runs) if runs else None
            first = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
            out.append((n, len(runs), *first, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(), runs, left))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]], names)


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, in which a tenth of the documents, by their ids, repeat a stretch of their words to the end.

    With h = crc32 of the id's digits (none for a null id), g = h / 10 cut, and n words, word i >= a becomes word
    a + (i - a) % p where h % 10 = 0; a = g % n, p = 1 + (n - a) / (3 + g % 8) cut. Other texts, and texts without words, stay."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("w", F.when(F.col("g").isNotNull(), F.filter(F.split("text", BLANK + "+"), lambda x: x != "")))
    rows = rows.withColumn("n", F.when(F.size("w") > 0, F.size("w").cast("long"))).withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    again = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), again).otherwise(F.col("text")).alias("text"))
