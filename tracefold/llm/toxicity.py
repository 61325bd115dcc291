"""Toxicity: class-conditional Kneser-Ney models of words, with shared backoff counts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, written

#: Bounds of the fit: documents of either class, and characters of a class's documents together. All their words and word pairs are kept.
MOST_TOXIC, MOST_ORDINARY, MOST_CHARACTERS = 5_000, 10_000, 100_000_000
#: The parts of the training rows (remainders of their ids): each is calibrated on counts of the others. The lengths of the windows whose ratios are compared.
FOLDS, WINDOWS = (0, 1, 3), (1, 2, 4)
#: Bits of a hash of the word before; distinct pairs that a task holds before it sends them on.
HASHED, MOST_MARKS = 36, 4_000_000
FEATURES = tuple(f"{order}_{n}" for order in ("word", "pair") for n in (*WINDOWS, "all"))
THRESHOLD = 0.3
WORDS = re.compile(r"[^\W_]+")
_ASCII = str.maketrans({chr(c): chr(c).lower() if chr(c).isalnum() else " " for c in range(128)})


def words(text: str | None) -> list[str]:
    """WORDS in the lower-cased text; where all is ASCII, by a table, which is faster."""
    text = text or ""
    return text.translate(_ASCII).split() if text.isascii() else WORDS.findall(text.lower())


def numbered_words(texts: Iterable[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of texts, first the empty one; the numbers of all words in order, each text's after a 0; where texts start."""
    number: defaultdict[str, int] = defaultdict(count().__next__)
    ids: list[int] = []
    starts = []
    number[""]
    for text in texts:
        starts.append(len(ids))
        ids.append(0)
        ids += map(number.__getitem__, words(text))
    return list(number), np.array(ids, np.int64), np.array([*starts, len(ids)], np.int64)


def hashes(some: list[str]) -> np.ndarray:
    """Spark's xxhash64 of strings."""
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in some], np.uint64).view(np.int64)


def found(sorted_: np.ndarray, wanted: np.ndarray, none: int) -> np.ndarray:
    """Where wanted stands in sorted_, none for what isn't there."""
    if not len(sorted_):
        return np.full(len(wanted), none, np.int64)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, none)


@dataclass
class Model:
    """Log-likelihood ratios (toxic over ordinary) of words after words, ready for lookup."""

    vocabulary: np.ndarray  # sorted hashes of the words
    word: np.ndarray  # of a word alone; the last is for unknown words
    back: np.ndarray  # of the backoff weights of a word before, for pairs that aren't known
    pairs: np.ndarray  # sorted keys of known pairs
    pair: np.ndarray  # their ratios
    weights: np.ndarray  # of the calibration: constant, most toxic windows, whole text

    def features(self, texts: Iterable[str | None]) -> np.ndarray:
        """Length-normalised ratios of each text, of words alone and of words after words: of the most toxic window of each length, and of the whole text."""
        names, ids, starts = numbered_words(texts)
        unknown = len(self.word) - 1
        at = found(self.vocabulary, hashes(names), unknown)[ids]
        alone = self.word[at]
        ratio = alone.copy()
        if len(at) > 1:
            before, here = at[:-1].copy(), at[1:]
            before[ids[:-1] == 0] = unknown  # a text's first word follows nothing
            ratio[1:] += np.where(here == unknown, 0.0, self.back[before])
            place = found(self.pairs, before * (unknown + 1) + here, -1)
            ratio[1:] = np.where(place >= 0, self.pair[place] if len(self.pair) else 0.0, ratio[1:])
        out = np.zeros((len(starts) - 1, len(FEATURES)))
        for i, (a, b) in enumerate(zip((starts[:-1] + 1).tolist(), starts[1:].tolist())):
            for j, order in enumerate((alone, ratio) if b > a else ()):
                total = np.concatenate([[0.0], np.cumsum(order[a:b])])
                most = [(total[n:] - total[:-n]).max() / length for length in WINDOWS for n in [min(length, b - a)]]
                out[i, j * len(most) + j : (j + 1) * (len(most) + 1)] = [*most, total[-1] / (b - a)]
        return out

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        z = self.weights[0] + self.features(texts) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, rest, before, word, n) of each batch; before is empty at a text's start."""
    for b in batches:
        n: Counter[tuple[int, int, str, str]] = Counter()
        for y, rest, text in zip(*[b.column(i).to_pylist() for i in range(3)]):
            got = words(text)
            n.update(zip(repeat(y), repeat(rest), ["", *got], got))
        keys = list(n)
        yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.int32()) for i in (0, 1)], *[pa.array([k[i] for k in keys], pa.string()) for i in (2, 3)], pa.array(n.values(), pa.int64())], ["toxic", "rest", "before", "word", "n"])


def remainder(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text, rest: the labelled training rows (crc32 of the id mod 4 is rest, not 2), bounded for each class.

    Which rows are taken follows a hash of their ids, up to MOST_TOXIC or MOST_ORDINARY rows and MOST_CHARACTERS characters; so
    the broadcast of their ids is bounded too."""
    known = labels.where(remainder() != 2).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    by = (F.xxhash64("doc_id"), F.col("doc_id"))
    few = known.where("toxic = 1").orderBy(*by).limit(MOST_TOXIC).union(known.where("toxic = 0").orderBy(*by).limit(MOST_ORDINARY))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sizes = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(*by))  # over the few rows taken
    bounded = written(sizes.withColumn("upto", upto).where(F.col("upto") <= MOST_CHARACTERS).select("doc_id", "toxic"), "sample")
    return texts.join(F.broadcast(bounded), "doc_id").select("toxic", "text", remainder().cast("int").alias("rest"))


def packed(sorted_: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as zstandard bytes of their steps, equal bytes of all together."""
    steps = np.diff(sorted_, prepend=np.uint64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def continuations(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Over all texts of docs, without labels: the distinct words before each word of the vocabulary (sorted hashes), all distinct pairs, all distinct words.

    A pair is one number: its word's place in the vocabulary and a hash of the word before, of HASHED bits. A pair whose
    word the vocabulary lacks is a hash with the bit APART, and such a word itself one with the bit NEW. Tasks send their
    distinct numbers sorted and packed, dealt to buckets by word; a bucket's are united and counted in one task. There are
    eight buckets for each shuffle partition, and a word has at most as many pairs as there are words."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    buckets = 8 * partitions(docs.sparkSession)
    shift, low = np.uint64(HASHED), np.uint64(64 - HASHED)
    apart, new, rest = np.uint64(1 << 62), np.uint64(1 << 63), np.uint64(8)

    def dealt(marks: list[np.ndarray]) -> pa.RecordBatch:
        every = np.unique(np.concatenate(marks))
        bucket = ((every >> shift) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        parts = [packed(x) for x in np.split(every[order], first[1:])] if len(names) else []
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(parts, pa.binary())], ["bucket", "marks"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list[np.ndarray] = []
        for b in batches:
            names, at, _ = numbered_words(b.column(0).to_pylist())
            size = len(names)
            pairs = np.unique((at[:-1] * size + at[1:])[at[1:] > 0]) if len(at) > 1 else np.zeros(0, np.int64)
            signed = hashes(names)
            hashed = signed.view(np.uint64)
            place = found(held.value, signed, -1)
            before, word = np.divmod(pairs, size)
            known = place[word] >= 0
            marks.append(place[word[known]].astype(np.uint64) << shift | hashed[before[known]] >> low)
            marks.append((hashed[before[~known]] * np.uint64(0x9E3779B97F4A7C15) + hashed[word[~known]]) >> rest | apart)
            marks.append(hashed[1:][place[1:] < 0] >> rest | new)
            if sum(map(len, marks)) > MOST_MARKS:
                yield dealt(marks)
                marks = []
        if marks:
            yield dealt(marks)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros(0, np.uint64)
        parts: list[np.ndarray] = []
        for b in batches:  # unites as it reads: holds the distinct numbers, and about as many more at most
            for x in b.column("marks"):
                parts.append(unpacked(x.as_py()))
                if sum(map(len, parts)) > max(len(every), MOST_MARKS):
                    every, parts = np.unique(np.concatenate([every, *parts])), []
        every = np.unique(np.concatenate([every, *parts]))
        ends = np.searchsorted(every, [apart, new])
        word, n = np.unique(every[: ends[0]] >> shift, return_counts=True)
        rows = [(-1, ends[1] - ends[0]), (-2, len(every) - ends[1])]
        yield pa.RecordBatch.from_arrays([pa.array([*word.astype(np.int64).tolist(), *[r[0] for r in rows]], pa.int32()), pa.array([*n.tolist(), *[int(r[1]) for r in rows]], pa.int64())], ["word", "n"])

    met = docs.select(F.col("text").cast("string")).mapInArrow(seen, "bucket int, marks binary").groupBy("bucket").applyInArrow(counted, "word int, n long")
    n = met.groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    at, n = n.column("word").to_numpy(), n.column("n").to_numpy()
    left = np.zeros(len(vocabulary))
    left[at[at >= 0]] = n[at >= 0]
    return left, int(n[at != -2].sum()), int((at >= 0).sum() + n[at == -2].sum())


def discounts_of(counts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Kneser-Ney's discounts of counts 1, 2, and 3 or more, from how often counts occur: under 1, 2 and 3.

    counts[i] occurs times[i] times. A count that never occurs stands for one occurrence."""
    seen = dict(zip(counts.astype(np.int64).tolist(), times.tolist()))
    n1, n2, n3, n4 = (max(1.0, seen.get(r, 0.0)) for r in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    raw = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    most = np.array([1.0, 2.0, 3.0])
    return np.clip(raw, 0.05 * most, 0.95 * most)


def discounted(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    """What each count gives up."""
    return np.append(0.0, discounts)[np.clip(counts, 0, 3).astype(np.int64)]


@dataclass
class Tallies:
    """Counts of the sample by part of it, and what the whole corpus says of its words."""

    pairs: DataFrame  # before, word, and n{class}_{fold}
    vocabulary: pd.DataFrame  # hash of each word, sorted, with left: the distinct words before it in all documents
    all_left: int
    distinct: int

    def model(self, without: int | None = None) -> Model:
        """The model of all parts but one, uncalibrated. Counting is distributed, and so are the pairs' ratios; the driver gets
        numbers of the sample's words and a key and a ratio for each of their pairs."""
        parts = [k for k in FOLDS if k != without]
        n = [sum((F.col(f"n{y}_{k}") for k in parts[1:]), F.col(f"n{y}_{parts[0]}")).alias(f"n{y}") for y in (0, 1)]
        counts = self.pairs.select("before", "word", *n).where("n0 + n1 > 0")
        discounts = [discounts_of(*counts_of(counts, f"n{y}")) for y in (0, 1)]
        given = lambda y: F.when(F.col(f"n{y}") > 0, F.element_at(F.array(*[F.lit(float(d)) for d in discounts[y]]), F.least(F.col(f"n{y}"), F.lit(3)).cast("int"))).otherwise(0.0)
        by_word = counts.groupBy("word").agg(*[F.sum((F.col(f"n{y}") > 0).cast("long")).alias(f"left{y}") for y in (0, 1)])  # distinct words before: Kneser-Ney's counts
        by_before = counts.groupBy("before").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), *[F.sum(given(y)).alias(f"free{y}") for y in (0, 1)])
        known = by_word.join(by_before, by_word.word == by_before.before, "left").select(F.xxhash64("word").alias("hash"), *[F.coalesce(c + str(y), F.lit(0)).alias(c + str(y)) for c in ("left", "c", "free") for y in (0, 1)]).orderBy("hash").toArrow().to_pandas()
        return self._estimated(known.merge(self.vocabulary, on="hash").sort_values("hash"), counts, discounts)

    def _estimated(self, known: pd.DataFrame, counts: DataFrame, discounts: list[np.ndarray]) -> Model:
        """Absolute discounting at both orders; what it frees goes to the words' shares among the words before, over all documents."""
        vocabulary = known["hash"].to_numpy(np.int64)
        size = len(vocabulary)
        total = max(1, self.all_left) + max(1, self.distinct)
        shared = np.append((known["left"].to_numpy(np.float64) + 1) / total, 1 / total)
        uni, back, after = [], [], []
        for y in (0, 1):
            left = known[f"left{y}"].to_numpy(np.float64)
            given = discounted(left, discounts_of(*np.unique(left[left > 0], return_counts=True)))
            all_left = max(1.0, left.sum())
            uni.append(np.append((left - given) / all_left, 0.0) + (given.sum() / all_left or 1.0) * shared)
            c = known[f"c{y}"].to_numpy(np.float64)
            after.append(np.append(np.maximum(c, 1), 1.0))
            back.append(np.append(np.where(c > 0, known[f"free{y}"].to_numpy(np.float64) / np.maximum(c, 1), 1.0), 1.0))
        held = counts.sparkSession.sparkContext.broadcast((vocabulary, uni, back, after))

        def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, uni, back, after = held.value
            for batch in batches:
                a, b = (found(vocabulary, batch.column(i).to_numpy(), size) for i in (0, 1))
                n = [batch.column(2 + y).to_numpy() for y in (0, 1)]
                both = [(n[y] - discounted(n[y], discounts[y])) / after[y][a] + back[y][a] * uni[y][b] for y in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(a * (size + 1) + b), pa.array(np.log(both[1] / both[0]).astype(np.float32))], ["key", "ratio"])

        hashed = counts.where("before <> ''").select(F.xxhash64("before"), F.xxhash64("word"), "n0", "n1")
        got = hashed.mapInArrow(ratios, "key long, ratio float").toArrow()
        held.unpersist()
        keys, ratio = got.column("key").to_numpy(), got.column("ratio").to_numpy()
        order = np.argsort(keys)
        word = np.log(uni[1] / uni[0])
        word[-1] = 0.0  # an unknown word says nothing of the class
        return Model(vocabulary, word, np.log(back[1] / back[0]), keys[order], ratio[order], np.zeros(len(FEATURES) + 1))


def tallied(rows: DataFrame, docs: DataFrame) -> Tallies:
    """Counts of rows (toxic, text, rest), and the backoff counts of their words over all docs (text)."""
    each = rows.select("toxic", "rest", "text").mapInArrow(_counts, "toxic int, rest int, before string, word string, n long")
    n = lambda y, k: F.sum(F.when((F.col("toxic") == y) & (F.col("rest") == k), F.col("n")).otherwise(0)).alias(f"n{y}_{k}")
    pairs = written(each.groupBy("before", "word").agg(*[n(y, k) for y in (0, 1) for k in FOLDS]), "ngrams")
    known = pairs.select("word").distinct().select(F.xxhash64("word").alias("hash")).orderBy("hash").toArrow().to_pandas()
    if known["hash"].duplicated().any():
        raise RuntimeError("two words share a 64-bit hash")
    left, all_left, distinct = continuations(docs, known["hash"].to_numpy(np.int64))
    return Tallies(pairs, known.assign(left=left), all_left, distinct)


def counts_of(table: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The counts above 0 in a column, and how often each occurs."""
    got = table.where(F.col(name) > 0).groupBy(name).agg(F.count(F.lit(1)).alias("times")).toPandas()
    return got[name].to_numpy(np.float64), got["times"].to_numpy(np.float64)


def calibrated(features: np.ndarray, toxic: np.ndarray, odds: float) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; odds: how much rarer toxic rows are than in these."""
    n = len(FEATURES) + 1
    x = np.column_stack([np.ones(len(features)), features]) if len(features) else np.zeros((0, n))
    w = np.zeros(n)
    ridge = np.diag([1e-3] + [0.005] * (n - 1))
    loss = lambda v: float(np.logaddexp(0, x @ v).sum() - toxic @ (x @ v) + v @ ridge @ v / 2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    w[0] += np.log(odds)
    return w


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all training rows, calibrated on features that each part of them gets from counts of the other parts.

    So chance words, which a count of 1 tells of as of true ones, weigh in the calibration as they will in new texts."""
    rows = written(sample(docs, labels), "toxic")
    tallies = tallied(rows, docs)
    context, names = docs.sparkSession.sparkContext, list(FEATURES)
    parts = []
    for k in FOLDS:
        held = context.broadcast(tallies.model(k))

        def features(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = held.value.features(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(got[:, i]) for i in range(len(names))]], ["toxic", *names])

        parts.append(rows.where(f"rest = {k}").select("toxic", "text").mapInArrow(features, "toxic int, " + ", ".join(f"{c} double" for c in names)).toPandas())
        held.destroy()
    fit = pd.concat(parts)
    real = {r.toxic: r.n for r in labels.where(remainder() != 2).groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = fit["toxic"].value_counts()
    odds = 1.0
    if min(taken.get(0, 0), taken.get(1, 0), real.get(0, 0), real.get(1, 0)) > 0:
        odds = (real[1] / real[0]) / (taken[1] / taken[0])
    model = tallies.model()
    model.weights = calibrated(fit[names].to_numpy(np.float64), fit["toxic"].to_numpy(np.float64), odds)
    if not len(fit):
        model.weights[0] = -5.0
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Only texts enter a score. Labels are learnt from rows whose crc32(doc_id as text) mod 4 is not 2, from a sample
    bounded by MOST_TOXIC, MOST_ORDINARY and MOST_CHARACTERS, all of whose words and pairs count; backoff counts, which know no label,
    come from all docs. Every whole text is scored. A null or empty text gets the score of no
    evidence. Without labels of both classes scores say nothing but stay in range. Rows that repeat get equal scores;
    null ids are not held out; a doc_id with contrary labels counts as toxic.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(fitted(docs, labels))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.scores(t.as_py() for t in b.column(1)), pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scores, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
