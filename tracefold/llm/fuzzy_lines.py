"""Line dedup: fuzzy lines by MinHash.

With DataFrame functions alone the signatures of all shingles take some 320 CPU seconds a GB where 400 are allowed for
everything, so signatures and Jaccard similarities are computed by numpy and sets in tasks; all shuffles, joins and the
union-find are DataFrame operations.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, hot_join, partitions, small_batches, text_or_empty, written

SIMILARITY = 0.8
BANDS, ROWS = 16, 6
#: Signatures and verification take all runs of GRAM characters; signatures are computed for about CHUNK characters at once.
GRAM, CHUNK = 5, 1 << 16
#: One-permutation hashing: each of PERMUTATIONS hashes of a shingle falls into one of BINS bins, whose least is kept.
PERMUTATIONS = 2
BINS = BANDS * ROWS // PERMUTATIONS
#: A bucket of at most these members and characters is settled in one task; of FEW members by comparing all, else by an index.
TASK_LINES, TASK_CHARS, FEW = 10_000, 1_000_000, 16
#: Larger buckets are split by their members' rare shingles, groups are paired in blocks of BLOCK rows; one of SMALL needs no split.
SMALL, BLOCK = 64, 500
#: Bits of the filter of shared keys, as a power of two; it is broadcast.
FILTER_BITS = 27
#: Shingle sets of a head's lines are kept while these lines have at most so many characters together, else made for each comparison.
KEPT_CHARS = 100_000
#: From so many candidates of a line on, their common shingles are counted together.
MANY = 32

_RANDOM = np.random.Generator(np.random.PCG64(20))
#: Odd factors that mix a shingle for a permutation, and minima into keys.
_SEED = _RANDOM.integers(1, 1 << 62, size=PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_MIX = _RANDOM.integers(1, 1 << 62, size=BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_POWER = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(GRAM)], np.uint64)


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line_no, line: every line of every text; white space at a line's ends doesn't count."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(" \t\n\x0b\x0c\r")))


def line_id(seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), "line")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(lines: list[str]) -> list[np.ndarray | None]:
    """BANDS keys of each line, each hashing ROWS minima; None for a line without shingles."""
    out: list[np.ndarray | None] = [None] * len(lines)
    some = [i for i, x in enumerate(lines) if len(x) >= GRAM]
    while some:
        ends = np.cumsum([len(lines[i]) for i in some[:CHUNK // GRAM]])
        n = max(1, int(np.searchsorted(ends, CHUNK, "right")))
        for i, row in zip(some[:n], _keys([lines[i] for i in some[:n]]).view(np.int64)):
            out[i] = row
        some = some[n:]
    return out


def _shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every shingle of lines of GRAM characters or more, and the number of its line."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.array([len(x) for x in lines]) - GRAM + 1
    at = np.arange(counts.sum()) + np.repeat((GRAM - 1) * np.arange(len(lines)), counts)  # no shingle spans two lines
    whole = sum(codes[j : len(codes) - GRAM + 1 + j] * _POWER[j] for j in range(GRAM))[at]
    return whole, np.repeat(np.arange(len(lines)), counts)


def _keys(lines: list[str]) -> np.ndarray:
    whole, line = _shingles(lines)
    owner = line.astype(np.uint64) * np.uint64(BINS)
    minima = np.concatenate([_least(_mixed(whole * seed), owner, len(lines)) for seed in _SEED], axis=1)
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for i in range(BANDS * ROWS):
        keys[:, i % BANDS] = _mixed(keys[:, i % BANDS] + (minima[:, i] + np.uint64(1)) * _MIX[i])
    return keys


def _least(hashes: np.ndarray, first: np.ndarray, lines: int) -> np.ndarray:
    """The least 32 bits of the hashes in each bin [line, BINS]; an empty bin has those of the next one that isn't, around the end.

    first is the number of a line's first bin. Of two sets' union, the element that decides a bin is any with equal
    chance, so minima agree as often as the sets' Jaccard similarity says."""
    high = np.uint64(32)
    cells = first + ((hashes >> high) * np.uint64(BINS) >> high)
    ordered = cells << high | (hashes & np.uint64(0xFFFFFFFF))
    ordered.sort()
    cells = ordered >> high
    heads = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    filled = cells[heads].astype(np.int64)
    out = np.zeros(lines * BINS, np.uint64)
    out[filled] = ordered[heads] & np.uint64(0xFFFFFFFF)
    bins = np.full((lines, 2 * BINS), 2 * BINS, np.int64)
    bins[filled // BINS, filled % BINS] = filled % BINS
    bins[:, BINS:] = bins[:, :BINS] + BINS
    after = np.minimum.accumulate(bins[:, ::-1], axis=1)[:, ::-1][:, :BINS] % BINS
    return np.take_along_axis(out.reshape(lines, BINS), after, axis=1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = pa.array(band_keys(b.column(1).to_pylist()) if b.num_rows else [], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys], ["id", "line", "keys"])


def signatures(lines: DataFrame) -> DataFrame:
    """id, line, keys of distinct lines."""
    small_batches(lines.sparkSession, 5000, "8m")
    return lines.select(line_id().alias("id"), "line").mapInArrow(_signed, "id long, line string, keys array<long>")


def collisions(lines: DataFrame, most: int = 100_000) -> DataFrame | None:
    """(line, other_id) for lines that share their 64-bit id with another line; there are hardly any, and more than most fail."""
    twice = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(most + 1).select("id").collect()
    if len(twice) > most:
        raise RuntimeError("too many equal hashes of different lines")
    return lines.where(F.col("id").isin([r.id for r in twice])).select("line", line_id(1).alias("other_id")) if twice else None


def identified(rows: DataFrame, other: DataFrame | None) -> DataFrame:
    """rows (line, ...) with id, the same for equal lines and different for others."""
    named = rows.withColumn("id", line_id())
    if other is None:
        return named
    return named.join(F.broadcast(other), "line", "left").withColumn("id", F.coalesce("other_id", "id")).drop("other_id")


def perhaps(rows: DataFrame, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """rows whose key may be one of keys (key): all that are, and of the others the share of bits that are set.

    The filter that is broadcast has 2 ** bits bits, however many keys there are."""
    slot = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1 << bits))
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    words = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("set"))
    held = F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(63).alias("at"), "set")))
    blocks = words.groupBy(F.shiftright("word", 6).alias("block")).agg(held.alias("held"))
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long")))
    near = rows.withColumn("slot", slot).withColumn("block", F.shiftright("slot", 12))
    word = F.get("words", F.shiftright("slot", 6).bitwiseAND(63).cast("int"))
    met = near.join(F.broadcast(blocks.select("block", full.alias("words"))), "block")
    return met.where(F.getbit(word, F.col("slot").bitwiseAND(63).cast("int")) == 1).select(*rows.columns)


def buckets(bands: DataFrame) -> DataFrame:
    """key, id, n, head, chars of the buckets of n = two and more members; head is the first of them, chars the sum of
    their sizes, where bands (key, id) have a size. Of buckets with the same members one is returned.

    Counts combine before the shuffle, a filter of the shared keys keeps most other rows from it, and a bucket with a
    large share of all rows is joined by a broadcast."""
    size = F.col("size") if "size" in bands.columns else F.lit(0)
    shared = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "shared")
    some = written(perhaps(bands.select("key", "id", size.alias("size")), shared.select("key")), "perhaps")
    met = written(hot_join(some, shared, "key", "rows"), "met")
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "id")).alias(f"mark{i}") for i in (1, 2)]
    each = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head"), F.sum("size").alias("chars"), *marks)
    one = each.groupBy("n", "head", "mark1", "mark2").agg(F.min_by(F.struct("key", "chars"), "key").alias("one"))
    chosen = written(one.select("one.*", "n", "head", F.col("n").alias("rows")), "chosen")
    return written(hot_join(met.select("key", "id"), chosen, "key", "rows"), "buckets")


def grams(t: str) -> set[str]:
    return {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}


def _alike(x: set[str], y: set[str], similarity: float) -> bool:
    both = len(x & y) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
    return both > 0 and both >= similarity * (len(x) + len(y) - both)


class _Index:
    """Which lines of a bucket may be as similar to a given one.

    Two lines can only be so if they share one of the rarest size - ceil(similarity * size) + 1 shingles of each."""

    def __init__(self, lines: list[str], similarity: float):
        whole, line = _shingles(lines)
        n = len(lines)
        _, gram = np.unique(whole, return_inverse=True)
        cells = np.unique(gram * n + line)  # by shingle, then line
        self.similarity = similarity
        self.lines = cells % n
        grams_ = cells // n
        self.sizes = np.bincount(self.lines, minlength=n)
        often = np.bincount(grams_)
        self.starts = np.append(0, np.cumsum(often))
        order = np.lexsort((grams_, often[grams_], self.lines))  # by line, its rarest shingles first
        self.grams = grams_[order]
        self.first = np.append(0, np.cumsum(self.sizes))
        self.prefix = self.sizes - np.ceil(self.sizes * similarity - 1e-9).astype(np.int64) + 1
        rank = np.arange(len(order)) - np.repeat(self.first[:-1], self.sizes)
        early = np.zeros(len(cells), bool)
        early[order] = rank < np.repeat(self.prefix, self.sizes)
        self.early = self.lines[early]
        self.early_starts = np.append(0, np.cumsum(np.bincount(grams_[early], minlength=len(often))))

    def near(self, x: int) -> np.ndarray:
        own = self.grams[self.first[x] : self.first[x + 1]]
        some = np.unique(np.concatenate([self.early[self.early_starts[g] : self.early_starts[g + 1]] for g in own[: self.prefix[x]]]))
        low, high = np.minimum(self.sizes[some], self.sizes[x]), np.maximum(self.sizes[some], self.sizes[x])
        some = some[(low >= high * self.similarity - 1e-9) & (some != x)]
        if len(some) > MANY:
            both = np.bincount(np.concatenate([self.lines[self.starts[g] : self.starts[g + 1]] for g in own]), minlength=len(self.sizes))[some]
            some = some[both >= self.similarity * (self.sizes[some] + self.sizes[x] - both) - 1e-9]
        return some


def bucket_links(lines: list[str], groups: list[list[int]], similarity: float) -> list[tuple[int, int]]:
    """Similar pairs of lines that connect all that similar pairs within the groups of their numbers connect.

    Line 0 is in every group and all are compared with it, once; then, in each group, those outside its largest part so
    far with all that may be similar."""
    root = list(range(len(lines)))
    out = []
    sets: dict[int, set[str]] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def shingles(i: int, keep: bool) -> set[str]:
        x = sets.get(i)
        if x is None:
            x = grams(lines[i])
            if keep:
                sets[i] = x
        return x

    def meet(i: int, j: int, x: set[str], y: set[str]) -> None:
        if _alike(x, y, similarity):
            root[find(j)] = find(i)
            out.append((i, j))

    small = len(lines) <= FEW or sum(map(len, lines)) <= KEPT_CHARS
    first = shingles(0, True)
    for j in range(1, len(lines)):
        meet(0, j, first, shingles(j, small))
    unlike = set()
    for group in groups:
        parts = [find(i) for i in group]
        main = Counter(parts).most_common(1)[0][0]
        rest = [k for k, (i, p) in enumerate(zip(group, parts)) if p != main and i]
        if len(group) == 2 or not rest:
            continue
        few = len(group) <= FEW
        index = None if few else _Index([lines[i] for i in group], similarity)
        done = set()
        for k in rest:
            done.add(k)
            i = group[k]
            x = None
            for m in range(len(group)) if few else index.near(k).tolist():
                j = group[m]
                if j and m not in done and find(i) != find(j) and not (few and (min(i, j), max(i, j)) in unlike):
                    x = shingles(i, small) if x is None else x
                    meet(i, j, x, shingles(j, small))
                    if few:
                        unlike.add((min(i, j), max(i, j)))
    return out


def settled(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect what similar pairs within the buckets of rows (key, id, head) connect.

    All buckets of a head, at most BANDS, are one task's, which has each line once with the keys of its buckets."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str], list[list[int]]]]:
        head, ids, lines, keys = None, [], [], []
        for batch in batches:
            for h, i, line, own in zip(*(c.to_pylist() for c in batch.columns)):
                if h != head:
                    if ids:
                        yield ids, lines, keys
                    head, ids, lines, keys = h, [], [], []
                ids.append(i)
                lines.append(line)
                keys.append(own)
        if ids:
            yield ids, lines, keys

    def linked_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for ids, lines, keys in heads(batches):
            groups: dict[int, list[int]] = {}
            for i, own in enumerate(keys):
                for key in own:
                    groups.setdefault(key, []).append(i)
            for i, j in bucket_links(lines, list(groups.values()), similarity):
                a.append(ids[i])
                b.append(ids[j])
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    once = rows.groupBy("head", "id").agg(F.collect_list("key").alias("keys"))  # at most BANDS keys
    met = once.join(texts, "id").select("head", "id", "line", "keys")
    dealt = met.repartition(partitions(rows.sparkSession), "head").sortWithinPartitions("head", "id")
    return dealt.mapInArrow(linked_, "a long, b long")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 200):
            part = b.slice(i, 200)
            sets = [list(grams(t)) for t in part.column(3).to_pylist()]
            sizes = [len(x) for x in sets]
            at = np.repeat(np.arange(len(sets)), sizes)
            rest = [part.column(c).take(pa.array(at)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.array(sizes, np.int32)[at]), pa.array([g for x in sets for g in x], pa.string())], ["key", "id", "part", "size", "gram"])


def crossing(rows: DataFrame, by: list[str], similarity: float) -> DataFrame:
    """All pairs (a, b) of rows (by, id, part, size) of equal by whose parts differ and whose sizes allow the similarity.

    Members of a group's largest part meet only those outside it, so a large component isn't paired with itself. Each
    pair of blocks of a group is joined apart, so no task follows the size of a group."""
    sizes = rows.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("m"))
    groups = sizes.groupBy(*by).agg(F.sum("m").alias("m"), F.max("m").alias("most"), F.max_by("part", F.struct("m", "part")).alias("main")).where("most < m")
    dealt = rows.join(groups.select(*by, "main", F.ceil(F.col("m") / BLOCK).alias("blocks"), F.ceil((F.col("m") - F.col("most")) / BLOCK).alias("others")), by)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("id"), n)
    left = dealt.where("part <> main").select(*by, block("others").alias("i"), spread("blocks").alias("j"), F.col("id").alias("x"), F.col("part").alias("px"), F.col("size").alias("sx"))
    right = dealt.select(*by, spread("others").alias("i"), block("blocks").alias("j"), F.col("id").alias("y"), F.col("part").alias("py"), F.col("size").alias("sy"), (F.col("part") == F.col("main")).alias("in_main"))
    fits = F.coalesce(F.least("sx", "sy") >= F.greatest("sx", "sy") * similarity - 1e-9, F.lit(True))
    met = left.join(right, [*by, "i", "j"]).where((F.col("px") != F.col("py")) & (F.col("in_main") | (F.col("x") < F.col("y"))) & fits)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def open_pairs(rows: DataFrame, found: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of bucket members that may be similar and aren't in one component yet.

    rows are buckets(), found the components of the links to their heads. Small buckets give all pairs. In large ones
    two members can only be similar if they share one of the rarest size - ceil(similarity * size) + 1 shingles of each
    (rare in the bucket), so members meet by those: no pair is lost, and lines of one template don't all meet."""
    parts = rows.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("part"))
    mixed = parts.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    some = written(parts.join(mixed, "key"), "mixed")
    small = crossing(some.where(F.col("n") <= SMALL).select("key", "id", "part", F.lit(None).cast("int").alias("size")), ["key"], similarity)
    large = some.where(F.col("n") > SMALL).join(texts, "id").select("key", "id", "part", "line")
    told = written(large.mapInArrow(_grams, "key long, id long, part long, size int, gram string"), "grams")
    often = told.groupBy("key", "gram").agg(F.count(F.lit(1)).alias("often"))
    rarest = Window.partitionBy("key", "id").orderBy("often", "gram")
    ranked = told.join(often, ["key", "gram"]).withColumn("rank", F.row_number().over(rarest))
    prefix = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    near = written(ranked.where((F.col("rank") <= prefix) & (F.col("often") > 1)).drop("rank", "often"), "prefixes")
    return small.union(crossing(near, ["key", "gram"], similarity)).distinct()


def jaccard(a: str, b: str) -> float:
    x, y = grams(a), grams(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if both else 0.0


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose texts' (id, line) sets of GRAM-character shingles have that Jaccard similarity or more."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, frozenset()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:  # rows come sorted by a
                    last, x = a, grams(a)
                keep.append(_alike(x, grams(b), similarity))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = texts.select(F.col("id").alias("a"), F.col("line").alias("la")), texts.select(F.col("id").alias("b"), F.col("line").alias("lb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "la", "lb").mapInArrow(alike, "a long, b long")


def linked(rows: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the lines that similar pairs within buckets() link.

    A bucket within TASK_LINES and TASK_CHARS is settled in a task. Members of larger ones are compared with their bucket's
    head first, which joins large groups of copies by few pairs; then every pair of a bucket that this left in different
    components is compared, or ruled out by its shingles."""
    texts = written(lines.select("id", "line").join(rows.select("id").distinct(), "id", "left_semi"), "bucketed")
    fits = (F.col("n") <= TASK_LINES) & (F.col("chars") <= TASK_CHARS)
    links = written(settled(rows.where(fits), texts, similarity), "links")
    large = rows.where(~fits)
    if large.isEmpty():
        return components(links)
    heads = written(large.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    found = components(links.union(verified(heads, texts, similarity)))
    more = verified(written(open_pairs(large, found, texts, similarity), "pairs"), texts, similarity)
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per line of docs: doc_id, line_no, line_id, component, kept.

    Lines are what newlines separate (null text: one empty line). line_id is a hash of the trimmed line, told apart
    where different lines share it. Lines whose shingle sets are similar are linked, and the linked lines are a
    component, named by its smallest line_id. Of a component the line with the smallest (doc_id, line_no) is kept,
    null ids last; rows that repeat an id and a line number share that decision. Lines of less than five characters
    match exactly or not at all. Empty lines are always kept. An empty table gives no rows. Lines of any length are
    signed and compared whole; only the id and the text are read, so other columns may have any name.
    """
    every = occurrences(docs, id_col, text_col)
    lines = written(signatures(every.where("line <> ''").select("line").distinct()), "lines")
    other = collisions(lines.select("id", "line"))
    known = identified(lines.drop("id"), other)
    found = linked(buckets(known.select("id", F.length("line").alias("size"), F.explode("keys").alias("key"))), known, similarity)
    stars = found.select(F.col("node").alias("line_id"), "component")
    rows = written(identified(every, other).select("doc_id", "line_no", F.col("id").alias("line_id"), (F.col("line") == "").alias("empty")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("line_no").alias("l"))
    by_line = rows.where("NOT empty").groupBy("line_id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    placed = written(by_line.join(stars, "line_id", "left").withColumn("component", F.coalesce("component", "line_id")), "placed")
    best = written(placed.groupBy("component").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("members")), "best")
    named = written(hot_join(placed.select("line_id", "n", "component"), best, "component", "members"), "named")
    full = hot_join(rows.where("NOT empty"), named, "line_id", "n")
    kept = F.col("doc_id").eqNullSafe(F.col("best.d")) & (F.col("line_no") == F.col("best.l"))
    none = rows.where("empty").select("doc_id", "line_no", "line_id", F.col("line_id").alias("component"), F.lit(True).alias("kept"))
    return full.select("doc_id", "line_no", "line_id", "component", kept.alias("kept")).unionByName(none)


def deduped_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: the kept lines of each document in order; for ids that are unique."""
    kept = fuzzy_lines(docs, id_col, text_col).where("kept").select("doc_id", "line_no")
    lines = occurrences(docs, id_col, text_col).join(kept, ["doc_id", "line_no"])
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))
