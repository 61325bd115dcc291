"""Fill-in-the-middle: texts are cut in three and put in another order, by columns of pyarrow.compute a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

# The marks before a prefix, a suffix and a middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of a hundred documents so many are rearranged, and of a hundred rearranged ones so many have the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: UTF-8 bytes whose code points are laid out as units at once; longer texts are cut into blocks of so many.
BLOCK = 1 << 20


def draws(id_col: Column, salt: str = "1") -> list[Column]:
    """Four numbers under 2^32 from the id's decimal digits (none for a null id)."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n (code points), form, low and high: where the middle begins and ends."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("n", F.length("text").cast("long"))
    h = draws(F.col("doc_id"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("n") == 0) | marked | (h[2] % 100 >= REARRANGED), PLAIN).when(h[3] % 100 < SUFFIX_FIRST, SPM).otherwise(PSM)
    ends = [x % (F.col("n") + 1) for x in h[:2]]
    return rows.select("doc_id", "text", "n", form.alias("form"), F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))


def _offsets(texts: pa.StringArray) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]


def _strings(offsets: np.ndarray, like: pa.StringArray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), like.buffers()[2])


def code_points(texts: pa.StringArray) -> pa.ListArray:
    """Each text as the list of its code points, which share the texts' bytes."""
    offsets = _offsets(texts)
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(texts.buffers()[2], np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80) + low
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets), pa.int32()), _strings(np.append(starts, high), texts))


def _blocks(texts: pa.StringArray, most: int) -> tuple[pa.StringArray, np.ndarray]:
    """The texts cut into blocks of at most `most` bytes between code points, and each text's first block."""
    offsets = _offsets(texts)
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    cuts, first = [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        cuts.append(a)
        while b - a > most:
            a += most
            while raw[a] & 0xC0 == 0x80:
                a -= 1
            cuts.append(a)
        first.append(len(cuts))
    return _strings(np.array([*cuts, offsets[-1]]), texts), np.array(first)


def _roles(blocks: pa.StringArray, past: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix part of each block; past counts the units of its text before it."""
    lists = code_points(blocks)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    place = pc.subtract(pa.array(np.arange(len(flat))), pc.take(lists.offsets.cast(pa.int64()), parent))
    ordinal = pc.add(place, pc.take(past, parent))
    before, after = pc.less(ordinal, pc.take(low, parent)), pc.greater_equal(ordinal, pc.take(high, parent))
    out = []
    for role in (before, pc.invert(pc.or_(before, after)), pc.and_(after, pc.invert(before))):
        counts = np.bincount(parent.filter(role).to_numpy(), minlength=len(blocks))
        rebuilt = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), flat.filter(role))
        out.append(pc.binary_join(rebuilt, ""))
    return out


def pieces(texts: pa.StringArray, low: np.ndarray, high: np.ndarray, block: int = BLOCK) -> list[pa.Array]:
    """Prefixes, middles and suffixes of texts without nulls: units before low, from low, and from high.

    Units are laid out for about a block of bytes at a time, whatever a text's length."""
    blocks, first = _blocks(texts, block)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    sizes = pc.utf8_length(blocks).to_numpy().astype(np.int64)
    total = np.append(0, np.cumsum(sizes))
    past = total[:-1] - total[first[:-1]][of]
    ends = _offsets(blocks)
    parts: list[list[pa.Array]] = [[], [], []]
    a = 0
    while a < len(blocks):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + block, "right")) - 1)
        b = min(b, len(blocks))
        for held, part in zip(parts, _roles(blocks[a:b], pa.array(past[a:b]), pa.array(low[of[a:b]]), pa.array(high[of[a:b]]))):
            held.append(part)
        a = b
    whole = lambda xs: pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.concat_arrays([*xs, pa.array([], pa.string())])), "")
    return [whole(xs) for xs in parts]


def arranged(texts: pa.StringArray, form: pa.Array, low: np.ndarray, high: np.ndarray, block: int = BLOCK) -> pa.Array:
    """The texts in their forms."""
    prefix, middle, suffix = pieces(texts, low, high, block)
    join = lambda *xs: pc.binary_join_element_wise(*xs, "")
    psm = join(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    spm = join(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    return pc.if_else(pc.equal(form, PSM), psm, pc.if_else(pc.equal(form, SPM), spm, texts))


def _halves(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    parts = pc.split_pattern(texts, mark, max_splits=1)
    return pc.list_element(parts, 0), pc.list_element(parts, 1)


def recovered(outputs: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that arranged() was given. No piece holds a mark, and no mark can begin inside another, so each is found where it was put."""
    kinds = [pc.equal(form, k) for k in (PLAIN, PSM, SPM)]
    plain, psm, spm = [outputs.filter(k) for k in kinds]
    head, middle = _halves(psm, MIDDLE)
    prefix, suffix = _halves(head, SUFFIX)
    psm = pc.binary_join_element_wise(pc.binary_replace_slice(prefix, 0, len(PREFIX), ""), middle, suffix, "")
    head, middle = _halves(spm, MIDDLE)
    suffix, prefix = _halves(head, PREFIX)
    spm = pc.binary_join_element_wise(prefix, middle, pc.binary_replace_slice(suffix, 0, len(SUFFIX), ""), "")
    place = np.concatenate([np.flatnonzero(k.to_numpy(zero_copy_only=False)) for k in kinds])
    return pa.concat_arrays([plain, psm, spm]).take(pa.array(np.argsort(place)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    Form and cuts follow the id alone, so copies of a row are cut alike and a null id is a fixed one. Null texts are empty,
    and empty texts and texts that hold a mark stay plain. Whole texts are cut, whatever their length, in blocks of
    units. Repeated rows stay as they are, other columns aren't read, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [b.column(c).to_numpy() for c in ("low", "high")]
            output = arranged(b.column("text"), b.column("form"), *ends)
            plain = pc.equal(b.column("form"), PLAIN)
            none = pa.scalar(None, pa.int64())
            counts = [pc.if_else(plain, none, pa.array(x)) for x in (ends[0], ends[1] - ends[0])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), b.column("form"), *counts, output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return planned(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame) -> DataFrame:
    """rows (doc_id, n, form, prefix_chars, middle_chars, output) with text, rebuilt from output and form alone."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, recovered(b.column("output"), b.column("form"))], [*b.schema.names, "text"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", text string")


#: The same rows in DuckDB SQL, over the view documents.
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {REARRANGED} THEN '{PLAIN}' WHEN h4 % 100 < {SUFFIX_FIRST} THEN '{SPM}' ELSE '{PSM}' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, t[:a] AS pre, t[a + 1:b] AS mid, t[b + 1:] AS suf FROM (SELECT * EXCLUDE (a, b), CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM f)),
o AS (SELECT *, CASE form WHEN '{PLAIN}' THEN t WHEN '{PSM}' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> '{PLAIN}' THEN a END AS prefix_chars, CASE WHEN form <> '{PLAIN}' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
