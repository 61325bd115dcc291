"""Byte-level BPE as a monoid: halves are encoded apart and joined where their boundary provably settles."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Characters that one leaf encodes at once, and the first width of a boundary window on either side.
LEAF, WINDOW = 512, 32
#: A blank after another character: the pattern's matches hold no white space after their first character unless they are
#: all white space, so a match starts here in whatever text surrounds it.
_CUT = re.compile(r"(?<=\S)[ \n\t\r]")


def ranks_of(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class Codec:
    """Encoding and decoding with given merge ranks and split pattern, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW) -> None:
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.leaf, self.window = leaf, window
        self.joins = 0

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.encoding.encode_ordinary(text[a:b])
        mid = (a + b) // 2
        return self._join(text, a, mid, b, self._tree(text, a, mid), self._tree(text, mid, b))

    def _join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[a:b] from those of its halves: only a window around mid is encoded again.

        The window grows on both sides until it starts and ends at a cut, which is a boundary of matches in the half and
        in the whole alike: so the ids before it in the left half, and after it in the right half, stand.
        """
        self.joins += 1
        low, high = self._before(text, a, mid), self._after(text, mid, b)
        again = self.encoding.encode_ordinary
        tail, head = len(again(text[low:mid])), len(again(text[mid:high]))
        return left[: len(left) - tail] + again(text[low:high]) + right[head:]

    def _before(self, text: str, a: int, mid: int) -> int:
        """The last cut of text before mid, or a."""
        width = self.window
        while True:
            start = max(a, mid - width)
            found = -1
            for m in _CUT.finditer(text, start, mid):
                found = m.start()
            if found > a:
                return found
            if start == a:
                return a
            width *= 2

    def _after(self, text: str, mid: int, b: int) -> int:
        """The first cut of text after mid, or b."""
        width = self.window
        while True:
            end = min(b, mid + width)
            m = _CUT.search(text, mid + 1, end)
            if m:
                return m.start()
            if end == b:
                return b
            width *= 2

    def decode(self, ids: list[int]) -> bytes:
        """Bytes concatenate up the tree: the bytes of a list are those of its halves."""
        if len(ids) <= self.leaf:
            pieces = self.pieces
            return b"".join([pieces[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def codec_in_task(content: bytes, pattern: str, _held: dict[int, Codec] = {}) -> Codec:  # noqa: B006
    """One codec for each Python worker and vocabulary."""
    key = hash((content, pattern))
    if key not in _held:
        _held.clear()
        _held[key] = Codec(ranks_of(content), pattern)
    return _held[key]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Null texts are empty; an empty text has no ids. Very long texts take memory in proportion to themselves alone.
    Rows stand alone: ties, repeated rows and null ids pass through, and other columns are not read. The vocabulary
    (a fixed file) is read by the driver and broadcast.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_in_task(content.value, pattern)
        for b in batches:
            n, ids_sha, back_sha, all_ids = [], [], [], []
            for text in b.column(1):
                ids = codec.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                back_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids, np.int32))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate([*all_ids, np.zeros(0, np.int32)]))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
