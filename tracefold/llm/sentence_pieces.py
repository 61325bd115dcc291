"""SentencePiece encoding that keeps each piece's span of the original bytes, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import small_batches, text_or_empty

SPACE = "▁"  # fixed value: how models write a blank
#: Words of at most so many characters whose pieces a worker remembers, and how many.
LONGEST_HELD, MOST_HELD = 40, 500_000


class CharacterMap:
    """The compiled map of a model's normalizer: a double array of UTF-8 prefixes, and their replacements end to end."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units: list[int] = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]
        root = self._children(0)
        self.first = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in range(1, 256) if self._step(root, c)) + b"]")

    def _children(self, at: int) -> int:
        unit = self.units[at]
        return at ^ (unit >> 10 << ((unit & 512) >> 6))

    def _step(self, base: int, byte: int) -> int:
        """The node that byte leads to from the node whose children begin at base; 0 if none."""
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else 0

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """The length of the longest mapped prefix of raw[at:] and what stands for it; (0, b"") if there is none."""
        base, found, value = self._children(0), 0, 0
        for end in range(at, len(raw)):
            node = self._step(base, raw[end])
            if not node:
                break
            base = self._children(node)
            if self.units[node] >> 8 & 1:
                found, value = end + 1 - at, self.units[base] & 0x7FFFFFFF
        return (found, self.texts[value : self.texts.index(0, value)]) if found else (0, b"")


class Normalizer:
    """A model's normalisation, with the original byte at which each normalised byte stands."""

    def __init__(self, spec: sentencepiece_model_pb2.NormalizerSpec, suffix: bool = False) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix

    def _mapped(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the longest-prefix replacements, their origins, and where a unit of the replacement begins."""
        if self.map is None:
            new = np.frombuffer(raw, np.uint8)
            return new, np.arange(len(raw)), np.ones(len(raw), bool)
        out, runs, at, since = [], [], 0, 0  # runs: origin, bytes, whether they are copied
        while m := self.map.first.search(raw, at):
            at = m.start()
            length, put = self.map.longest(raw, at)
            if not length:  # to the next code point
                at += 1
                while at < len(raw) and raw[at] & 0xC0 == 0x80:
                    at += 1
                continue
            if at > since:
                out.append(raw[since:at])
                runs.append((since, at - since, 1))
            out.append(put)
            runs.append((at, len(put), 0))
            at = since = at + length
        out.append(raw[since:])
        runs.append((since, len(raw) - since, 1))
        start, size, copied = np.array(runs, np.int64).T
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        each = np.repeat(copied, size)
        return np.frombuffer(b"".join(out), np.uint8), np.repeat(start, size) + inside * each, (each == 1) | (inside == 0)

    def __call__(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and the original byte offset of each of its UTF-8 bytes and of its end.

        No offsets (None) where they need no list: bytes stand for themselves, but for a blank before the text and
        blanks written as SPACE."""
        raw = text.encode()
        if self.map is None and not self.squeeze and self.dummy and self.escape and not self.suffix and raw and SPACE not in text:
            return SPACE + text.replace(" ", SPACE), None
        new, origin, begins = self._mapped(raw)
        end = len(raw)
        if self.squeeze:
            blank = new == 32
            keep = ~(blank & np.append(True, blank[:-1])) if len(new) else blank
            inner = blank & ~begins  # a blank inside one replacement stays, unless all before it in the replacement is dropped
            for i in np.flatnonzero(inner & ~keep):
                keep[i] = keep[i - 1] or not blank[i - 1]
            new, origin = new[keep], origin[keep]
            while len(new) and new[-1] == 32:
                new, origin, end = new[:-1], origin[:-1], int(origin[-1])
        if not len(new) and (self.squeeze or not raw):
            return "", np.array([end])
        if self.dummy:
            new = np.append(new, np.uint8(32)) if self.suffix else np.append(np.uint8(32), new)
            origin = np.append(origin, end) if self.suffix else np.append(origin[:1] if len(origin) else end, origin)
        if self.escape:
            origin = np.repeat(origin, np.where(new == 32, len(SPACE.encode()), 1))
        out = new.tobytes().decode()
        return out.replace(" ", SPACE) if self.escape else out, np.append(origin, end)


class Codec:
    """Pieces with spans. Words are encoded once and remembered where no piece of the vocabulary reaches from one into the next."""

    def __init__(self, model: bytes, most_held: int = MOST_HELD) -> None:
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        self.normalize = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())  # takes normalised text as it is
        self.unknown, self.end = self.bare.unk_id(), self.bare.eos_id()
        self.sizes = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int32)
        self.own = self.sizes - np.array([(len(SPACE.encode()) - 1) * p.piece.count(SPACE) for p in proto.pieces], np.int32)  # bytes of the original
        apart = all(SPACE not in p.piece.lstrip(SPACE) for p in proto.pieces)
        self.apart = apart and proto.trainer_spec.model_type == proto.trainer_spec.BPE and self.normalize.escape and not self.normalize.suffix
        self.most_held, self.held = most_held, {}

    def _words(self, plain: str) -> list[str] | None:
        """The words of a normalised text that all follow a single SPACE; None if some don't."""
        if self.apart and plain.startswith(SPACE):
            words = plain[1:].split(SPACE)
            if "" not in words:
                return words
        return None

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids, as bytes, of words after a SPACE: all are encoded as one text and cut apart where the words end."""
        ids = np.array(self.bare.encode(SPACE + SPACE.join(words)), np.int32)
        ends = np.cumsum([len(w.encode()) + len(SPACE.encode()) for w in words])
        cut = (4 * np.append(0, np.searchsorted(np.cumsum(self._sizes(ids, SPACE + SPACE.join(words))), ends) + 1)).tolist()
        raw = ids.tobytes()
        return {w: raw[a:b] for w, a, b in zip(words, cut, cut[1:])}

    def _sizes(self, ids: np.ndarray, plain: str) -> np.ndarray:
        sizes = self.sizes[ids]
        if (ids == self.unknown).any():
            sizes[ids == self.unknown] = [len(p.encode()) for i, p in zip(ids, self.bare.encode(plain, out_type=str)) if i == self.unknown]
        return sizes

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids with the end id, and one offset more: piece i stands for the original bytes from offset i to offset i + 1.

        A byte piece stands for its byte; what normalisation adds stands for no bytes, and what it drops goes to the piece before."""
        normal = [self.normalize(t) for t in texts]
        split = [self._words(plain) for plain, _ in normal]
        held = self.held
        fresh = list({w for words in split if words for w in words if w not in held})
        extra = self._learn(fresh) if fresh else {}
        room = self.most_held - len(held)
        if room > 0:
            held.update((w, extra[w]) for w in fresh[:room] if len(w) <= LONGEST_HELD)
        out = []
        for text, (plain, origin), words in zip(texts, normal, split):
            if words is None:
                ids = np.array(self.bare.encode(plain), np.int32)
            else:
                known = list(map(held.get, words))
                if None in known:
                    known = [k if k is not None else extra[w] for k, w in zip(known, words)]
                ids = np.frombuffer(b"".join(known), np.int32)
            if origin is not None:
                at = origin[np.append(0, np.cumsum(self._sizes(ids, plain)))]
            elif (ids == self.unknown).any():  # what an unknown piece holds shows in its text
                own = [len(p.encode()) - 2 * p.count(SPACE) if i == self.unknown else self.own[i] for i, p in zip(ids, self.bare.encode(plain, out_type=str))]
                at = np.maximum(np.append(0, np.cumsum(own)) - 1, 0)
            else:
                at = np.cumsum(np.append(np.int32(-1), self.own[ids]))
                at[0] = 0  # the blank before the text
            out.append((np.append(ids, np.int32(self.end)), np.append(at, len(text.encode()))))
        return out


def codec_in_task(model: bytes, _held: dict[int, Codec] = {}) -> Codec:  # noqa: B006
    """One codec for each Python worker and model."""
    key = hash(model)
    if key not in _held:
        _held.clear()
        _held[key] = Codec(model)
    return _held[key]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]), pa.int32()))


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (with an end id), offsets, decoded.

    Piece i of ids stands for the bytes of the original UTF-8 text from offsets[i] to offsets[i + 1]. Null texts are
    empty and have the end id alone. Rows stand alone: repeated rows, null ids and ties pass through, and other columns
    are not read. A very long text takes memory in proportion to itself. The model (a fixed file) is read by the driver
    and broadcast. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark, size="4m")
    with open(model_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_in_task(content.value)
        for b in batches:
            both = codec.encode(b.column(1).to_pylist())
            back = [codec.processor.decode(ids.tolist()) for ids, _ in both]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([x for x, _ in both]), _lists([x for _, x in both]), pa.array(back, pa.string())], ["doc_id", "ids", "offsets", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<int>, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and a hash of the offsets, of encoded()'s rows."""
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.xxhash64("offsets").alias("offsets_hash"))
