"""Media columns: FLAC streams of 8-bit mono samples, written and read for many frames at a time.

The format is that of RFC 9639. Frames are lanes of numpy arrays: one step decodes the next residual of every frame
of a batch, so the serial Rice codes of a frame cost no Python loop for each sample.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLOCK = 192
#: Every so many frames the stream has a seek point.
SEEK_FRAMES = 64
#: Frames that are encoded or decoded at once, so that memory doesn't follow the length of a text.
RUN = 4096
RATE = 8000
# Fixed values of the format: polynomials of the header's and the frame's checksums, the first bytes of our frames
# (sync and fixed block size; 192 samples at 8 kHz; mono of 8 bits).
CRC8, CRC16 = 0x07, 0x8005
FRAME = (0xFF, 0xF8, 0x14, 0x02)
MOST_FIXED = 2


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, out = 1 << (bits - 1), []
    for byte in range(256):
        x = byte << (bits - 8)
        for _ in range(8):
            x = (x << 1 ^ poly) if x & top else x << 1
        out.append(x & (1 << bits) - 1)
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


T8, T16 = _crc_table(CRC8, 8), _crc_table(CRC16, 16)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """The checksum of each data[start:start + length], all lanes a byte at a time; lanes are sorted by length inside."""
    table = T8 if bits == 8 else T16
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    crc = np.zeros(len(start), table.dtype)
    for i in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -i, side="left"))
        byte = data[start[:n] + i]
        crc[:n] = table[crc[:n] ^ byte] if bits == 8 else (crc[:n] << 8) ^ table[(crc[:n] >> 8).astype(np.uint8) ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's variable-length code: bytes [lane, 6] and their count."""
    out, size = np.zeros((len(number), 6), np.uint8), np.ones(len(number), np.int64)
    for n, most in enumerate((1 << 11, 1 << 16, 1 << 21, 1 << 26), start=2):
        size[number >= (1 << 7 if n == 2 else 1 << (5 * n - 4))] = n
    size[number >= 1 << 26] = 6
    for n in range(1, 7):
        at = np.flatnonzero(size == n)
        x = number[at]
        if n == 1:
            out[at, 0] = x
            continue
        out[at, 0] = (0xFF << (8 - n) & 0xFF) | (x >> (6 * (n - 1)))
        for j in range(1, n):
            out[at, j] = 0x80 | (x >> (6 * (n - 1 - j)) & 0x3F)
    return out, size


def encode_runs(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """encode_frames() of RUN frames after RUN frames."""
    got = [encode_frames(samples[i : i + RUN], number[i : i + RUN]) for i in range(0, len(samples), RUN)]
    return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])


def encode_frames(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of BLOCK signed 8-bit samples each [lane, BLOCK]: the bytes of all, one after the other, and their lengths.

    Each frame takes the smallest of: constant, fixed predictors of orders 0 to MOST_FIXED with one Rice partition, verbatim.
    """
    lanes = len(samples)
    s = samples.astype(np.int32)
    kind = np.full(lanes, -1, np.int64)  # -1 verbatim, -2 constant, else the predictor's order
    best = np.full(lanes, 8 * BLOCK, np.int64)
    rice = np.zeros(lanes, np.int64)
    folded, residual = [], s
    for order in range(MOST_FIXED + 1):
        if order:
            residual = np.diff(residual, axis=1)
        z = (residual << 1) ^ (residual >> 31)
        folded.append(z)
        guess = np.clip(np.log2(z.mean(1) + 1e-9).astype(np.int64), 0, 12)
        for k in (guess, guess + 1):
            bits = (z >> k[:, None].astype(np.int32)).sum(1, dtype=np.int64) + (k + 1) * (BLOCK - order) + 8 * order + 10
            better = bits < best
            kind[better], best[better], rice[better] = order, bits[better], k[better]
    same = (s == s[:, :1]).all(1)
    kind[same], best[same] = -2, 8
    coded, width = _coded(number)
    body = -(-best // 8)
    length = 4 + width + 1 + 1 + body + 2
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    for j, byte in enumerate(FRAME):
        out[start + j] = byte
    for j in range(6):
        at = np.flatnonzero(width > j)
        out[start[at] + 4 + j] = coded[at, j]
    at_sub = start + 4 + width + 1
    out[at_sub - 1] = _crc(out, start, 4 + width, 8)
    plain, flat = np.flatnonzero(kind == -1), np.flatnonzero(kind == -2)
    out[at_sub[plain]] = 1 << 1
    out[at_sub[plain][:, None] + 1 + np.arange(BLOCK)] = samples[plain].view(np.uint8)
    out[at_sub[flat] + 1] = samples[flat, 0].view(np.uint8)
    for order in range(MOST_FIXED + 1):
        at = np.flatnonzero(kind == order)
        if not len(at):
            continue
        out[at_sub[at]] = (8 | order) << 1
        for j in range(order):
            out[at_sub[at] + 1 + j] = samples[at, j].view(np.uint8)
        z, k = folded[order][at].astype(np.int64), rice[at]
        q = z >> k[:, None]
        size = q + 1 + k[:, None]
        room = body[at] - order  # bytes that the coded residuals take
        first = (np.cumsum(room) - room) * 8
        bits = np.zeros(int(room.sum()) * 8, np.uint8)
        for j in range(4):  # method 0 and partition order 0 are six zero bits
            bits[first + 6 + j] = k >> (3 - j) & 1
        ends = first[:, None] + 10 + np.cumsum(size, axis=1)
        value = (1 << k[:, None]) | (z & ((1 << k[:, None]) - 1))
        for j in range(int(k.max()) + 1):
            on = np.flatnonzero(k >= j)
            bits[ends[on] - 1 - j] = value[on] >> j & 1
        packed = np.packbits(bits)
        source = np.cumsum(room) - room
        out[np.repeat(at_sub[at] + 1 + order - source, room) + np.arange(len(packed))] = packed
    crc = _crc(out, start, length - 2, 16)
    out[start + length - 2], out[start + length - 1] = crc >> 8, crc & 0xFF
    return out, length


def stream(pcm: bytes, frames: bytes, lengths: np.ndarray) -> bytes:
    """Marker, stream information, a seek point for every SEEK_FRAMES frames, and the frames. pcm: signed samples."""
    n = len(pcm)
    info = BLOCK.to_bytes(2, "big") * 2 + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    offset = np.cumsum(lengths) - lengths
    points = b"".join(int(i * BLOCK).to_bytes(8, "big") + int(offset[i]).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for i in range(0, len(lengths), SEEK_FRAMES))
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + frames


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """One stream for each payload of a positive multiple of BLOCK bytes; a byte less 128 is a sample."""
    if not payloads:
        return []
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    counts = [len(p) // BLOCK for p in payloads]
    data, length = encode_runs(samples, np.concatenate([np.arange(n) for n in counts]))
    ends = np.concatenate([[0], np.cumsum(length)])
    out, at = [], 0
    for n in counts:
        out.append(stream(samples[at : at + n].tobytes(), data[ends[at] : ends[at + n]].tobytes(), length[at : at + n]))
        at += n
    return out


class Stream:
    """The metadata of one stream: where its frames start, its samples, checksum and seek points (sample, byte)."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.seek = 4, False, []
        while not last:
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.block, self.rate, self.channels, self.bits = int.from_bytes(block[:2], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1
                self.samples, self.md5 = packed & (1 << 36) - 1, block[18:34]
            elif kind == 3:
                self.seek = [(int.from_bytes(block[i : i + 8], "big"), int.from_bytes(block[i + 8 : i + 16], "big")) for i in range(0, len(block), 18)]
            at += 4 + size
        self.first = at
        if (self.block, self.channels, self.bits) != (BLOCK, 1, 8) or self.samples % BLOCK or not self.samples:
            raise ValueError("only 8-bit mono streams of whole 192-sample frames are read")


def _frame_starts(data: np.ndarray, begin: int, end: int, n: int) -> np.ndarray:
    """Starts of the n frames in data[begin:end]: header bytes, header checksum and frame numbers in order."""
    hits = []
    for a in range(begin, end, 1 << 20):  # a piece at a time, and three bytes of the next
        part = data[a : min(end, a + (1 << 20) + 3)]
        hits.append(np.flatnonzero((part[:-3] == FRAME[0]) & (part[1:-2] == FRAME[1]) & (part[2:-1] == FRAME[2]) & (part[3:] == FRAME[3])) + a)
    hit = np.concatenate(hits)
    if len(hit) > n:  # bytes inside a frame that look like a header: the number and checksum tell
        wanted, width = _coded(np.arange(n))
        kept, i = [], 0
        for h in hit.tolist():
            if i < n and data[h + 4 : h + 4 + width[i]].tobytes() == wanted[i, : width[i]].tobytes() and _crc(data, np.array([h]), np.array([4 + width[i]]), 8)[0] == data[h + 4 + width[i]]:
                kept.append(h)
                i += 1
        hit = np.array(kept)
    if len(hit) != n:
        raise ValueError("frames are missing or damaged")
    return hit


def _residuals(words: np.ndarray, at: np.ndarray, k: np.ndarray, count: int) -> np.ndarray:
    """count Rice codes of each lane from bit position at, with parameter k: [count, lane]."""
    out = np.empty((count, len(at)), np.int32)
    k64 = k.astype(np.uint64)
    at = at.copy()
    for i in range(count):
        zeros = np.zeros(len(at), np.int64)
        w = words[at >> 3] << (at & 7).astype(np.uint64)
        head = w >> np.uint64(32)
        while True:
            empty = np.flatnonzero(head == 0)
            if not len(empty):
                break
            zeros[empty] += 32
            p = at[empty] + zeros[empty]
            w[empty] = words[p >> 3] << (p & 7).astype(np.uint64)
            head[empty] = w[empty] >> np.uint64(32)
        lead = 32 - np.frexp(head.astype(np.float64))[1].astype(np.int64)
        p = at + zeros + lead + 1
        low = (words[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - k64)
        out[i] = ((zeros + lead) << k) | low.astype(np.int64)
        at = p + k
    return (out >> 1) ^ -(out & 1)


def decode_frames(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Samples [lane, BLOCK] of frames in data; a wrong checksum raises ValueError.

    Subframes may be constant, verbatim, fixed or LPC, with any Rice partition order and escape-free parameters.
    """
    if (_crc(data, start, length - 2, 16) != (data[start + length - 2].astype(np.uint16) << 8 | data[start + length - 1])).any():
        raise ValueError("a frame's checksum is wrong")
    lead = data[start + 4]
    width = np.ones(len(start), np.int64)
    for n in range(2, 7):
        width[lead >= (0xFF << (8 - n) & 0xFF)] = n
    if (_crc(data, start, 4 + width, 8) != data[start + 4 + width]).any():
        raise ValueError("a header's checksum is wrong")
    sub = start + 5 + width
    kind = data[sub] >> 1
    if ((data[sub] & 0x81) != 0).any():
        raise ValueError("wasted bits or padding in a subframe's header are not read")
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(data) + 8, np.uint64)
    for j in range(8):
        words |= padded[j : j + len(words)] << np.uint64(56 - 8 * j)
    take = lambda p, n: ((words[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(64 - n)).astype(np.int64)
    out = np.empty((len(start), BLOCK), np.int32)
    for t in np.unique(kind).tolist():
        at = np.flatnonzero(kind == t)
        p = sub[at] + 1
        if t == 0:
            out[at] = data[p].view(np.int8)[:, None]
            continue
        if t == 1:
            out[at] = data[p[:, None] + np.arange(BLOCK)].view(np.int8)
            continue
        order = t - 8 if 8 <= t <= 12 else t - 31 if t >= 32 else -1
        if order < 0:
            raise ValueError("a reserved subframe type")
        s = np.empty((BLOCK, len(at)), np.int64)
        for j in range(order):
            s[j] = data[p + j].view(np.int8)
        bit = (p + order) * 8
        if t >= 32:
            precision = take(bit, 4) + 1
            shift = take(bit + 4, 5)
            bit = bit + 9
            taps = []
            for _ in range(order):
                raw = ((words[bit >> 3] << (bit & 7).astype(np.uint64)) >> (np.uint64(64) - precision.astype(np.uint64))).astype(np.int64)
                taps.append(raw - (raw >> (precision - 1) << precision))
                bit = bit + precision
        head = take(bit, 6)
        if (head >> 4).any():
            raise ValueError("only four-bit Rice parameters are read")
        for parts in np.unique(head).tolist():
            lanes = np.flatnonzero(head == parts)
            here = bit[lanes] + 6
            done = order
            for i in range(1 << parts):
                k = take(here, 4)
                if (k == 15).any():
                    raise ValueError("escaped partitions are not read")
                count = (BLOCK >> parts) - (order if i == 0 else 0)
                rows = _residuals_at(words, here + 4, k, count)
                s[done : done + count, lanes], here = rows
                done += count
        if t < 32:
            predict = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}[order]
            for i in range(order, BLOCK if order else 0):
                for j, c in enumerate(predict):
                    s[i] += c * s[i - 1 - j]
        else:
            for i in range(order, BLOCK):
                s[i] += sum(c * s[i - 1 - j] for j, c in enumerate(taps)) >> shift
        out[at] = s.T
    return out


def _residuals_at(words: np.ndarray, at: np.ndarray, k: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """As _residuals, with the bit position after the last code."""
    rows = _residuals(words, at, k, count)
    folded = (rows.astype(np.int64) << 1) ^ (rows.astype(np.int64) >> 63)
    return rows, at + (folded >> k).sum(0) + (k + 1) * count


def decode_blocks(media: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(stream, sample, pcm): each stream's payload as blocks of SEEK_FRAMES frames with the offset of their first sample.

    Checksums of headers, frames and whole streams are verified. Blocks of many streams are decoded together, RUN frames
    at once."""
    heads = [Stream(m) for m in media]
    held: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # stream, first frame, starts and lengths of a block's frames
    size = 0
    sums = [hashlib.md5() for _ in media]

    def decoded() -> Iterator[tuple[int, int, bytes]]:
        parts, starts, at = [], [], 0
        for i, _, start, length in held:
            first = int(start[0])
            parts.append(np.frombuffer(media[i], np.uint8, int(start[-1] + length[-1]) - first, first))
            starts.append(start - first + at)
            at += len(parts[-1])
        samples = decode_frames(np.concatenate(parts), np.concatenate(starts), np.concatenate([x[3] for x in held])).astype(np.int8)
        at = 0
        for i, frame, start, _ in held:
            pcm = samples[at : at + len(start)]
            at += len(start)
            sums[i].update(pcm.tobytes())
            if frame + len(start) == heads[i].samples // BLOCK and sums[i].digest() != heads[i].md5:
                raise ValueError("the samples' checksum is wrong")
            yield i, frame * BLOCK, (pcm.view(np.uint8) ^ 0x80).tobytes()

    for i, (h, m) in enumerate(zip(heads, media)):
        start = _frame_starts(np.frombuffer(m, np.uint8), h.first, len(m), h.samples // BLOCK)
        length = np.diff(np.append(start, len(m)))
        for a in range(0, len(start), SEEK_FRAMES):
            held.append((i, a, start[a : a + SEEK_FRAMES], length[a : a + SEEK_FRAMES]))
            size += len(held[-1][2])
            if size >= RUN:
                yield from decoded()
                held, size = [], 0
    if held:
        yield from decoded()


def decode_streams(media: list[bytes]) -> list[bytes]:
    """The payload of each stream."""
    out: list[list[bytes]] = [[] for _ in media]
    for i, _, pcm in decode_blocks(media):
        out[i].append(pcm)
    return [b"".join(x) for x in out]


def seek(media: bytes, sample: int) -> bytes:
    """The payload of the block that holds a sample, reading from the nearest seek point before it."""
    head = Stream(media)
    if not 0 <= sample < head.samples:
        raise IndexError(sample)
    near = max((p for p in head.seek if p[0] <= sample), default=(0, 0))
    data = np.frombuffer(media, np.uint8)
    begin, want = head.first + near[1], sample // BLOCK
    after = [p for p in head.seek if p[0] > sample]
    end = head.first + after[0][1] if after else len(media)
    first, last = near[0] // BLOCK, after[0][0] // BLOCK if after else head.samples // BLOCK
    part = data[begin:end]
    hit = np.flatnonzero((part[:-3] == FRAME[0]) & (part[1:-2] == FRAME[1]) & (part[2:-1] == FRAME[2]) & (part[3:] == FRAME[3])) + begin
    if len(hit) != last - first:
        return decode_streams([media])[0][want * BLOCK : (want + 1) * BLOCK]
    start = hit[want - first]
    stop = hit[want - first + 1] if want - first + 1 < len(hit) else end
    got = decode_frames(data, np.array([start]), np.array([stop - start])).astype(np.int8)
    return (got.view(np.uint8) ^ 0x80).tobytes()


def padded(text: str | None) -> bytes:
    """A text as payload: UTF-8, with blanks up to a positive multiple of BLOCK bytes."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % BLOCK or (0 if raw else BLOCK))


class Digest:
    """Checksums and features of a payload that comes in blocks."""

    def __init__(self) -> None:
        self.sha, self.tail, self.bytes, self.peak, self.energy, self.flips, self.last = hashlib.sha256(), b"", 0, 0, 0, 0, None

    def add(self, pcm: bytes) -> None:
        self.sha.update(pcm)
        self.tail = (self.tail + pcm)[-16:]
        self.bytes += len(pcm)
        s = (np.frombuffer(pcm, np.uint8) ^ 0x80).view(np.int8).astype(np.int32)
        up = s >= 0
        self.flips += int((up[1:] != up[:-1]).sum()) + (self.last is not None and bool(up[0]) != self.last)
        self.peak, self.energy, self.last = max(self.peak, int(np.abs(s).max())), self.energy + int((s * s).sum(dtype=np.int64)), bool(up[-1])

    def feature(self) -> str:
        return f"blocks={self.bytes // BLOCK};peak={self.peak};energy={self.energy};flips={self.flips}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        media = encode_streams([padded(t) for t in texts])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as a FLAC stream. Null texts are empty; an empty text is one block of blanks."""
    small_batches(docs.sparkSession, 1000, "8m")
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_store, f"doc_id {kind}, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = b.column(2).to_pylist()
        got = [Digest() for _ in media]
        for i, _, pcm in decode_blocks(media):
            got[i].add(pcm)
        longs = lambda x: pa.array(x, pa.int64())
        strings = lambda x: pa.array(x, pa.string())
        columns = [longs([d.bytes for d in got]), strings([d.sha.hexdigest() for d in got]), longs([zlib.crc32(d.tail) for d in got]), longs([len(m) for m in media])]
        columns += [strings([hashlib.sha256(m).hexdigest() for m in media]), strings([d.feature() for d in got])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def features(stored: DataFrame) -> DataFrame:
    """Digests and features of what store() gave, from the decoded PCM blocks. Rows stand alone; a damaged stream fails the job.

    A very long text takes a few times its size: its frames are encoded and decoded RUN at once."""
    small_batches(stored.sparkSession, 1000, "8m")
    kind = dict(stored.dtypes)["doc_id"]
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, sample, pcm in decode_blocks(b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([sample], pa.int64()), pa.array([pcm], pa.binary())], ["doc_id", "sample", "pcm"])


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """doc_id, sample, pcm: decoded blocks of SEEK_FRAMES frames with the offset of their first sample, to seek by."""
    small_batches(stored.sparkSession, 1000, "8m")
    kind = dict(stored.dtypes)["doc_id"]
    return stored.select("doc_id", "media").mapInArrow(_blocks, f"doc_id {kind}, sample long, pcm binary")
