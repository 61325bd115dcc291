"""Secret scans: fixed patterns, and the novelty of strings under a primed zstandard dictionary."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make what follows sensitive, how far they reach, and what a candidate looks like.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "credential", "private_key", "access_key", "bearer", "authorization")
REACH = 48
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: Surrounding characters that prime the compressor on each side, and the marginal bytes for each character that count as new.
AROUND = 256
NOVEL = 0.6
#: The dictionary holds the corpus's most frequent identifiers, up to so many; they are words of letters joined by these signs.
MOST_IDENTIFIERS, LONGEST = 400, 64
#: Possessive and bound to a word's beginning, so that a scan reads each letter at most twice.
IDENTIFIER = re.compile(r"(?<![A-Za-z])[A-Za-z]++(?:[_.-][A-Za-z]++)++")
#: Further identifiers and values that code holds near such words without their being secrets.
IDENTIFIERS = (
    "access_token_expires_in refresh_token_url client_credentials authorization_code bearer_token_auth token_endpoint_auth_method "
    "password_reset_required password_hash_algorithm secret_key_base secret_manager_client private_key_path public_key_fingerprint "
    "api_key_header_name api_key_placeholder your-api-key-here your_access_token_here changeme_password_example config.settings.production "
    "os.environ.get process.env.SECRET application.properties credentials.json service_account.json session_cookie_name csrf_token_middleware "
    "0123456789abcdef 1234567890 ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz example.com localhost https://www. /usr/local/share/"
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in code points, sorted."""
    out = []
    lower = text.lower()  # holds each ASCII word that text holds in either case
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Novelty:
    """Marginal compressed bytes of a string after its surroundings, with the identifiers as dictionary."""

    def __init__(self, identifiers: bytes = IDENTIFIERS) -> None:
        held = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=held, write_content_size=False, write_checksum=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode()
        size = lambda x: len(self.compressor.compress(x))
        return (size(around + b"\n" + text[start:end].encode()) - size(around)) / (end - start)

    def spans(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        lower = text.lower()
        if len(lower) != len(text):  # some characters lower to two: only the ASCII letters matter here
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        hits = sorted(m for w in SENSITIVE for m in _starts(lower, w))
        starts = [s for s, _, _ in known]
        reached = list(accumulate((e for _, _, e in known), max))  # the furthest end of the spans up to each
        out, done = [], 0
        m = CANDIDATE.search(text)
        for a, b in hits:
            while m:
                if m.start() < max(b, done):  # else it is still the next one
                    m = CANDIDATE.search(text, max(b, done))
                if not m or m.start() - b > REACH:
                    break
                done = m.end()
                got = m[0].strip(".=-_/")
                at = m.start() + len(m[0]) - len(m[0].lstrip(".=-_/"))
                before = bisect_right(starts, at)
                if not (any(c.isdigit() for c in got) and any(c.isalpha() for c in got)) or (before and at + len(got) <= reached[before - 1]):
                    continue
                if self(text, m.start(), m.end()) >= NOVEL:
                    out.append((m.start(), 3, m.end()))
        return out


def _starts(text: str, word: str) -> Iterator[tuple[int, int]]:
    at = text.find(word)
    while at >= 0:
        yield at, at + len(word)
        at = text.find(word, at + 1)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each batch hold an identifier."""
    for b in batches:
        held: Counter[str] = Counter()
        for x in b.column(0):
            held.update({w for w in IDENTIFIER.findall(x.as_py()) if len(w) <= LONGEST})
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """IDENTIFIERS and the most frequent identifiers of all texts, the most frequent last, where the compressor finds them cheapest.

    An identifier holds no digit, so a secret that is copied often doesn't become one. Batches send sums, not words."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    often = texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    top = often.orderBy(F.desc("n"), "word").limit(MOST_IDENTIFIERS).collect()
    return b" ".join([IDENTIFIERS, *[r.word.encode() for r in reversed(top)]])


def _scan(batches: Iterator[pa.RecordBatch], identifiers: bytes) -> Iterator[pa.RecordBatch]:
    novelty = Novelty(identifiers)
    for b in batches:
        out: list[list] = [[] for _ in range(6)]
        for x in b.column(1):
            text = x.as_py() or ""
            base = base_spans(text)
            more = novelty.spans(text, base)
            kinds = [k for _, k, _ in base]
            row = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_said(base).encode()).hexdigest(), _said(sorted(base + more)), len(more))
            for column, v in zip(out, row):
                column.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, t) for v, t in zip(out, types)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    spans holds kind:start:end in code points, end exclusive, by start and kind. A string of 16 or more characters
    with letters and digits that follows a sensitive word within REACH characters is measured by the bytes that it
    adds to its compressed surroundings; it is reported as novel from NOVEL bytes a character, unless a base span
    covers it already. Null and empty texts have no spans. Rows stand alone: repeated rows, null ids and other columns
    change nothing; whole texts are read, and candidates of any length are reported whole. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = dictionary(docs, text_col)
    return rows.mapInArrow(lambda batches: _scan(batches, known), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
