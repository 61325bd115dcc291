"""Fill-in-middle, SentencePiece and periodic runs against brute-force versions."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from tracefold.llm import middle, periodic, sentence_pieces

DDL = "doc_id long, text string, form string, words string, row long, ids string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(11)
    words = ["alpha", "beta", "Gamma", "délta", "😀", "ж", "zeta", "é", "<P", "▁x"]
    out = [None, "", " \t\n", "a", "é", "holds <S> inside", "x" * 30_000, "same", "same", "  two  blanks ", "tab\tline\n\n\x0b\x0cend\x1c\x85\xa0z", "end<"]
    out += [" ".join(r.choice(words) for _ in range(r.randrange(1, 90))) for _ in range(80)]
    for _ in range(60):
        unit = [r.choice(words) for _ in range(r.randrange(1, 25))]
        out.append(" ".join([r.choice(words)] * r.randrange(3) + unit * r.randrange(1, 9) + unit[: r.randrange(len(unit) + 1)] + [r.choice(words) for _ in range(r.randrange(9))]))
    return [*out, " ".join(["a b"] * 4000 + words)]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "z", "z", 7, "z") for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([*rows, rows[-1], (None, "no id here", "z", "z", 7, "z")], DDL)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut(doc_id, text):
    """(n, form, prefix, middle, output) by slicing."""
    d = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_fill_in_middle(docs, rows, nothing):
    got = middle.restored(middle.fill_in_middle(docs)).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = (rows[r.doc_id][1] if r.doc_id is not None else "no id here") or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut(r.doc_id, text)
        assert r.text == text
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.restored(middle.fill_in_middle(nothing)).collect() == []


def test_fill_in_middle_equals_sql(spark, rows):
    import pandas as pd

    from tracefold.llm import queries

    documents = pd.DataFrame([(i, t) for i, t, *_ in rows if t != texts()[-1]], columns=["doc_id", "text"])  # noqa: F841
    documents["text"] = documents["text"].astype(object)
    want = {tuple(x) for x in duckdb.sql(middle.ORACLE).fetchall()}
    from pyspark.sql import functions as F

    found = middle.restored(middle.fill_in_middle(spark.createDataFrame([x for x in rows if x[1] != texts()[-1]], DDL)))
    got = {tuple(r) for r in found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2("text", 256)).collect()}
    assert got == want and "op11_fill_in_middle" in queries.ORACLES


@pytest.mark.parametrize("block", [4, 7, 64])
def test_pieces_don_t_depend_on_blocks(block):
    r = random.Random(3)
    some = ["".join(r.choice("aé😀ж\n") for _ in range(r.randrange(40))) for _ in range(200)]
    array = pa.array(["before", *some, "behind"]).slice(1, len(some))
    low = np.array([r.randrange(len(t) + 1) for t in some])
    high = np.array([r.randrange(a, len(t) + 1) for a, t in zip(low, some)])
    parts = middle.pieces(array, low, high, block)
    assert [p.to_pylist() for p in parts] == [[t[:a] for t, a in zip(some, low)], [t[a:b] for t, a, b in zip(some, low, high)], [t[b:] for t, b in zip(some, high)]]
    assert [len(p) for p in middle.pieces(pa.array([], pa.string()), low[:0], low[:0], block)] == [0, 0, 0]


def test_sentence_pieces(docs, rows, nothing):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = sentence_pieces.encoded(docs, MODEL)
    got = found.collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = (rows[r.doc_id][1] if r.doc_id is not None else "no id here") or ""
        assert r.ids == lib.encode(text, add_eos=True) and r.decoded == lib.decode(r.ids)
        raw = text.encode()
        assert r.offsets[0] == 0 and r.offsets[-1] == len(raw) and len(r.offsets) == len(r.ids) + 1
        for i, a, b in zip(r.ids[:-1], r.offsets, r.offsets[1:]):
            piece = lib.id_to_piece(i)
            assert raw[a:b] == bytes([int(piece[3:5], 16)]) if lib.is_byte(i) else raw[a:b].decode().replace(" ", "▁").lstrip("▁") == piece.lstrip("▁")
    for r in sentence_pieces.digests(found).collect():
        ids = lib.encode((rows[r.doc_id][1] if r.doc_id is not None else "no id here") or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
    assert sentence_pieces.encoded(nothing, MODEL).collect() == []


def test_words_that_aren_t_remembered_are_encoded_alike():
    with open(MODEL, "rb") as f:
        codec = sentence_pieces.Codec(f.read(), most_held=3)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(4)
    some = ["".join(r.choice("ab ▁é😀 \n\t<s>01　") for _ in range(r.randrange(14))) for _ in range(2000)]
    assert [ids.tolist() for ids, _ in codec.encode(some)] == [lib.encode(t, add_eos=True) for t in some]
    assert len(codec.held) <= 3


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normalisation_through_a_compiled_map(rule, squeeze):
    """The library's own maps: same text, and offsets that point at what was replaced."""
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = sentence_pieces.sentencepiece_model_pb2.ModelProto.FromString(made.serialized_model_proto()).normalizer_spec
    spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = True, squeeze, True
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    mine, r = sentence_pieces.Normalizer(spec), random.Random(6)
    some = ["".join(r.choice("aB  é́Åﬁ㌀½ﾊﾞ 　​\t\n\x01①가😀¨ﷺ") for _ in range(r.randrange(10))) for _ in range(1500)]
    for t in some:
        plain, origin = mine(t)
        want, at = library.normalize(t, with_offsets=True)
        assert plain == want
        if plain and squeeze:
            assert len(origin) == len(plain.encode()) + 1 and (np.diff(origin) >= 0).all()
            ours = [len(t.encode()[:o].decode(errors="ignore")) for o in origin[np.append(0, np.cumsum([len(c.encode()) for c in plain]))]]
            assert ours[1:] == list(at)[1:]  # the added blank comes before what is dropped there, or behind it


def runs_of(words):
    """(start, period, length) by trying every period."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, q, length) for (s, length), q in out.items())


def test_tiles_and_fragments_equal_every_period():
    r = random.Random(2)
    for _ in range(600):
        codes = []
        while len(codes) < r.randrange(1, 400):
            unit = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, 60))]
            codes += r.choice([[r.randrange(1000) for _ in range(r.randrange(30))], (unit * 10)[: r.randrange(1, len(unit) * 9)], [r.randrange(2) for _ in range(40)]])
        stretches = {}
        for least, most, at, bounds, part in periodic.tiles(np.array(codes, np.int32)):
            for q, a, b in periodic.solve(least, most, bounds.tolist(), part.tolist()):
                stretches.setdefault(q, []).append((at + a, at + b))
        got = {}
        for q, parts in sorted(stretches.items()):
            whole = []
            for a, b in sorted(parts):
                if whole and a <= whole[-1][1]:
                    whole[-1][1] = max(b, whole[-1][1])
                else:
                    whole.append([a, b])
            for a, b in whole:
                if b - a + q >= max(24, 3 * q):
                    got.setdefault((a, b - a + q), q)
        assert sorted((s, q, n) for (s, n), q in got.items()) == runs_of(codes)


def test_periodic_runs(docs, rows, nothing):
    found = periodic.periodic_runs(docs, with_text=True).collect()
    assert len(found) == len(rows) + 2 and sum(r.n_runs > 0 for r in found) > 20
    for r in found:
        text = (rows[r.doc_id][1] if r.doc_id is not None else "no id here") or ""
        words = [w.decode() for w in text.encode().split()]
        want = runs_of(words) if len(words) < 3000 else [(0, 2, 8000)]
        assert [(x.start, x.period, x.length) for x in r.runs] == want and (r.n_words, r.n_runs) == (len(words), len(want))
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, q, n in want))
        gone = {i for s, q, n in want for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone) and r.collapsed_sha256 == sha(r.collapsed)
        best = max(want, key=lambda x: (Fraction(x[2], x[1]), -x[0], -x[1]), default=None)
        assert (r.start, r.period, r.length) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[2] // best[1] if best else None)
    assert periodic.periodic_runs(nothing).collect() == []


def test_looped(docs, rows):
    got = periodic.looped(docs).collect()
    assert len(got) == len(rows) + 2
    changed = 0
    for r in got:
        text = (rows[r.doc_id][1] if r.doc_id is not None else "no id here") or ""
        h = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode())
        words, g = [w.decode() for w in text.encode().split()], h // 10
        if h % 10 or not words:
            assert r.text == text
            continue
        n, changed = len(words), changed + 1
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r.text == " ".join([w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)])
    assert changed > 5


def test_one_repeated_word_stays_linear():
    n = 60_000
    out = [x for least, most, at, b, part in periodic.tiles(np.full(n, 5, np.int32)) for x in periodic.solve(least, most, b.tolist(), part.tolist())]
    assert len(out) < 8 * n
