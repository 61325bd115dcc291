"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tracefold.llm import bpe, exact_dedup, flac, fuzzy_lines, kd_shards, language, mixing, secrets, simhash, toxicity
from tracefold.llm.common import components, hot_join

DDL = "doc_id long, text string, lang string, source string, n_chars long, slot int, h long, kept string"


def texts():
    r = random.Random(5)
    words = ["alpha", "beta", "Gamma", "délta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    out = [None, "", " \t\n", "same text", "same  text", "sametext ", "x" * 30_000]
    for i in range(60):
        out.append(" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) + ("\n" + out[3] if i % 7 == 0 else ""))
    out += out[20:26]  # exact copies
    out += [x + " eps" for x in out[30:34]]  # near copies
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "é"][i % 4 if i % 5 else 0], None, 7, 9, "z") for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows + rows[-1:], DDL)  # one row repeats


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup(docs, rows, nothing):
    got = exact_dedup.exact_dedup(docs, capacity=2).collect()
    groups = {}
    for i, t, *_ in rows + rows[-1:]:
        groups.setdefault(bare(t), []).append((-len(t or ""), i))
    assert len(got) == len(rows) + 1
    for r in got:
        g = groups[bare(rows[r.doc_id][1])]
        assert (r.keep_id, r.group_size) == (min(g)[1], len(g))
        assert r.text_sha256 == hashlib.sha256(bare(rows[r.doc_id][1]).encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(nothing).collect() == []


def test_exact_dedup_equals_sql(spark, tmp_path, rows):
    import pandas as pd

    documents = pd.DataFrame(rows, columns=[c.split()[0] for c in DDL.split(", ")])  # noqa: F841
    want = {(a, b, c, d, e) for a, b, c, d, e in duckdb.sql(exact_dedup.ORACLE).fetchall()}
    assert want == {tuple(r)[:5] for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DDL)).collect()}


def test_directory_splits_only_overfull_buckets():
    slots = exact_dedup.directory({0: 5, 1: 1, 7: 4}, 5, 3)
    assert [s for s, _, _ in slots] == list(range(8))
    assert {d for s, _, d in slots if s < 2} == {3} and {d for s, _, d in slots if s >= 4} == {1}


def test_exact_dedup_null_ids(spark):
    got = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (4, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in got) == [("4", "4", True), ("None", "4", False), ("None", "None", True)]


def test_kd_shards(docs, rows, nothing):
    got = kd_shards.kd_shards(docs, shards=5).collect()
    assert len(got) == len(rows) + 1
    sizes, slots, group = {}, {}, {}
    for r in got:
        raw = (rows[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        group.setdefault(raw, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(5))
    assert kd_shards.kd_shards(nothing).collect() == []


def test_kd_shards_split_a_hot_group_and_stay_even(spark):
    df = spark.createDataFrame([(i, "copy of one" if i < 800 else f"text {i} " * (i % 7 + 1)) for i in range(2400)], "doc_id long, text string")
    sizes = {}
    for r in kd_shards.kd_shards(df, shards=24).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(abs(s / mean - 1) for s in sizes.values()) < 0.06


def test_targets_stop_and_share_again():
    got = mixing.target_tokens({"a": 10, "b": 1000, None: 100}, (5, 2, 1), 1.5, 2)
    assert got["a"] == 20 and got[None] == 200 and abs(sum(got.values()) - 1665) < 1e-6


def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    assert {(r.doc_id, r.taken) for r in got} == again and len(got) == len(rows) + 1
    taken, target, size = {}, {}, {}
    for r in got:
        s = rows[r.doc_id][3]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id][1] or "")) and 0 <= r.taken <= 2 * r.size
        taken[s], target[s], size[s] = taken.get(s, 0) + r.taken, r.target, size.get(s, 0) + r.size
    assert target == pytest.approx(mixing.target_tokens(size, (5, 2, 1), 1.5, 2))
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    assert mixing.mix(nothing).collect() == []


def test_turn_bins_rise_and_stay_small(spark):
    turns = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000 / 0.02).alias("turn"))
    got = turns.select("turn", mixing.turn_bin(F.col("turn"), 64).alias("bin")).orderBy("turn").collect()
    bins = [r.bin for r in got]
    assert bins == sorted(bins)
    assert max(Counter(bins).values()) < 20_000 / 40


def test_hot_join_equals_a_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    got = hot_join(left, right, "k", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    assert hot_join(left.limit(0), right.limit(0), "k", "n").collect() == []


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def test_simhash(docs, rows, nothing):
    prints = [fingerprint(t) for _, t, *_ in rows]
    want = roots(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    for r in simhash.near_duplicates(docs).collect():
        assert (r.fp & (1 << 64) - 1, r.component_id) == (prints[r.doc_id], want[r.doc_id])
    assert simhash.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("shard_rows", [3, 512])
def test_links_lose_no_component(spark, shard_rows):
    r = random.Random(2)
    seeds = [r.getrandbits(64) for _ in range(12)]
    values = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 4))) for s in seeds for _ in range(15)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), shard_rows)).collect()
    part = {x.node: x.component for x in found}
    want = roots(len(values), lambda a, b: (values[a] ^ values[b]).bit_count() <= 3)
    for a in range(len(values)):
        for b in range(a):
            assert (want[a] == want[b]) == (part.get(signed[a], signed[a]) == part.get(signed[b], signed[b]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)] + [(500, x) for x in range(501, 540)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {x: 500 for x in range(500, 540)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bpe_tree_equals_the_library():
    ranks = bpe.ranks_of(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tree = bpe.Codec(ranks, public_tokenizers.PATTERN, leaf=16, window=2)
    r = random.Random(1)
    alphabets = ["ab ", "a b's\n  1", "x", " \n\t", "héé 's !!　字", " \u0085\x1ca1"]
    for _ in range(1500):
        text = "".join(r.choice(r.choice(alphabets)) for _ in range(r.randrange(300)))
        ids = tree.encode(text)
        assert ids == whole.encode_ordinary(text) and tree.decode(ids) == text.encode()
    usual = bpe.Codec(ranks, public_tokenizers.PATTERN)
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()] + ["x" * 40_000, " " * 5_000 + "y", "\u5b57" * 3_000]
    for text in texts:
        assert usual.encode(text) == whole.encode_ordinary(text)
    assert usual.joins >= sum(len(t) // 1024 for t in texts) > 100


def test_bpe(docs, rows, nothing):
    args = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in bpe.encoded(docs, *args, with_ids=True).collect():
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id][1] or "").encode()).hexdigest()
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert bpe.encoded(nothing, *args).collect() == []


def test_secrets(spark):
    key = "Xq7Zt0Pn4Wv9Lm2Rb8Ks"
    told = [
        (1, f"password: {key} AKIA{'A1' * 8} {'0a' * 12}"),
        (2, f"secret=token:abcdefgh and the bearer {key} is new"),
        (3, "token = short pass é PASSWORD='abcdef'"),
        (4, None),
        (5, "authorization authorization_code_authorization_code1"),
        (6, "ſecret=abcdefgh"),
    ]
    got = by_id(secrets.secrets(spark.createDataFrame(told, "doc_id long, text string")))
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 1, 1)
    assert got[1].spans == "assign:0:30,access:31:51,hex:52:76"
    assert got[2].n_assign == 0 and got[2].spans == f"novel:{told[1][1].index(key)}:{told[1][1].index(key) + 20}"
    assert got[3].n_assign == 1 and got[3].spans == "assign:21:37"
    assert got[4].spans == got[5].spans == got[6].spans == ""
    assert got[4].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_flac_round_trip():
    r = np.random.default_rng(3)
    payloads = [flac.padded(t) for t in texts()] + [r.integers(0, 256, 192 * 7, np.uint8).tobytes(), bytes([0xFF, 0xF8, 0x14, 2, 0, 1, 2, 3]) * 24 * 3]
    media = flac.encode_streams(payloads)
    assert flac.decode_streams(media) == payloads
    assert flac.seek(media[6], 20_000) == payloads[6][19_968:20_160]
    spoilt = bytearray(media[6])
    spoilt[len(spoilt) // 2] ^= 1
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(spoilt)])


def test_flac_memory_is_a_few_times_a_long_text():
    r = np.random.default_rng(5)
    payload = r.integers(32, 127, 192 * 60_000, np.uint8).tobytes()
    tracemalloc.start()
    media = flac.encode_streams([payload])
    at, digest = 0, flac.Digest()
    for i, sample, pcm in flac.decode_blocks(media):
        assert (i, sample) == (0, at) and pcm == payload[at : at + len(pcm)]
        at += len(pcm)
        digest.add(pcm)
    assert at == len(payload) and digest.sha.hexdigest() == hashlib.sha256(payload).hexdigest()
    assert tracemalloc.get_traced_memory()[1] < 20 * len(payload)
    tracemalloc.stop()
    whole = (np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8).astype(np.int64)
    flips = int(((whole[1:] >= 0) != (whole[:-1] >= 0)).sum())
    assert digest.feature() == f"blocks=60000;peak={int(np.abs(whole).max())};energy={int((whole * whole).sum())};flips={flips}"


def test_flac_linear_prediction():
    """A frame written by hand: LPC of order 2 (taps 2, -1; precision 4; shift 0), two Rice partitions of zeros."""
    bits = "".join(f"{b:08b}" for b in (*flac.FRAME, 0))
    head = bytes(int(bits[i : i + 8], 2) for i in range(0, 40, 8))
    crc8 = int(flac._crc(np.frombuffer(head, np.uint8), np.array([0]), np.array([5]), 8)[0])
    body = "0" + "100001" + "0" + "00000101" + "00000110" + "0011" + "00000" + "0010" + "1111" + "00" + "0001" + "0000" + "1" * 94 + "0000" + "1" * 96
    body += "0" * (-len(body) % 8)
    frame = head + bytes([crc8]) + bytes(int(body[i : i + 8], 2) for i in range(0, len(body), 8))
    crc = int(flac._crc(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), 16)[0])
    data = np.frombuffer(frame + crc.to_bytes(2, "big"), np.uint8)
    got = flac.decode_frames(data, np.array([0]), np.array([len(data)]))
    assert got[0].tolist() == [5 + i for i in range(192)]


def test_flac_column(docs, rows, nothing):
    stored = flac.store(docs)
    for r in flac.features(stored).collect():
        payload = flac.padded(rows[r.doc_id][1])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((rows[r.doc_id][1] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
    blocks = {}
    for r in flac.pcm_blocks(stored.where("doc_id = 6")).orderBy("sample").collect():
        blocks[r.sample] = r.pcm
    assert b"".join(blocks[k] for k in sorted(blocks)) == flac.padded(rows[6][1])
    assert flac.features(flac.store(nothing)).collect() == []


def test_toxicity_finds_held_out_rows(spark, nothing):
    r = random.Random(4)
    common, bad = [f"w{i}" for i in range(300)], ["vile", "scorn", "filth"]
    docs, labels = [], []
    for i in range(1500):
        words = [r.choice(common) for _ in range(r.randrange(5, 60))]
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            words[r.randrange(len(words))] = r.choice(bad)
        docs.append((i, " ".join(words) if i != 1 else None))
        labels.append((i, int(toxic) if any(b in words for b in bad) or not toxic else 0))
    frame, told = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(frame, told))
    truth = dict(labels)
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    none = told.where("false")
    assert {r.predicted for r in toxicity.toxicity(frame.limit(3), none).collect()} == {0}
    told = told.withColumn("text", F.lit("x")).withColumn("source", F.lit("y"))  # columns of labels whose names clash
    odd = spark.createDataFrame([(None, "vile filth"), (7, None), (7, None), (8, ""), (9, "w1 " * 200_000), (9, "w1 " * 200_000)], "doc_id long, text string").withColumn("toxic", F.lit(1)).withColumn("score", F.lit(2))
    rows = toxicity.toxicity(frame.withColumn("toxic", F.lit(1)).withColumn("score", F.lit(2)).unionByName(odd), told).where("doc_id IS NULL OR doc_id IN (7, 8, 9)").collect()
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert len({r.score for r in rows if r.doc_id == 8}) == 2 and len({r.score for r in rows if r.doc_id == 7}) == 2
    assert toxicity.toxicity(nothing, told).collect() == []


def test_language(spark):
    r = random.Random(6)
    parts = {"en": ["the", "and", "thing", "would", "rather", "house"], "de": ["und", "nicht", "schön", "über", "haus", "werden"]}
    say = lambda l, n: " ".join(r.choice(parts[l]) for _ in range(n))
    labelled = spark.createDataFrame([(say(l, 30), l) for l in parts for _ in range(60)], "text string, lang string")
    pages = [(i, f"https://site{i % 3}.example.{'de' if i % 2 else 'uk'}/x", f"<html lang='{'de' if i % 2 else 'en'}'><script>und und und</script><p>{say('de' if i % 2 else 'en', 20)}</p>") for i in range(60)]
    pages += [(100, None, None), (101, "http://site1.example.de/", "<p>12345 !!</p>"), (102, "bad url", "<p>the house would rather</p>"), (103, "https://site1.example.de/", "<html lang='de'><p>ok</p>")]
    got = {x.page_id: x for x in language.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), labelled).collect()}
    assert all(got[i].lang == ("de" if i % 2 else "en") and not got[i].rejected for i in range(60))
    assert got[100].rejected and got[101].rejected and got[100].lang == "und"
    assert got[102].lang == "en" and got[103].declared == "de"
    docs = spark.createDataFrame([(1, say("en", 30), None, None), (2, None, "en", "s"), (3, say("de", 5), "de", "s")], "doc_id long, text string, lang string, source string")
    found = {x.doc_id: x for x in language.identify_documents(docs, labelled).collect()}
    assert (found[1].lang, found[2].rejected, found[3].lang) == ("en", True, "de")
    assert language.identify_documents(docs.where("false"), labelled).collect() == []


def test_fuzzy_lines(spark, docs, nothing):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(7)) for _ in range(900)]
    base = [" ".join(r.choice(words) for _ in range(30)) for _ in range(40)]
    near = [" ".join(w if i != 12 else "changed" for i, w in enumerate(x.split())) for x in base[:20]]
    rows = [(i, x + "\n\nsay") for i, x in enumerate(base)] + [(100 + i, x) for i, x in enumerate(near)] + [(200, None)]
    got = fuzzy_lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    part = {(x.doc_id, x.line_no): x for x in got}
    assert all(part[i, 0].component == part[100 + i, 0].component for i in range(20))
    assert len({part[i, 0].component for i in range(40)}) == 40
    assert all(part[i, 0].kept for i in range(40)) and not any(part[100 + i, 0].kept for i in range(20))
    assert [part[i, 2].kept for i in range(3)] == [True, False, False] and part[5, 1].kept and part[200, 0].kept
    assert fuzzy_lines.fuzzy_lines(nothing).collect() == []
    every = fuzzy_lines.fuzzy_lines(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.line_no) for r in every) == sorted((r.doc_id is None, r.doc_id or 0, i) for r in docs.collect() for i in range((r.text or "").count("\n") + 1))
    assert fuzzy_lines.jaccard("abcdef", "abcdefg") == pytest.approx(2 / 3)


def by_hand_classes(n, pairs):
    """The number of its class for each of n things that pairs connect."""
    at = list(range(n))
    for i, j in pairs:
        a, b = at[i], at[j]
        at = [b if x == a else x for x in at]
    seen = {}
    return [seen.setdefault(x, i) for i, x in enumerate(at)]


def test_links_of_a_bucket_against_all_pairs():
    """Few and many members, of few and of many words, of different lengths, with equal shingle sets and repeated shingles."""
    r = random.Random(1)
    for n in (2, 3, 9, 16, 17, 60, 130):
        for vocabulary in (8, 40, 400):
            words = ["".join(r.choice("abcdefg") for _ in range(6)) for _ in range(vocabulary)]
            base = [r.choice(words) for _ in range(20)]
            lines = []
            for _ in range(n):
                w = list(base)
                for _ in range(r.choice([0, 1, 1, 2, 3])):
                    w[r.randrange(20)] = r.choice(words)
                lines.append(" ".join(w[: r.choice([20, 20, 18, 12])]))
            lines[-1] = lines[0] if n % 2 else "aaaaaaaaa"
            links = [(i, j) for i in range(n) for j in range(i) if fuzzy_lines.jaccard(lines[i], lines[j]) >= 0.8]
            got = fuzzy_lines.bucket_links(lines, [list(range(n))], 0.8)
            assert by_hand_classes(n, got) == by_hand_classes(n, links) and {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in links}
            groups = [[0, *sorted(r.sample(range(1, n), r.randrange(1, n)))] for _ in range(4)]
            links = [(i, j) for i, j in links if any(i in g and j in g for g in groups) or 0 in (i, j)]
            got = fuzzy_lines.bucket_links(lines, groups, 0.8)
            assert by_hand_classes(n, got) == by_hand_classes(n, links)


def test_shingles_of_a_line_are_made_once(monkeypatch):
    """For a head's lines within KEPT_CHARS, however many groups they meet in; beyond, the links are the same."""
    r = random.Random(2)
    base = "".join(r.choice("abcdefgh ") for _ in range(80))
    lines = [base[:50] + "".join(r.choice("abcdefgh ") for _ in range(30)) for _ in range(24)]
    lines += [x[:-1] + "z" for x in lines]
    groups = [[0, *range(i, len(lines))] for i in (1, 3, 5)]
    made, grams = Counter(), fuzzy_lines.grams
    monkeypatch.setattr(fuzzy_lines, "grams", lambda t: made.update([t]) or grams(t))
    got = fuzzy_lines.bucket_links(lines, groups, 0.8)
    assert len(got) >= 20 and set(made.values()) == {1}
    monkeypatch.setattr(fuzzy_lines, "KEPT_CHARS", 0)
    assert fuzzy_lines.bucket_links(lines, groups, 0.8) == got


def test_buckets_with_the_same_members_are_one(spark):
    rows = [(1, 5), (1, 6), (2, 5), (2, 6), (3, 5), (3, 7), (4, 5), (4, 6), (4, 7), (5, 9)]
    got = fuzzy_lines.buckets(spark.createDataFrame([(k, i, 10) for k, i in rows], "key long, id long, size int")).collect()
    assert sorted((x.key, x.id, x.n, x["head"], x.chars) for x in got) == [(1, 5, 2, 5, 20), (1, 6, 2, 5, 20), (3, 5, 2, 5, 20), (3, 7, 2, 5, 20), (4, 5, 3, 5, 30), (4, 6, 3, 5, 30), (4, 7, 3, 5, 30)]


def test_filter_of_shared_keys_passes_all_of_them(spark):
    rows = spark.range(-3000, 3000).select(F.col("id").alias("key"), (F.col("id") * 7).alias("id"))
    for bits in (12, 16):
        for keys in (rows.where("key % 3 = 0"), rows.where("false")):
            some = keys.select("key").collect()
            got = {(x.key, x.id) for x in fuzzy_lines.perhaps(rows, keys.select("key"), bits).collect()}
            assert {(k.key, k.key * 7) for k in some} <= got and len(got) <= len(some) * (4 if bits == 12 else 1.1)


@pytest.mark.parametrize("most", [fuzzy_lines.TASK_LINES, 4])
def test_every_pair_of_a_bucket_is_settled(spark, monkeypatch, most):
    """Lines of one template in one bucket, each with a near copy: the head is like none of them. In a task, and beyond its bound."""
    monkeypatch.setattr(fuzzy_lines, "TASK_LINES", most)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(7))
    template = " ".join(word() for _ in range(12))
    lines = []
    for _ in range(700):
        own = " ".join(word() for _ in range(8))
        lines += [f"{template} {own}", f"{template} {own} x"]
    order = list(range(len(lines)))
    r.shuffle(order)
    at = {x: i + 1 for i, x in enumerate(order)}
    texts = spark.createDataFrame([(at[x], lines[x]) for x in order], "id long, line string")
    small = [at[x] for x in range(12)]
    bands = [(1, i) for i in at.values()] + [(2, i) for i in small]
    for keys in ({1, 2}, {2}):
        rows = fuzzy_lines.buckets(spark.createDataFrame([b for b in bands if b[0] in keys], "key long, id long"))
        got = {x.node: x.component for x in fuzzy_lines.linked(rows, texts, 0.8).collect()}
        pairs = [(at[2 * i], at[2 * i + 1]) for i in range(700 if 1 in keys else 6)]
        assert got == {x: min(p) for p in pairs for x in p}


def test_signatures_take_every_character():
    """Lines of similarity 0.8 to 0.85 share a band, in scripts without blanks and in long tokens too."""
    r = random.Random(4)
    for alphabet in ("".join(map(chr, range(0x0E01, 0x0E2F))), "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz     "):
        pairs = []
        while len(pairs) < 600:
            x = "".join(r.choice(alphabet) for _ in range(160))
            y = list(x)
            for at in r.sample(range(160), 3):
                y[at] = r.choice(alphabet)
            if 0.8 <= fuzzy_lines.jaccard(x, "".join(y)) <= 0.85:
                pairs.append((x, "".join(y)))
        keys = fuzzy_lines.band_keys([t for p in pairs for t in p])
        assert np.mean([(keys[i] == keys[i + 1]).any() for i in range(0, len(keys), 2)]) > 0.97
    assert fuzzy_lines.band_keys(["abcd", "", "abcde"])[:2] == [None, None]


def by_hand(counts):
    """Kneser-Ney's discounts, and what a count gives up."""
    times = Counter(counts)
    n = [max(1, times[r]) for r in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [min(max(r - (r + 1) * y * n[r] / n[r - 1], 0.05 * r), 0.95 * r) for r in (1, 2, 3)]
    return lambda k: d[min(k, 3) - 1] if k > 0 else 0.0


@pytest.mark.parametrize("without", [None, 0, 1])
def test_toxicity_model_keeps_rare_pairs_and_backs_off(spark, without):
    """Every ratio against Kneser-Ney by hand, at the query's own discounts: rare words and pairs, unseen pairs, backoff counts of all documents."""
    told = [(0, "a b c a", 0), (0, "b c d a b a b a b", 1), (1, "c slur b", 0), (1, "slur", 3), (1, "a b c slur slur", 1), (0, "a b c", 3)]
    every = [t for _, t, _ in told] + ["x slur", "y slur z", None, "d a"]
    tallies = toxicity.tallied(spark.createDataFrame(told, "toxic int, text string, rest int"), spark.createDataFrame([(t,) for t in every], "text string"))
    model = tallies.model(without)
    grams = lambda texts: Counter(p for t in texts for w in [toxicity.words(t)] for p in zip(["", *w], w))
    n, free = [grams(t for y, t, k in told if y == z and k != without) for z in (0, 1)], grams(every)
    vocabulary = {w for p in n[0] + n[1] for w in p[1:]}
    assert sorted(model.vocabulary) == sorted(toxicity.hashes(sorted(vocabulary))) and len(model.pairs) == len({p for p in n[0] + n[1] if p[0]})
    total = len(free) + len({w for _, w in free})
    lefts = [Counter(w for _, w in n[y]) for y in (0, 1)]
    of_words, of_pairs = [by_hand(lefts[y].values()) for y in (0, 1)], [by_hand(n[y].values()) for y in (0, 1)]
    assert all(f[y](1) < 1 and f[y](2) < 2 and f[y](9) < 3 for f in (of_words, of_pairs) for y in (0, 1))

    def uni(y, w):
        whole = sum(lefts[y].values())
        freed = sum(map(of_words[y], lefts[y].values())) / whole
        return (lefts[y][w] - of_words[y](lefts[y][w])) / whole + freed * (sum(p[1] == w for p in free) + 1) / total

    def pair(y, a, b):
        c, freed = sum(k for p, k in n[y].items() if p[0] == a), sum(of_pairs[y](k) for p, k in n[y].items() if p[0] == a)
        return (n[y][a, b] - of_pairs[y](n[y][a, b])) / max(c, 1) + (freed / c if c else 1) * uni(y, b)

    for a in vocabulary:
        for b in vocabulary:
            first, both = np.log(uni(1, a) / uni(0, a)), np.log(pair(1, a, b) / pair(0, a, b))
            assert model.features([f"{a} {b}"])[0][-1] == pytest.approx((first + both) / 2, abs=1e-6)


def test_words_of_ascii_texts_are_those_of_the_pattern():
    every = "".join(map(chr, range(128)))
    for text in (every, every * 2 + "A_b9", "", None, "\x1c\x1da\x1fB", every + "É_é"):
        assert toxicity.words(text) == toxicity.WORDS.findall((text or "").lower())


def test_toxicity_sample_is_bounded_by_characters(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_CHARACTERS", 1000)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, "x" * 90) for i in range(400)], "doc_id long, text string")
    got = toxicity.sample(docs, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")).collect()
    assert Counter(r.toxic for r in got) == {0: 11, 1: 11} and len(ids) > 22


def test_secrets_reports_whole_candidates():
    """A long candidate has its true end, its rest is no span of its own, and a base span inside doesn't hide it."""
    r = random.Random(7)
    some = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    scan = secrets.Novelty()
    long, run = some(3000), some(30) + "0a1b" * 6 + some(30)
    text = f"Authorization: Bearer {long} end"
    assert scan.spans(text, secrets.base_spans(text)) == [(22, 3, 3022)]
    text = f"bearer {run} end"
    assert len(secrets.base_spans(text)) == 1 and scan.spans(text, secrets.base_spans(text)) == [(7, 3, 7 + len(run))]
    text = "bearer " + "0a1b" * 6 + ". end"
    assert scan.spans(text, secrets.base_spans(text)) == []


def test_declared_language_is_found_anywhere():
    assert language.declared("<!-- " + "licence " * 2000 + "-->\n<HTML class=x\nlang = 'DE-at'><p>") == "de"
    assert language.declared("<html class='ie'><![endif]--><html lang=fr>") == "fr"
    assert language.declared("<html><p lang='de'>") is None and language.declared(None) is None
    assert language.declared("<html " * 200_000) is None  # linear


def test_fuzzy_lines_recall_against_all_pairs(spark):
    """Components of noisy copies of lines of 8 to 200 characters against union-find over all pairs."""
    r = random.Random(11)
    lines = []
    for _ in range(60):
        base = "".join(r.choice("abcdefghij klmnop") for _ in range(r.choice((12, 30, 60, 200))))
        for _ in range(6):
            chars = list(base)
            chars[-1 - r.randrange(max(1, len(base) // 12))] = r.choice("xyzw")
            lines.append("".join(chars).strip())
    lines = sorted(set(lines))
    links = [(i, j) for i in range(len(lines)) for j in range(i) if fuzzy_lines.jaccard(lines[i], lines[j]) >= 0.8]
    got = {x.doc_id: x.component for x in fuzzy_lines.fuzzy_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    met = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 300 and met >= 0.97 * len(links)
    root = list(range(len(lines)))
    for _ in lines:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    assert len({(got[i], root[i]) for i in range(len(lines))}) == len(set(got.values())), "no component joins what no chain of links joins"


def test_declared_language_skips_comments_and_scripts():
    assert language.declared("<!-- <html lang='fr'> --><html lang='de'>") == "de"
    assert language.declared("<script>'<html lang=fr>'</script><html lang=nl>") == "nl"
    assert language.declared("<!-- not closed <html lang='fr'>") is None
    assert language.plain("a<script>b</script>c<!-- d") == "a c "


def test_identifiers_of_the_corpus_are_a_dictionary(spark):
    rows = [(i, f"call load_user_profile and {'rare_name_' + 'abcdefg'[i]} x1_y2_z3_w4") for i in range(5)] + [(9, None), (10, "")]
    got = secrets.dictionary(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.startswith(secrets.IDENTIFIERS) and got.endswith(b" load_user_profile") and b"rare_name_a" not in got


def test_one_text_holds_nine_tenths_of_the_rows(spark):
    rows = [(f"d{i:03}", "the same words stand here" if i % 10 else f"other words {i} of number {i * i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = exact_dedup.exact_dedup(docs).collect()
    assert len(found) == 200 and sum(r.kept for r in found) == 21
    assert {(r.keep_id, r.group_size) for r in found if int(r.doc_id[1:]) % 10} == {("d001", 180)}
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(near) == 200 and {near[i] for i, t in rows if t.startswith("the same")} == {"d001"}
