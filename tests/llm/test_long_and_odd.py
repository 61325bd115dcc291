"""Language ID, secret scans and line dedup: linear time on odd long texts, and null, empty, repeated and tied rows."""

import random
import re
import string
import time

import pytest
import zstandard

from tracefold.llm import fuzzy_lines, language, secrets

MB = 1 << 20


def seconds(f, *args):
    began = time.process_time()
    f(*args)
    return time.process_time() - began


@pytest.mark.parametrize("unit", ["ab.", "x", "ab_", "ab-", "ab. ", "token ", "token=", "AKIA", "0f", 'password: "', "api_key = aB3"])
def test_secrets_read_a_megabyte_in_linear_time(unit):
    text = (unit * (MB // len(unit) + 1))[:MB]
    novelty = secrets.Novelty()
    assert seconds(lambda: (secrets.IDENTIFIER.findall(text), novelty.spans(text, secrets.base_spans(text)))) < 20


@pytest.mark.parametrize("unit", ["<", "<html", "&", "<!--", "<script>", "</script   ", "<html lang", "lang = ", "<a href='x'>", "&amp", ">", "<style></style "])
def test_pages_of_five_megabytes_in_linear_time(unit):
    page = (unit * (5 * MB // len(unit) + 1))[: 5 * MB]
    assert seconds(lambda: (language.plain(page), language.declared(page))) < 20


def test_tags_end_before_the_next_begins():
    assert language.plain("a < b <i>c</i> d<br") == "a < b  c  d<br"


def test_secrets_of_odd_rows(spark):
    r3 = random.Random(3)
    secret = "".join(r3.choice(string.ascii_letters + string.digits) for _ in range(32))
    rows = [(None, f"token = '{secret}'", "x"), (1, None, "x"), (1, None, "x"), (2, "", "x"), (3, f"bearer {secret} and {secret[::-1]}", "x"), (3, f"bearer {secret} and {secret[::-1]}", "x"), (4, "ab." * 400_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_assign, r.spans) for r in secrets.secrets(df).collect()))
    assert len(got) == len(rows) and got[0][2] == 1 and got[1][3] == got[2][3] == "" and got[4] == got[5] and got[4][3].startswith("novel:7:39")
    assert secrets.secrets(df.limit(0)).collect() == []


def test_dictionary_counts_texts_over_all_rows(spark):
    df = spark.createDataFrame([("one.two one.two three_four",), ("one.two five-six",), ("three_four A1b.c-d",), (None,)], "text string").repartition(3)
    assert secrets.dictionary(df)[len(secrets.IDENTIFIERS) :].split() == [b"three_four", b"one.two"]


def test_novelty_equals_compressing_by_hand():
    """Every candidate near a sensitive word, found and measured the plain way."""
    r = random.Random(8)
    token = lambda: "".join(r.choice("abcdefghij0123456789XYZ_") for _ in range(r.randrange(12, 40)))
    words = ["token", "bearer", "secret", "access_token_expires_in1", "value", "=", ":", "\n", "x" * 30]
    held = zstandard.ZstdCompressionDict(secrets.IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = lambda x: len(zstandard.ZstdCompressor(level=9, dict_data=held, write_content_size=False, write_checksum=False).compress(x))
    found = 0
    for _ in range(300):
        text = " ".join(r.choice([token(), r.choice(words)]) for _ in range(r.randrange(1, 30)))
        base = secrets.base_spans(text)
        ends = [m.end() for w in secrets.SENSITIVE for m in re.finditer(f"(?={re.escape(w)})", text.lower()) for m in [re.compile(re.escape(w)).match(text.lower(), m.start())]]
        got = secrets.Novelty().spans(text, base)
        for start, _, end in got:
            around = (text[max(0, start - secrets.AROUND) : start] + text[end : end + secrets.AROUND]).encode()
            assert pack(around + b"\n" + text[start:end].encode()) - pack(around) >= secrets.NOVEL * (end - start)
            assert any(0 <= start - e <= secrets.REACH for e in ends) or any(a[2] <= start <= a[2] + secrets.REACH for a in got)
            assert not any(a <= start and end <= b for a, _, b in base)
        spans = {(a, b) for a, _, b in got}
        for m in secrets.CANDIDATE.finditer(text):  # whole candidates that were passed over
            bare = m[0].strip(".=-_/")
            at = m.start() + len(m[0]) - len(m[0].lstrip(".=-_/"))
            known = any(a <= at and at + len(bare) <= b for a, _, b in base)
            near = any(0 <= m.start() - e <= secrets.REACH for e in ends)
            mixed = any(c.isdigit() for c in bare) and any(c.isalpha() for c in bare)
            around = (text[max(0, m.start() - secrets.AROUND) : m.start()] + text[m.end() : m.end() + secrets.AROUND]).encode()
            if near and mixed and not known and (m.start(), m.end()) not in spans:
                assert pack(around + b"\n" + m[0].encode()) - pack(around) < secrets.NOVEL * len(m[0])
        found += len(got)
    assert found > 50


EN, FR = "the house and the garden of the man with the dog and the tree", "la maison et le jardin de la femme avec le chien et les arbres"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(i, f"{t} {i}", lang) for i in range(40) for t, lang in ((EN, "en"), (FR, "fr"))], "doc_id long, text string, lang string")


PAGES = "page_id long, url string, html string, vote int, own string, logs string, top string"


def test_pages_of_odd_rows(spark, labelled):
    extra = (1, "a", "b", "c")
    rows = [
        (1, "http://a.example.fr/x", f"<html lang=fr><p>{FR}</p></html>", *extra), (1, "http://a.example.fr/x", f"<html lang=fr><p>{FR}</p></html>", *extra),
        (None, None, f"<p>{EN}", *extra), (2, "not a url", None, *extra), (3, "", "", *extra), (4, "http://b.com", "<p>1234 !!", *extra),
        (5, "http://b.com/long", "<" * 300_000 + f"<p>{EN}</p>" * 2000, *extra),
    ]
    got = language.identify_pages(spark.createDataFrame(rows, PAGES), labelled).collect()
    assert len(got) == len(rows)
    said = {}
    for r in got:
        said.setdefault(r.page_id, set()).add((r.lang, r.rejected))
    assert said == {1: {("fr", False)}, None: {("en", False)}, 2: {("und", True)}, 3: {("und", True)}, 4: {("und", True)}, 5: {("en", False)}}
    assert language.identify_pages(spark.createDataFrame([], PAGES), labelled).collect() == []


def test_ties_go_to_the_first_language(spark):
    """Two languages fitted on the same texts."""
    same = spark.createDataFrame([(i, f"{EN} {i // 2}", ("xx", "aa")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    one = spark.createDataFrame([(1, None, EN, 0, "", "", "")], PAGES)
    r = language.identify_pages(one, same).first()
    assert (r.text_lang, r.rejected) == ("aa", False) or (r.text_lang, r.lang) == ("aa", "und")


def test_fusion_equals_the_plain_formula(spark, labelled):
    """Votes, hierarchical priors and likelihoods by loops over the rows."""
    import math

    r = random.Random(9)
    hosts = ["http://a.x.fr/", "http://b.x.fr/", "http://c.y.com/", None]
    rows = [(i, h and h + str(i), (f"<html lang={r.choice(['fr', 'en'])}>" if i % 3 else "") + f"<p>{' '.join(r.sample(t.split(), 6))}", 0, "", "", "") for i, (h, t) in enumerate((r.choice(hosts), r.choice([EN, FR])) for _ in range(60))]
    got = {x.page_id: x for x in language.identify_pages(spark.createDataFrame(rows, PAGES), labelled).collect()}
    model = language.fitted(labelled)
    k = len(model.languages)
    seen = []
    for i, url, page, *_ in rows:
        logs, over = model.evidence(language.plain(page))
        host = url and url.split("/")[2]
        keys = {"host": host, "domain": host and ".".join(host.split(".")[-2:]), "suffix": host and host.split(".")[-1], "declared": language.declared(page)}
        seen.append((i, logs, logs.index(max(logs)) if over > 0 else None, keys))
    votes = [sum(v == j for _, _, v, _ in seen) for j in range(k)]
    whole = [(n + 1) / (sum(votes) + k) for n in votes]

    def others(row, name):
        return [float(sum(s[2] == j and s[3][name] == row[3][name] for s in seen if s is not row)) for j in range(k)]

    smooth = lambda v, p: [(a + b * language.LENT) / (sum(v) + language.LENT) for a, b in zip(v, p)]
    for row in seen:
        i, logs, _, keys = row
        prior = whole
        for name in ("domain", "host"):
            prior = smooth(others(row, name) if keys[name] else [0.0] * k, prior)
        z = [math.log(p) + x for p, x in zip(prior, logs)]
        for name in ("declared", "suffix"):
            if keys[name]:
                z = [a + math.log(b / w) for a, b, w in zip(z, smooth(others(row, name), whole), whole)]
        assert got[i].posterior == pytest.approx(1 / sum(math.exp(x - max(z)) for x in z), abs=1e-6)
        assert got[i].rejected or got[i].lang == model.languages[z.index(max(z))]


def test_fuzzy_lines_of_odd_rows(spark):
    """Lines over a task's characters, null and repeated ids, null and empty texts, other columns of clashing names."""
    r = random.Random(6)
    long = "".join(r.choice(string.ascii_lowercase) for _ in range(fuzzy_lines.TASK_CHARS))
    near = long[:500] + "#" + long[501:]
    other = "".join(r.choice(string.digits) for _ in range(400))
    rows = [(3, f"{long}\n\nsame line here"), (1, near), (None, f"{other}\nsame line here"), (2, None), (2, ""), (5, f"{other}?"), (5, f"{other}?")]
    docs = spark.createDataFrame([(*x, 7, 8, "k") for x in rows], "doc_id long, text string, id long, n long, key string")
    got = [(x.doc_id, x.line_no, x.kept) for x in fuzzy_lines.fuzzy_lines(docs).collect()]
    kept = [(1, 0, True), (2, 0, True), (2, 0, True), (3, 0, False), (3, 1, True), (3, 2, True), (5, 0, True), (5, 0, True), (None, 0, False), (None, 1, False)]
    assert sorted(got, key=str) == sorted(kept, key=str)
