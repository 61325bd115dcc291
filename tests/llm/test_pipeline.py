"""The pipeline's stages against plain versions on a small table."""

import hashlib
import random
import re

import corpus_pipeline
from tracefold.llm import queries


def test_stages(spark, tmp_path):
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("ho", "ta", "the", "su", "ri") for b in ("me", "ll", "nd", "ver", "s")]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(30, 80))) for _ in range(40)]
    texts += texts[:5] + [t.replace(" ", "\n ", 1) for t in texts[5:8]] + ["12345 67890 !!", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language ID"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(range(48))
    once = stage["exact dedup"](spark, kept, str(tmp_path))
    assert {x.doc_id for x in once.collect()} == set(range(5)) | {45, 46, 47} | set(range(8, 40))
    apart = stage["SimHash near-dedup"](spark, once, str(tmp_path))
    mixed = stage["mixing"](spark, apart, str(tmp_path))
    assert mixed.columns == docs.columns
    n = lambda df: sum(len(re.findall(r"\S+", x.text)) for x in df.collect())
    assert abs(n(mixed) - 1.5 * n(apart)) < 0.2 * n(apart)
    last = stage["byte-level BPE"](spark, mixed, str(tmp_path)).collect()
    text = {x.doc_id: x.text for x in mixed.collect()}
    assert len(last) == mixed.count() and all(x.decoded_sha256 == hashlib.sha256(text[x.doc_id].encode()).hexdigest() for x in last)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.ids_sha256) for x in whole) == sorted((x.doc_id, x.ids_sha256) for x in last)


def test_rows_that_repeat_or_lack_an_id(spark, tmp_path):
    rows = [(1, "the home tells the sun", "en", "a", 1)] * 2 + [(None, "other words here", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.exact(spark, docs, str(tmp_path)).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "None"]


def test_empty_table_and_clashing_columns(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, id long, copies int, of string, row int"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = spark.createDataFrame([(i, "the home tells the sun " * (i + 1), "en", "a", 1, 9, 9, "x", 9) for i in range(6)], kind)
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and {tuple(x)[5:] for x in mixed.collect()} == {(9, 9, "x", 9)}


def test_queries_are_one_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
