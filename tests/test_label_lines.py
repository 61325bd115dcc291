"""Label files numbered by byte ranges."""

import pytest

from tracefold.sources import tables


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_lines_are_numbered_over_ranges(spark, tmp_path, small_ranges):
    texts = {}
    for name in ("a", "b", "c"):
        lines = ["" if i % 11 == 3 else "\r" if i % 13 == 5 else '{"ts_us":%d,"occupied":%s}' % (i, "true" if i % 2 else "false") for i in range({"a": 300, "b": 7, "c": 120}[name])]
        texts[name] = lines
        (tmp_path / f"{name}.jsonl").write_bytes(("\n".join(lines) + ("\n" if name != "b" else "")).encode())
    rows = tables.numbered_lines(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 1
    got = {}
    for r in rows.collect():
        got.setdefault(r.file[-7], {})[r.line_no] = r.line
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == texts and all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())
    found = tables.labels(spark, str(tmp_path / "a.jsonl")).collect()
    assert {(r.line_no, r.ts_us, r.occupied) for r in found} == {(i + 1, i, bool(i % 2)) for i in range(300) if i % 11 != 3 and i % 13 != 5}


@pytest.mark.parametrize("bad", ["{", '{"ts_us":1.5,"occupied":true}', '{"ts_us":1,"occupied":1}', "[]"])
def test_the_number_of_a_bad_line_is_right(spark, tmp_path, small_ranges, bad):
    lines = ['{"ts_us":1,"occupied":true}'] * 400
    lines[333] = bad
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    with pytest.raises(Exception, match="invalid label at line 334"):
        tables.labels(spark, str(tmp_path / "x.jsonl")).collect()


def test_an_empty_file_has_no_labels(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("")
    assert tables.labels(spark, str(tmp_path)).collect() == []
