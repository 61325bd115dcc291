"""Deep and shared provenance walks, hash trees over segments, and erasure of chained ledgers."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracefold.functions.scan import scan
from tracefold.operators import chain, lineage, merkle
from tracefold.plans import views
from tracefold.sources.tables import cut_lineage

EDGES, LEDGER = "derived_id string, source_id string, ordinal int", "ledger_id long, sequence long, id string, kind string, stream_id string, ts_us long, payload string"


def walk(root, known, sources):
    """Preorder, each node once, missing ones skipped."""
    out, seen, stack = [], set(), [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node in seen or node not in known:
            continue
        seen.add(node)
        out.append((root, node, depth, len(out)))
        stack += [(s, depth + 1) for _, s in sorted(sources.get(node, []), reverse=True)]
    return out


def walked(spark, seeds, known, edges):
    sources = {}
    for d, s, o in edges:
        sources.setdefault(d, []).append((o, s))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    got = lineage.tree(frame(seeds), frame(known), spark.createDataFrame(edges, EDGES)).collect()
    return sorted(map(tuple, got)), sorted(x for r in seeds for x in walk(r, set(known), sources))


def test_walk_of_a_chain_of_ten_thousand(spark):
    n = 10_000
    got, want = walked(spark, ["n0", "n9990"], [f"n{i}" for i in range(n)], [(f"n{i}", f"n{i + 1}", 0) for i in range(n - 1)])
    assert got == want and len(got) == n + 10


def test_walks_without_forks_are_not_ordered(spark):
    frame = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    edges = [("a", "b", 0), ("b", "c", 0), ("c", "d", 3), ("e", "c", 0)]
    got = lineage.tree(frame, frame, spark.createDataFrame(edges, EDGES))
    assert "Window" not in got._jdf.queryExecution().sparkPlan().toString()
    want = [x for r in "abcde" for x in walk(r, set("abcde"), {d: [(o, s)] for d, s, o in edges})]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_walk_of_a_shared_graph(spark, seed):
    r = random.Random(seed)
    n = 60
    edges = []
    for i in range(n - 1):
        targets = r.sample(range(i + 1, n), min(n - 1 - i, r.choice([0, 1, 1, 1, 2, 3])))
        edges += [(f"n{i}", f"n{t}", o * 2) for o, t in enumerate(targets)]
    edges += [("n3", "gone", 9), ("absent", "n5", 0)]
    got, want = walked(spark, ["n0", "n1", "n7", "nowhere"], [f"n{i}" for i in range(n)], edges)
    assert got == want


def test_walk_of_long_chains_between_forks(spark):
    """Two ways from each fork, both long, that meet again."""
    edges, at = [], "f0"
    for k in range(4):
        for way in range(2):
            names = [f"c{k}{way}{i}" for i in range(70 + 9 * way)]
            edges += [(at, names[0], 1 - way), *[(a, b, 0) for a, b in zip(names, names[1:])], (names[-1], f"f{k + 1}", 0)]
        at = f"f{k + 1}"
    known = sorted({x for d, s, _ in edges for x in (d, s)})
    got, want = walked(spark, ["f0", "c105"], known, edges)
    assert got == want


def test_walk_ends_in_circles(spark):
    edges = [("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("d", "a", 0), ("d", "e", 1), ("e", "e", 0)]
    got, want = walked(spark, ["a", "d"], list("abcde"), edges)
    assert got == want


def test_walk_without_nodes_or_edges(spark):
    none = spark.createDataFrame([], "id string")
    assert lineage.tree(none, none, spark.createDataFrame([], EDGES)).collect() == []
    assert walked(spark, ["a"], ["a"], [("x", "y", 0)])[0] == [("a", "a", 0, 0)]


@pytest.fixture(scope="module")
def ledger(spark):
    r = random.Random(1)
    rows = [(led, i, f"e{led}-{i}", r.choice(["observation", "belief"]), "camera", 1000 * i, f'{{"i":{i},"x":"é{r.random()}"}}' if i % 13 else None) for led in range(3) for i in range(0, 400 + led)]
    return cut_lineage(chain.build(spark.createDataFrame(rows, LEDGER), 20))


def test_build_keeps_columns_and_verifies(ledger):
    assert set(ledger.columns) == {"ledger_id", "sequence", "id", "kind", "stream_id", "ts_us", "payload", "segment", "previous_hash", "hash"}
    assert ledger.count() == 1203 and chain.broken(ledger).collect() == [] and merkle.broken(ledger, merkle.tree(ledger, 4), fan_out=4).collect() == []


def test_links_stream_over_batches_and_keep_values(spark):
    """No Python group for each segment; a null beside it costs a long number no digit."""
    big = (1 << 53) + 1
    rows = [(led, i, f"e{led}-{i}", "k", "s", None if i % 3 else big + i, None if i % 5 == 4 else f"p{i}") for led in range(2) for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        linked = chain.build(spark.createDataFrame(rows, LEDGER), 7)
        assert "FlatMapGroups" not in linked._jdf.queryExecution().executedPlan().toString()
        got = {(x.ledger_id, x.sequence): x for x in linked.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for led, i, name, _, _, ts, text in rows:
        before = chain.GENESIS if i % 7 == 0 else got[led, i - 1].hash
        assert (got[led, i].id, got[led, i].ts_us, got[led, i].previous_hash) == (name, ts, before)
        assert got[led, i].hash == hashlib.sha256((before + (text or "")).encode()).hexdigest()


@pytest.mark.parametrize("gone", [[], ["e1-40", "e1-41", "e2-399", *[f"e0-{i}" for i in range(20, 60)]], [f"e2-{i}" for i in range(402)]])
def test_erasure_touches_changed_segments_only(spark, ledger, gone):
    erased = spark.createDataFrame([(x,) for x in gone], "id string")
    edges = spark.createDataFrame([("e0-6", "e0-5", 0), ("e0-7", "e0-6", 0)], EDGES)
    before = {r.id: r for r in ledger.collect()}
    got = lineage.compacted(ledger, edges, erased)
    rows = got.rows.collect()
    left = [x for x in sorted(before.values(), key=lambda r: (r.ledger_id, r.sequence)) if x.id not in set(gone)]
    want, last, n = {}, None, 0
    for x in left:
        n = n + 1 if x.ledger_id == last else 0
        last, want[x.id] = x.ledger_id, n
    assert {r.id: r.sequence for r in rows} == want
    touched = {(before[x].ledger_id, before[x].segment) for x in gone}
    for r in rows:
        old = before[r.id]
        assert (r.kind, r.stream_id, r.ts_us, r.payload, r.segment) == (old.kind, old.stream_id, old.ts_us, old.payload, old.segment)
        if (r.ledger_id, r.segment) not in touched:
            assert (r.previous_hash, r.hash) == (old.previous_hash, old.hash)
    assert chain.broken(got.rows).collect() == [] and merkle.broken(got.rows, got.tree).collect() == []
    assert {tuple(x) for x in got.tree.collect()} == {tuple(x) for x in merkle.tree(got.rows).collect()}
    assert {(e.derived_id, e.source_id) for e in got.edges.collect()} == {("e0-6", "e0-5"), ("e0-7", "e0-6")}
    again = lineage.compacted(got.rows, got.edges, spark.createDataFrame([("e1-7",)], "id string"), tree=got.tree)  # segments stay what they are
    assert chain.broken(again.rows).collect() == [] and merkle.broken(again.rows, again.tree).collect() == []


def test_erasure_moves_no_hash_that_it_replaces(spark, ledger):
    """Where each segment lost a row, the stored hashes aren't even read."""
    erased = ledger.where("sequence % 20 = 3 OR sequence >= 400").select("id")
    got = lineage.compacted(ledger, spark.createDataFrame([], EDGES), erased)
    assert "hash#" not in got.rows._jdf.queryExecution().sparkPlan().collectLeaves().mkString(" ")
    assert got.rows.count() == 1203 - erased.count() and chain.broken(got.rows).collect() == []


@pytest.mark.parametrize("small", [0, 200_000])
@pytest.mark.parametrize("gone", [[], ["e1-40", "e1-41", "e2-399", *[f"e0-{i}" for i in range(20, 60)]], [f"e2-{i}" for i in range(402)]])
def test_segments_not_linked_yet_are_linked_as_they_stay(spark, ledger, gone, small, monkeypatch):
    """What chains made before the erasure and renewed by it would be; also where erased ids are more than are broadcast."""
    edges = spark.createDataFrame([], EDGES)
    erased = spark.createDataFrame([(x,) for x in gone], "id string")
    want = lineage.compacted(ledger, edges, erased)
    monkeypatch.setattr(lineage, "SMALL_FRONTIER", small)
    bare = ledger.drop("previous_hash", "hash")
    got = lineage.compacted(bare, edges, erased)
    assert set(got.rows.columns) == set(ledger.columns)
    assert {tuple(r) for r in got.rows.select(*ledger.columns).collect()} == {tuple(r) for r in want.rows.select(*ledger.columns).collect()}
    assert {tuple(r) for r in got.tree.collect()} == {tuple(r) for r in want.tree.collect()}
    again = lineage.compacted(ledger, edges, erased)
    assert {tuple(r) for r in again.rows.select(*ledger.columns).collect()} == {tuple(r) for r in want.rows.select(*ledger.columns).collect()}


def test_a_row_goes_by_its_id_alone(spark):
    """Rows of one segment that share a sequence, by mistake, are erased apart."""
    rows = spark.createDataFrame([(1, 0, "a", "p", 0), (1, 1, "b", "p", 0), (1, 1, "c", "p", 0), (1, 2, "d", "p", 0)], "ledger_id long, sequence long, id string, payload string, segment long")
    left = lineage.compacted(rows, spark.createDataFrame([], EDGES), spark.createDataFrame([("b",)], "id string")).rows
    assert {(r.id, r.sequence) for r in left.collect()} == {("a", 0), ("c", 1), ("d", 2)}


def test_large_frontiers_move_few_rows(spark, monkeypatch):
    """Rows whose ids a bitmap doesn't hold are left out before they are shuffled, and those that it holds by chance afterwards."""
    monkeypatch.setattr(lineage, "SMALL_FRONTIER", 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.range(50_000).select(F.concat(F.lit("n"), "id").alias("id"))
        ids = spark.range(0, 5_000, 5).select(F.concat(F.lit("n"), "id").alias("id"))
        for bits in (1 << 27, 1 << 10):  # sparse, and nearly full
            monkeypatch.setattr(lineage, "ID_BITS", bits)
            found = lineage._among(rows, "id", ids, 1_000)
            assert {r.id for r in found.collect()} == {f"n{i}" for i in range(0, 5_000, 5)}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("_bits") > plan.index("Join LeftSemi") and plan.count("Join LeftSemi") == 2  # the bitmap's join is below
        assert plan.splitlines()[0].find("_bits") < 0
        edges = spark.createDataFrame([(f"n{i}", f"n{i // 10}", 0) for i in range(1, 3_000)], EDGES)
        every = spark.range(3_000).select(F.concat(F.lit("n"), "id").alias("id"))
        got = {r.id for r in lineage.cascade(spark.createDataFrame([("n2",)], "id string"), every, edges).collect()}
        want = {2}
        for i in range(3, 3_000):
            if i // 10 in want:
                want.add(i)
        assert got == {f"n{i}" for i in want}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_cut_leaves_no_shuffle(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}
    old, kept = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    cut = cut_lineage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    assert files() <= old and cut.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept


def test_erase_compact_writes_no_hashes(spark):
    """The chain of what stays is made once, at the end: no table between holds a hash, which nothing compresses below 32 bytes."""
    from pathlib import Path

    import pyarrow.parquet as pq

    from tracefold.plans.queries import QUERIES

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    old = set(shared.rglob("*.parquet"))
    left = QUERIES["erase_compact"](spark, "/root/testdata/sf0.001")
    assert left.where("hash IS NULL").count() == 0
    new = set(shared.rglob("*.parquet")) - old
    assert new and not [f for f in new if "hash" in pq.read_schema(f).names]


@pytest.mark.parametrize("name", ["lineage_nodes", "lineage_edges"])
def test_lines_are_numbered_by_counts(spark, tmp_path, name, monkeypatch):
    """Rows that repeat an order and line number get the numbers that the view's SQL gives them, in several blocks where there are many; no other column of a line is read."""
    monkeypatch.setattr(views, "_BLOCK", 4)
    keys = [(1, 1)] * 9 + [(1, 2)] * 4 + [(2, 1)] + [(None, 1), (3, None)] * 5
    lines = spark.createDataFrame([(o, n, i, i % 2, float(i), 1.0) for i, (o, n) in enumerate(keys)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for t in ("orders", "customer", "nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(20).write.parquet(f"{tmp_path}/{t}.parquet")
    want = sorted(map(str, views._sql(spark, str(tmp_path), *views.VIEWS[name]).collect()))
    got = views.view(spark, str(tmp_path), name)
    assert sorted(map(str, got.collect())) == want
    assert got.schema.names == views._sql(spark, str(tmp_path), *views.VIEWS[name]).schema.names
    assert sorted(map(str, views.view(spark, str(tmp_path), name, cut_lineage(views.lines(spark, str(tmp_path)))).collect())) == want
    assert "l_partkey" not in got._jdf.queryExecution().executedPlan().toString()


def test_few_chunks_are_broadcast(spark):
    """Rows scanned in chunks aren't moved again for what chunks inherit, whatever Spark takes chunks to weigh."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.range(1_000).select(F.lit(1).alias("k"), "id")
        for cut in (True, False):
            got = scan(rows, ["k"], ["id"], F.floor(F.col("id") / 100), {"n": ("sum_before", F.lit(1))}, small=False, cut=cut)
            assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
            assert got.where("n = id").count() == 1_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_tree_that_grows_a_level(spark):
    rows = lambda n: chain.build(spark.createDataFrame([(1, i, f"e{i}", "k", "s", i, f"p{i}") for i in range(n)], LEDGER), 2)
    old, new = merkle.tree(rows(8), 4), rows(40)
    changed = new.where("segment >= 4").select("ledger_id", "segment").distinct()
    fresh = merkle.leaves(new.where("segment >= 4"))
    got = merkle.renewed(old, changed, fresh, 4)
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in merkle.tree(new, 4).collect()}
    assert merkle.roots(got).first().rows == 40


def test_faults_of_the_tree(spark, ledger):
    nodes = cut_lineage(merkle.tree(ledger, 4))
    spoilt = ledger.where("NOT (ledger_id = 0 AND segment = 3)").withColumn("hash", F.when((F.col("ledger_id") == 1) & (F.col("segment") == 2), F.lit("x")).otherwise(F.col("hash")))
    assert {tuple(r) for r in merkle.broken(spoilt, nodes, fan_out=4).collect()} == {(0, 0, 3, "missing"), (1, 0, 2, "changed")}
    cut = nodes.where("NOT (ledger_id = 2 AND level = 0 AND node = 5)").withColumn("hash", F.when((F.col("ledger_id") == 1) & (F.col("level") == 2) & (F.col("node") == 0), F.lit("y")).otherwise(F.col("hash")))
    found = {tuple(r) for r in merkle.broken(ledger, cut, fan_out=4).collect()}
    assert found == {(2, 0, 5, "unknown"), (2, 1, 1, "changed"), (1, 2, 0, "changed"), (1, 3, 0, "changed")}
    one = spark.createDataFrame([(1, 20)], "ledger_id long, segment long")  # its path doesn't meet the spoilt node's children
    assert {tuple(r) for r in merkle.broken(ledger, cut, one, 4).collect()} == {(1, 3, 0, "changed")}
    assert merkle.broken(ledger, nodes, one, 4).collect() == []


def test_range_erasure_asks(spark, ledger):
    edges = spark.createDataFrame([("e0-300", "e0-1", 0)], EDGES)
    with pytest.raises(ValueError):
        lineage.erase_range(ledger, edges, 0, 2000, False)
    got = lineage.erase_range(ledger.where("ledger_id = 0"), edges, 0, 2000, True)
    assert got.rows.count() == 400 - 4 and chain.broken(got.rows).collect() == []
