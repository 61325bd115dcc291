"""The k-d tree and the entropy dual against plain versions; null ids and very long texts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracefold.llm import kd_shards, mixing, simhash

DDL = "doc_id long, text string, source string"


def texts(seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "délta", "ж", "longer-word", "x"]
    out = [r.choice([" ", "\n"]).join(r.choice(words) for _ in range(int(math.exp(r.uniform(0, 6))))) for _ in range(700)]
    return [*out, *[out[3]] * 60, None, "", "y" * 2_000]


@pytest.mark.parametrize("seed,shards", [(1, 24), (2, 7)])
def test_shards_are_leaves_of_a_tree_of_weighted_medians(spark, seed, shards):
    """Each inner node splits along its widest dimension, at the share of bytes that its leaves call for."""
    df = spark.createDataFrame([(i if i % 9 else None, t, "s") for i, t in enumerate(texts(seed))], DDL)
    meta = kd_shards.metadata(df)
    rows = meta.withColumn("shard", kd_shards.kd_tree(meta, shards)).collect()
    dims = ["k0", "k1", "k2"]
    total = sum(r["size"] for r in rows)
    slack = max(1, total / shards * 0.001)
    span = {d: max(1, max(r[d] >> 47 for r in rows) - min(r[d] >> 47 for r in rows)) for d in dims}
    seen = []

    def check(part, n):
        if n == 1:
            assert len({r.shard for r in part}) == 1
            seen.append(part[0].shard)
            return
        dim = max(dims, key=lambda d: ((max(r[d] >> 47 for r in part) - min(r[d] >> 47 for r in part)) / span[d], d == dims[0]))
        low = {}
        for r in part:
            low[r.shard] = min(low.get(r.shard, 1 << 63), r[dim])
        assert len(low) == n
        first = set(sorted(low, key=low.get)[: n // 2])
        left, right = [r for r in part if r.shard in first], [r for r in part if r.shard not in first]
        cut = min(r[dim] for r in right)
        assert max(r[dim] for r in left) < cut
        whole, got = sum(r["size"] for r in part), sum(r["size"] for r in left)
        want = whole * (n // 2) / n
        edge = [sum(r["size"] for r in g if r[dim] == k) for g, k in ((left, max(r[dim] for r in left)), (right, cut))]  # a row that holds the median
        assert abs(got - want) <= max(10 * slack, *edge)
        check(left, n // 2)
        check(right, n - n // 2)

    check(rows, shards)
    assert sorted(seen) == list(range(shards))


def spread(rates, sizes):
    return sum(x * math.log(x) - x + 1 if x > 0 else 1 for x in rates)


def test_tilts_solve_the_dual(spark):
    """By bisection, and no other rates with the same words are nearer to one copy each."""
    r = random.Random(4)
    docs = {s: [int(math.exp(r.uniform(0, 5))) for _ in range(120)] for s in ("a", "b", None)}
    sizes = {s: sum(x) for s, x in docs.items()}
    targets = {"a": 1.6 * sizes["a"], "b": 0.3 * sizes["b"], None: 2.0 * sizes[None]}
    stats = spark.createDataFrame([(s, x) for s, xs in docs.items() for x in xs], "source string, size long").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    got = mixing.tilts(stats, sizes, targets, 2)
    assert got[None] == math.inf
    for s in ("a", "b"):
        unit = sum(x * x for x in docs[s]) / sizes[s]
        rate = lambda t, x: min(2.0, math.exp(min(50.0, t * x / unit)))
        low, high = -60.0, 60.0
        for _ in range(200):
            t = (low + high) / 2
            low, high = (t, high) if sum(x * rate(t, x) for x in docs[s]) < targets[s] else (low, t)
        assert got[s] == pytest.approx(low, rel=1e-5, abs=1e-6)
        best = [rate(got[s], x) for x in docs[s]]
        for _ in range(200):
            other = list(best)
            i, j = r.sample(range(len(other)), 2)
            step = r.uniform(-0.05, 0.05)
            other[i] += step / docs[s][i]
            other[j] -= step / docs[s][j]  # as many words
            if 0 <= min(other) and max(other) <= 2:
                assert spread(other, docs[s]) >= spread(best, docs[s]) - 1e-6


def test_mixing_and_fingerprints_of_null_ids_and_long_texts(spark):
    long = "word " * 300_000
    rows = [(None, "one two three", "a"), (None, "one two three", "a"), (1, long, "a"), (2, None, None), (3, long + "more", "b")]
    df = spark.createDataFrame(rows, DDL)
    mixed = mixing.mix(df).collect()
    assert len(mixed) == 5 and sorted(r.size for r in mixed) == [0, 3, 3, 300_000, 300_001] and all(0 <= r.taken <= 2 * r.size for r in mixed)
    near = simhash.near_duplicates(df).collect()
    assert len(near) == 5 and {r.component_id for r in near if r.doc_id in (1, 3)} == {1}
    assert {r.fp for r in near if r.doc_id is None} == {simhash.fingerprint("one two three") - (1 << 64 if simhash.fingerprint("one two three") >> 63 else 0)}
    shards = kd_shards.kd_shards(df, 3).collect()
    assert len(shards) == 5 and sum(r.doc_id is None for r in shards) == 2
