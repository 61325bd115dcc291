"""Mixing sources to target weights by entropy balancing (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty, written

#: The dual has one variable for each source; more sources than this are refused.
MOST_SOURCES = 100_000


def target_tokens(sizes: dict[str | None, int], weights: tuple[int, ...], share: float, most: float) -> dict[str | None, float]:
    """Tokens wanted from each source: weights repeat over sources by code point (null last) and share the whole;
    a source stops at most times its size and the excess is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, left = set(order), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > most * sizes[s]}
        if not full:
            out |= {s: weight[s] * unit for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def tilts(stats: DataFrame, sizes: dict, targets: dict, most: float, exact: float = 1e-7, most_steps: int = 200) -> dict:
    """The dual variables: source -> tilt t with sum of size * min(most, exp(t * size / unit)) = target.

    Minimising the relative entropy of the documents' rates against one copy each, under the token constraints and
    the bound most, gives exponentially tilted rates. The dual is separable and convex; each step sums gradient and
    curvature over the (source, size, n) table in executors, for all sources at once. A Newton step that leaves the
    bracket is halved into it, and the bracket widens where a tilt nears its end. A source at its bound gets an infinite
    tilt, one of size 0 gets 0. A source that doesn't settle fails the job.
    """
    spark = stats.sparkSession
    tilt = {s: 0.0 if sizes[s] == 0 else math.inf if targets[s] >= most * sizes[s] * (1 - 1e-12) else None for s in sizes}
    unit = {r.source: r.unit for r in stats.groupBy("source").agg(F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size")), F.sum(F.col("n") * F.col("size"))).alias("unit")).collect()}
    live = {s: [0.0, -60.0, 60.0] for s, t in tilt.items() if t is None}
    step = 0
    while live and step < most_steps:
        step += 1
        now = _table(spark, [(s, x[0], float(unit[s])) for s, x in live.items()], "s string, t double, unit double")
        c = F.col("size") / F.col("unit")
        rate = F.least(F.exp(F.least(F.col("t") * c, F.lit(50.0))), F.lit(float(most)))
        sums = (
            stats.join(now, F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.when(rate < most, F.col("n") * F.col("size") * c * rate).otherwise(0.0)).alias("slope"))
            .collect()
        )
        for r in sums:
            t, low, high = live[r.source]
            off = r.got - targets[r.source]
            if abs(off) <= exact * max(1.0, targets[r.source]) or high - low < 1e-13:
                tilt[r.source] = t
                del live[r.source]
                continue
            low, high = (t, high) if off < 0 else (low, t)
            if off < 0 and high >= 60.0 and t > 30.0:
                high *= 1e3
            if off > 0 and low <= -60.0 and t < -30.0:
                low *= 1e3
            new = t - off / r.slope if r.slope > 0 else math.inf
            live[r.source] = [new if low < new < high else (low + high) / 2, low, high]
    if live:
        raise RuntimeError(f"{len(live)} sources did not settle in {most_steps} steps")
    return tilt


def turn_bin(turn: Column, bins: int) -> Column:
    """A bin that rises with turn: bins of them to a unit up to 4 and to a doubling beyond, so that a source whose
    fractions are small, and turns long, is spread like any other."""
    return F.when(turn < 4, F.floor(turn * bins)).otherwise(4 * bins + F.floor(F.log2(turn / 4) * bins))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies.

    size counts words (null text: 0). A document's rate is exponentially tilted by its size; its whole part gives
    copies, and of the rest as many further copies are taken, in the order hash(doc_id) / fraction, as the source's
    target leaves room for; the document at the end gives only the words that still fit, so a source's taken words
    equal its target rounded. copies are whole ones, with that last document's taken if it is at least half. Documents
    without words keep one copy (two in a source at its bound). Null ids hash alike; equal ids and ties are ordered by
    size. A rerun gives the same. Null is a source of its own. An empty table gives no rows. Very long texts are counted
    whole and may be taken in part; only the id, the text and the source are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size")),
        "sizes",
    )
    stats = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "stats")
    totals = stats.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["source"]: r["size"] for r in totals}
    targets = target_tokens(sizes, weights, share, most)
    tilt = tilts(stats, sizes, targets, most)
    unit = {r.source: r.unit for r in stats.groupBy("source").agg(F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size")), F.sum(F.col("n") * F.col("size"))).alias("unit")).collect()}
    given = _table(spark, [(s, float(min(tilt[s], 1e300)), float(unit[s] or 1.0), sizes[s], targets[s]) for s in sizes], "s string, t double, unit double, source_size long, target double")
    power = F.col("t") * F.col("size") / F.col("unit")
    rate = F.when(F.col("t") >= 1e300, F.lit(float(most))).otherwise(F.least(F.exp(F.least(power, F.lit(50.0))), F.lit(float(most))))
    rated = rows.join(given, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate)
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("rest", F.col("rate") - F.floor("rate"))
    u = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 48)) + 0.5) / float(1 << 48)
    n_docs = sum(r["n"] for r in stats.groupBy().agg(F.sum("n").alias("n")).collect() if r["n"])
    bins = max(64, n_docs // 20_000)
    rated = rated.withColumn("turn", F.when((F.col("rest") > 0) & (F.col("size") > 0), u / F.col("rest"))).withColumn("bin", turn_bin(F.col("turn"), bins))
    asked = rated.where("turn IS NOT NULL").groupBy("source", "bin").agg(F.sum("size").alias("w"))
    base = rated.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("base"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = base.select(F.col("source").alias("s2"), "base")
    before = asked.withColumn("before", F.coalesce(F.sum("w").over(run), F.lit(0))).join(bases, F.col("source").eqNullSafe(F.col("s2"))).select(F.col("source").alias("s3"), F.col("bin").alias("bin3"), (F.col("before") + F.col("base")).alias("before"))
    inside = Window.partitionBy("source", "bin").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    turned = rated.where("turn IS NOT NULL").withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    turned = turned.join(before, F.col("source").eqNullSafe(F.col("s3")) & (F.col("bin") == F.col("bin3"))).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - F.col("before") - F.col("ahead"))))
    out = ["doc_id", "size", "source_size", "target", "whole", "extra"]
    plain = rated.where("turn IS NULL").withColumn("extra", F.lit(0).cast("long"))
    return turned.select(*out).unionByName(plain.select(*out)).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("whole") + F.col("extra")).cast("long").alias("taken"),
        (F.col("whole") + F.when((F.col("extra") > 0) & (F.col("extra") * 2 >= F.col("size")), 1).otherwise(0)).cast("int").alias("copies"),
    )
