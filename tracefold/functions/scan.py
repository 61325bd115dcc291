"""Ordered state over a long key without one task for the whole key.

A plain window puts all rows of a ledger in one task. Here a chunk of rows is scanned by a window, one summary row a
chunk is scanned by a second window, and what a chunk inherits is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage

#: Rows of a key up to which one window for the key will do.
MOST_ROWS = 2_000_000
#: So many counted chunks are broadcast to their rows.
MOST_CHUNKS = 200_000
#: kind -> how a chunk's inheritance and its own value combine
KINDS = ("last", "max", "sum", "max_before", "sum_before", "last_before")


def fits(df: DataFrame, keys: list[str], most_rows: int = MOST_ROWS) -> bool:
    """Whether no key has more rows than one task's window should sort; counted, so df should be a table rather than a long plan."""
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= most_rows


def _plain(df: DataFrame, keys: list[str], order: list[str], values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy(*order)
    out = []
    for name, (kind, value) in values.items():
        over = ordered.rowsBetween(Window.unboundedPreceding, -1 if kind.endswith("_before") else 0)
        base = kind.removesuffix("_before")
        got = F.last(value, ignorenulls=True) if base == "last" else F.max(value) if base == "max" else F.sum(value)
        got = got.over(over)
        out.append((F.coalesce(got, F.lit(0)) if base == "sum" else got).alias(name))
    return df.select("*", *out)


def scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column, values: Mapping[str, tuple[str, Column]], small: bool | None = None, cut: bool = True) -> DataFrame:
    """df with one more column for each of values: name -> (kind, expression), in the order of unique `order` within keys.

    last skips nulls; the *_before kinds leave the row itself out. chunk must not fall along the order. Null keys are
    a key of their own. small says whether each key fits a task, where a plain window does; without it df is written
    to the shared folder and its rows are counted by key. Else df is cut too, since chunks and their summaries both read it,
    unless cut says that making it twice costs less.
    """
    if small is None:
        df = cut_lineage(df)
        small = fits(df, keys)
    if small:
        return _plain(df, keys, order, values)
    named = df.withColumn("_chunk", chunk)
    for name, (_, value) in values.items():
        named = named.withColumn(f"_v_{name}", value)
    named = cut_lineage(named) if cut else named
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    local, summary, carried = [], [], []
    over = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in values.items():
        v = F.col(f"_v_{name}")
        frame = before if kind.endswith("_before") else upto
        base = kind.removesuffix("_before")
        if base == "last":
            local.append(F.last(v, ignorenulls=True).over(frame).alias(f"_l_{name}"))
            summary.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_s_{name}"))
            carried.append(F.last(f"_s_{name}", ignorenulls=True).over(over).alias(f"_c_{name}"))
        else:
            f = F.max if base == "max" else F.sum
            local.append(f(v).over(frame).alias(f"_l_{name}"))
            summary.append(f(v).alias(f"_s_{name}"))
            carried.append(f(f"_s_{name}").over(over).alias(f"_c_{name}"))
    rows = named.select("*", *local)
    marks = [F.col(k).alias(f"_k_{k}") for k in keys]
    heads = cut_lineage(named.groupBy(*keys, "_chunk").agg(*summary).select(*marks, F.col("_chunk").alias("_k__chunk"), *carried))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_chunk"]])
    joined = rows.join(F.broadcast(heads) if heads.count() <= MOST_CHUNKS else heads, same)  # else planned before heads are known to be few, and rows moved twice
    out = []
    for name, (kind, _) in values.items():
        own, past = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind.startswith("last"):
            out.append(F.coalesce(own, past).alias(name))
        elif kind.startswith("max"):
            out.append(F.greatest(own, past).alias(name))
        else:
            out.append((F.coalesce(own, F.lit(0)) + F.coalesce(past, F.lit(0))).alias(name))
    return joined.select(*df.columns, *out)
