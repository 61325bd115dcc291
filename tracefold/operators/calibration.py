"""Scoring beliefs against labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SECOND
from ..sources.shared import cut_lineage


#: Time that one task matches at once, at least; its points are those of a ledger in that time and max_offset_us around it.
SLOT_US = 60 * SECOND
#: Slots of sparse points are joined until they hold up to so many beliefs or labels, so that their number doesn't grow with idle time.
MOST_POINTS = 20_000


class _Free:
    """Places in a row of which some are taken: the nearest that is left on one side, in nearly constant time."""

    def __init__(self, n: int) -> None:
        self.after = list(range(n + 1))

    def __call__(self, at: int) -> int:
        """The first place from at that is left; n if none."""
        after = self.after
        while after[at] != at:
            after[at] = after[after[at]]
            at = after[at]
        return at

    def take(self, at: int) -> None:
        self.after[at] = at + 1


def _propose(max_offset_us: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Proposals (a label each) of a slot's free labels, in file order.

        A label goes to the nearest belief, the earliest in ledger order of equally near ones, that no earlier label holds or proposes to here. Beliefs only ever pass to earlier labels, so those that were passed over stay lost to it."""
        beliefs = rows[rows.part == 0]
        ts, place = beliefs.ts_us.to_numpy(np.int64), beliefs.place.to_numpy(np.int64)
        holder = beliefs.holder.to_numpy(np.int64)
        n = len(ts)
        forth, back = np.lexsort((place, ts)), np.lexsort((place, -ts))  # from early to late, and from late to early
        where = np.empty((2, n), np.int64)
        where[0, forth], where[1, back] = np.arange(n), np.arange(n)
        late, early = _Free(n), _Free(n)
        ahead, behind = ts[forth], -ts[back]
        held = np.argsort(holder, kind="stable")
        gone, out = 0, []

        def take(i: int) -> None:
            late.take(int(where[0, i]))
            early.take(int(where[1, i]))

        labels = rows[rows.part == 1].sort_values("place")
        at_or_after = np.searchsorted(ahead, labels.ts_us.to_numpy(np.int64), "left")
        before = np.searchsorted(behind, -labels.ts_us.to_numpy(np.int64), "right")
        for label, a, b in zip(labels.itertuples(), at_or_after.tolist(), before.tolist()):
            while gone < n and holder[held[gone]] < label.place:  # held by earlier labels
                take(int(held[gone]))
                gone += 1
            near = [int(order[i]) for order, i in ((forth, late(a)), (back, early(b))) if i < n]
            best = min(((abs(int(ts[i]) - int(label.ts_us)), int(place[i]), i) for i in near), default=(max_offset_us + 1, 0, 0))
            if best[0] <= max_offset_us:
                i = best[2]
                out.append((label.ledger_id, label.place, int(label.ts_us), bool(label.occupied), int(place[i])))
                take(i)
        return pd.DataFrame(out, columns=["ledger_id", "line_no", "label_us", "occupied", "sequence"])

    return run


def slot_width(points: list[DataFrame], width: int, most_points: int = MOST_POINTS) -> int:
    """The multiple of width at which no ledger's slot holds over most_points of any of points (ledger_id, ts_us), if width is no longer too much itself."""
    most = [p.groupBy("ledger_id", F.floor(F.col("ts_us") / width)).count().agg(F.max("count")).first()[0] or 1 for p in points]
    return width * max(1, most_points // max(most))


def matched(sample: DataFrame, labels: DataFrame, max_offset_us: int = SECOND // 2, slot_us: int = SLOT_US) -> DataFrame:
    """ledger_id, line_no, sequence, p, occupied: each label's belief, one to one, as if labels chose one after another in file order.

    All free labels propose at once, slot of time by slot, each to the nearest belief in reach that no earlier label holds; a
    belief keeps the earliest of its labels, and labels that it turns away or gives up propose again, until none is
    free. The earliest label wins everywhere, so the outcome is that of choosing in turn, whatever the order of proposals. After the
    first round only labels that two slots fought over are left. A task holds the points of slot_us (or twice the offset, if more),
    or of more time where points are sparse, and of the offset around it, not of a whole run of dense points.
    """
    if max_offset_us < 0:
        raise ValueError("the window must not be negative")
    width = max(slot_us, 2 * max_offset_us, 1)
    by = ["ledger_id", "sequence"]
    nobody = F.lit((1 << 63) - 1)
    beliefs = cut_lineage(sample.select("ledger_id", "ts_us", "sequence", "p"))
    held = None  # beliefs that have a holder: ledger_id, sequence, line_no, label_us, occupied
    free = cut_lineage(labels.select("ledger_id", "line_no", F.col("ts_us").alias("label_us"), "occupied"))
    width = slot_width([beliefs, free.select("ledger_id", F.col("label_us").alias("ts_us"))], width)
    reach = F.explode(F.sequence(F.floor((F.col("ts_us") - max_offset_us) / width), F.floor((F.col("ts_us") + max_offset_us) / width))).alias("slot")
    while True:
        asked = free.select("ledger_id", F.floor(F.col("label_us") / width).alias("slot"), F.col("label_us").alias("ts_us"), F.lit(1).alias("part"), F.col("line_no").alias("place"), nobody.alias("holder"), "occupied")
        now = beliefs.select("ledger_id", "ts_us", "sequence") if held is None else beliefs.select("ledger_id", "ts_us", "sequence").join(held.select(*by, F.col("line_no").alias("holder")), by, "left")
        offered = now.select("ledger_id", reach, "ts_us", F.lit(0).alias("part"), F.col("sequence").alias("place"), nobody.alias("holder") if held is None else F.coalesce("holder", nobody).alias("holder"), F.lit(None).cast("boolean").alias("occupied"))
        offered = offered.join(asked.select("ledger_id", "slot").distinct(), ["ledger_id", "slot"], "left_semi")
        rows = asked.unionByName(offered).groupBy("ledger_id", "slot").applyInPandas(_propose(max_offset_us), "ledger_id long, line_no long, label_us long, occupied boolean, sequence long")
        proposed = cut_lineage(rows)
        if proposed.isEmpty():
            break
        every = proposed if held is None else proposed.unionByName(held.select(*proposed.columns))
        won = every.groupBy(*by).agg(F.min(F.struct("line_no", "label_us", "occupied")).alias("w")).select(*by, "w.*")
        won = cut_lineage(won)
        free = cut_lineage(every.join(won.select("ledger_id", "line_no", "sequence"), ["ledger_id", "line_no", "sequence"], "left_anti").select("ledger_id", "line_no", "label_us", "occupied"))
        held = won
        if free.isEmpty():
            break
    if held is None:
        held = free.select("ledger_id", nobody.alias("sequence"), "line_no", "label_us", "occupied").limit(0)
    return held.join(beliefs.select(*by, "p"), by).select("ledger_id", "line_no", "sequence", "p", "occupied")


def metrics(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, brier, precision, recall of (p, occupied); an empty denominator gives 0."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    rows = pairs.select(*(by or []), p.alias("p"), (p >= 0.5).alias("said"), F.col("occupied"))
    n = lambda c: F.sum(c.cast("long"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hit = n(F.col("said") & F.col("occupied"))
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        share(n(F.col("said") == F.col("occupied")), F.count(F.lit(1))).alias("accuracy"),
        share(F.sum((F.col("p") - F.col("occupied").cast("double")) ** 2), F.count(F.lit(1))).alias("brier"),
        share(hit, n(F.col("said"))).alias("precision"),
        share(hit, n(F.col("occupied"))).alias("recall"),
    )


def report(pairs: DataFrame, labels: DataFrame, max_offset_us: int) -> DataFrame:
    """metrics with labels, matched, unmatched and the offset, by ledger."""
    totals = labels.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("labels"))
    found = metrics(pairs, ["ledger_id"]).withColumnRenamed("n", "matched")
    out = totals.join(found, "ledger_id", "left").fillna(0, ["matched", "accuracy", "brier", "precision", "recall"])
    return out.withColumn("unmatched", F.col("labels") - F.col("matched")).withColumn("max_offset_us", F.lit(max_offset_us).cast("long"))
