"""Gaps, as-of fusion and the ledger of accepted envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MODALITIES, Fusion, Ingest
from ..functions.columns import clamp, freshness
from ..functions.scan import fits, scan
from ..sources.shared import cut_lineage
from .validate import PARSE, accepted

KEYS = ["ledger_id", "sensor_stream_id"]


def _chunk(c: Ingest) -> Column:
    return F.floor(F.col("arrival") / c.chunk)


def with_gaps(accepted: DataFrame, c: Ingest = Ingest(), small: bool | None = None) -> DataFrame:
    """accepted with last_sequence, jump, silent and pending (after the row) of the row's stream; small as in scan().

    A jump (sequence over the largest earlier one plus 1) stores a gap row at the row's time before it, so it clears
    the pending flag and the row itself is not silent. A silence of more than silent_gap_us since the stream's
    previous arrival sets the flag, and it stays until a jump.
    """
    us = F.col("captured_at_utc_us")
    if small is None:
        accepted = cut_lineage(accepted)
        small = fits(accepted, KEYS)
    first = scan(accepted, KEYS, ["arrival"], _chunk(c), {"last_sequence": ("max_before", F.col("monotonic_sequence")), "_before": ("last_before", us)}, small)
    jump = F.coalesce(F.col("monotonic_sequence") > F.col("last_sequence") + 1, F.lit(False))
    silent = ~F.col("jump") & F.coalesce(us - F.col("_before") > c.silent_gap_us, F.lit(False))
    marked = first.withColumn("jump", jump).withColumn("silent", silent).withColumn("marker", F.when(F.col("jump"), False).when(F.col("silent"), True))
    out = scan(marked, KEYS, ["arrival"], _chunk(c), {"_pending": ("last", F.col("marker"))}, small)
    return out.withColumn("pending", F.coalesce("_pending", F.lit(False))).drop("_pending", "_before")


def gap_rows(gapped: DataFrame) -> DataFrame:
    """One row for each jump: gap:{stream}:{last}-{sequence}, at the row's time."""
    name = F.concat(F.lit("gap:"), "sensor_stream_id", F.lit(":"), F.col("last_sequence").cast("string"), F.lit("-"), F.col("monotonic_sequence").cast("string"))
    return gapped.where("jump").select("ledger_id", name.alias("id"), "sensor_stream_id", F.col("captured_at_utc_us").alias("ts_us"), "arrival", "last_sequence", "monotonic_sequence")


def gap_state(gapped: DataFrame) -> DataFrame:
    """Each stream's last time, largest sequence and pending flag at the end."""
    return gapped.groupBy(*KEYS).agg(F.max_by("captured_at_utc_us", "arrival").alias("last_ts_us"), F.max("monotonic_sequence").alias("max_sequence"), F.max_by("pending", "arrival").alias("pending"))


def acknowledged(gapped: DataFrame, streams: list[str] | None, ts_us: int) -> DataFrame:
    """Gap rows that an operator appends for pending streams, of those asked for or all: ids count them in stream order."""
    state = gap_state(gapped).where("pending")
    if streams is not None:
        state = state.where(F.col("sensor_stream_id").isin(*streams))
    index = F.row_number().over(Window.partitionBy("ledger_id").orderBy("sensor_stream_id")) - 1
    name = F.concat(F.lit("operator-gap-ack-"), "sensor_stream_id", F.lit(f"-{ts_us}-"), index.cast("string"))
    return state.select("ledger_id", name.alias("id"), "sensor_stream_id", F.lit(ts_us).cast("long").alias("ts_us"))


def asof(gapped: DataFrame, c: Ingest = Ingest(), small: bool | None = None) -> DataFrame:
    """gapped with the latest observation of each modality by append order, the row itself included, and whether it is pending; small as in scan().

    Signals are those of a column _signal, see signalled(), or else read from the payload."""
    stream = F.col("sensor_stream_id")
    row = F.struct(F.col("message_id").alias("id"), F.col("captured_at_utc_us").alias("ts_us"), F.col("_signal").alias("signal"))
    values = {m: ("last", F.when(stream == m, row)) for m in MODALITIES} | {f"{m}_pending": ("last", F.when(stream == m, F.col("marker"))) for m in MODALITIES}
    if "_signal" not in gapped.columns:
        gapped = gapped.withColumn("_body", F.expr(PARSE)).withColumn("_signal", signal(body="_body")).drop("_body")
    out = scan(gapped, ["ledger_id"], ["arrival"], _chunk(c), values, small).drop("_signal")
    for m in MODALITIES:
        out = out.withColumn(f"{m}_pending", F.coalesce(f"{m}_pending", F.lit(False)))
    return out


def signal(c: Fusion = Fusion(), body: str = PARSE) -> Column:
    """What the row itself says of presence, from 0 to 1; null if nothing."""
    s = F.col("sensor_stream_id")
    get = lambda path, kind: F.expr(f"try_variant_get({body}, '{path}', '{kind}')")
    count = get("$.body_count", "string")
    return (
        F.when(s == "camera", F.when(count == "zero", 0.0).when(count.isin("one", "two_or_more"), 1.0))
        .when(s == "microphone", clamp(get("$.voice_activity_probability", "double")))
        .when(s == "bluetooth", clamp(get("$.cluster_count", "double") / c.full_clusters))
    )


def signalled(envelopes: DataFrame, c: Ingest = Ingest(), payload: bool = True) -> DataFrame:
    """The accepted envelopes with _signal, read from the payload while it is parsed for validation. Without payload none
    is sorted, shuffled or written after that."""
    rows = accepted(envelopes, c, None, {"_signal": signal(body="_body")})
    return rows if payload else rows.drop("payload", "schema_version")


def fused(latest: DataFrame, c: Fusion = Fusion()) -> DataFrame:
    """latest with health, weight, probability, disagreement, confidence, modalities and state; probability is null without a belief.

    Each modality's freshness is a column of its own: spelled out wherever it is read, the stage's method grows beyond the
    8,000 bytes that the JVM compiles.
    """
    now = F.col("captured_at_utc_us")
    latest = latest.withColumns({f"_{m}_health": freshness(now, F.col(f"{m}.ts_us"), c.fresh_us) for m in MODALITIES})
    health = {m: F.col(f"_{m}_health") for m in MODALITIES}
    signals = {m: F.col(f"{m}.signal") for m in MODALITIES}
    zero = F.lit(0.0)
    weight = {m: F.when(signals[m].isNotNull(), c.weights[m] * health[m]).otherwise(zero) for m in MODALITIES}
    add = lambda xs: sum(xs[1:], xs[0])
    present = add([F.col(m).isNotNull().cast("int") for m in MODALITIES])
    out = latest.withColumn("modalities", add([signals[m].isNotNull().cast("int") for m in MODALITIES]))
    out = out.withColumn("health", add([F.coalesce(health[m], zero) for m in MODALITIES]) / F.nullif(present, F.lit(0)))
    out = out.withColumn("weight", add(list(weight.values())))
    out = out.withColumn("probability", F.when(F.col("modalities") > 0, add([F.coalesce(signals[m], zero) * weight[m] for m in MODALITIES]) / F.nullif(F.col("weight"), zero)))
    out = out.withColumn("disagreement", F.greatest(*signals.values()) - F.least(*signals.values()))
    out = out.withColumn("confidence", clamp(F.col("weight") * F.col("health") * (1.0 - 0.5 * F.col("disagreement"))))
    contested = (F.col("disagreement") > c.contested_over) | (F.col("health") < c.weak_health)
    return out.withColumn("state", F.when(contested, "contested").otherwise("stable")).drop(*[f"_{m}_health" for m in MODALITIES])


def beliefs(envelopes: DataFrame, ingest: Ingest = Ingest(), fusion: Fusion = Fusion()) -> DataFrame:
    """One belief for each accepted envelope for which no modality is pending and some signal has weight."""
    rows = cut_lineage(signalled(envelopes, ingest, payload=False))
    return believed(with_gaps(rows, ingest, fits(rows, KEYS)), ingest, fusion, fits(rows, ["ledger_id"]))


def believed(gapped: DataFrame, ingest: Ingest = Ingest(), fusion: Fusion = Fusion(), small: bool | None = None) -> DataFrame:
    """beliefs() of what with_gaps() found."""
    latest = fused(asof(gapped, ingest, small), fusion)
    clear = ~(F.col("camera_pending") | F.col("microphone_pending") | F.col("bluetooth_pending"))
    return latest.where(clear & (F.col("weight") != 0))  # where fused() finds a probability; shorter than asking for it


def belief_table(found: DataFrame) -> DataFrame:
    ids = F.filter(F.array(*[F.col(f"{m}.id") for m in MODALITIES]), lambda x: x.isNotNull())
    return found.select(
        "ledger_id", "arrival", F.concat(F.lit("belief:"), "message_id").alias("id"), F.col("message_id").alias("source_observation_id"), F.col("captured_at_utc_us").alias("ts_us"),
        "probability", "confidence", "disagreement", "modalities", "health", "state", ids.alias("derived_from"),
    )


def evidence_edges(belief: DataFrame) -> DataFrame:
    """(ledger_id, derived_id, source_id, ordinal) of beliefs, in the order of the modalities."""
    return belief.select("ledger_id", F.col("id").alias("derived_id"), F.posexplode("derived_from").alias("ordinal", "source_id")).select("ledger_id", "derived_id", "source_id", "ordinal")


def entries(gapped: DataFrame, belief: DataFrame) -> DataFrame:
    """ledger()'s rows before they are numbered, for what reads no sequence: their order is (arrival, part). The payload is null where gapped has none."""
    none = F.lit(None)
    gaps = gap_rows(gapped).select("ledger_id", "arrival", F.lit(0).alias("part"), "id", F.lit("sensor_gap").alias("kind"), F.col("sensor_stream_id").alias("stream_id"), "ts_us", none.cast("string").alias("payload"), none.cast("double").alias("probability"))
    extra = none.cast("string") if "payload" not in gapped.columns else F.concat(F.expr("substr(payload, 1, length(payload) - 1)"), F.when(F.regexp_like("payload", F.lit(r"^\{\s*\}$")), "").otherwise(","), F.lit('"_monotonic_sequence":'), F.col("monotonic_sequence").cast("string"), F.lit("}"))
    observed = gapped.select("ledger_id", "arrival", F.lit(1).alias("part"), F.col("message_id").alias("id"), F.lit("observation").alias("kind"), F.col("sensor_stream_id").alias("stream_id"), F.col("captured_at_utc_us").alias("ts_us"), extra.alias("payload"), none.cast("double").alias("probability"))
    believed = belief.select("ledger_id", "arrival", F.lit(2).alias("part"), "id", F.lit("belief").alias("kind"), F.lit("fusion").alias("stream_id"), "ts_us", none.cast("string").alias("payload"), "probability")
    return gaps.unionByName(observed).unionByName(believed)


def ledger(gapped: DataFrame, belief: DataFrame, c: Ingest = Ingest()) -> DataFrame:
    """The append-only table: for each accepted envelope its gap row, itself and its belief, densely numbered by ledger from 0."""
    out = scan(entries(gapped, belief), ["ledger_id"], ["arrival", "part"], _chunk(c), {"sequence": ("sum_before", F.lit(1).cast("long"))})
    return out.drop("arrival", "part")


def recent(entry: DataFrame, n: int, among: str = "true", c: Ingest = Ingest()) -> DataFrame:
    """The rows of ledger(), from entries() of any columns, that follow or are one of each ledger's n newest for which among holds.

    Only these are numbered, backwards from the count of a ledger's rows: the others are neither sorted nor shuffled."""
    entry = cut_lineage(entry)
    newest = Window.partitionBy("ledger_id").orderBy(F.desc("arrival"), F.desc("part"))
    top = entry.where(among).select("ledger_id", "arrival", "part", F.row_number().over(newest).alias("_n")).where(F.col("_n") <= n)
    low = top.groupBy(F.col("ledger_id").alias("_l")).agg(F.min(F.struct("arrival", "part")).alias("_low"))
    total = entry.groupBy(F.col("ledger_id").alias("_t")).agg(F.count(F.lit(1)).alias("_rows"))
    ends = cut_lineage(low.join(total, F.col("_l").eqNullSafe(F.col("_t"))).drop("_t"))  # a row a ledger
    tail = entry.join(ends, F.col("ledger_id").eqNullSafe(F.col("_l"))).where(F.struct("arrival", "part") >= F.col("_low"))
    back = tail.withColumns({"_a": -F.col("arrival"), "_p": -F.col("part")})
    out = scan(back, ["ledger_id"], ["_a", "_p"], F.floor(F.col("_a") / c.chunk), {"_after": ("sum_before", F.lit(1).cast("long"))})
    return out.withColumn("sequence", F.col("_rows") - 1 - F.col("_after")).drop("arrival", "part", "_l", "_low", "_rows", "_a", "_p", "_after")


def fallback_belief(telemetry: DataFrame, c: Fusion = Fusion()) -> DataFrame:
    """A belief without freshness from camera_presence, audio_vad and bluetooth_cluster_count; nothing known gives 0.5 and unknown."""
    signals = {"camera": F.col("camera_presence"), "microphone": clamp(F.col("audio_vad")), "bluetooth": clamp(F.col("bluetooth_cluster_count") / c.full_clusters)}
    weight = sum([F.when(s.isNotNull(), c.weights[m]).otherwise(0.0) for m, s in signals.items()], F.lit(0.0))
    total = sum([F.coalesce(s, F.lit(0.0)) * c.weights[m] for m, s in signals.items()], F.lit(0.0))
    spread = F.greatest(*signals.values()) - F.least(*signals.values())
    known = weight > 0
    return telemetry.select(
        "*",
        F.when(known, total / weight).otherwise(0.5).alias("probability"),
        F.when(known, clamp(weight * (1.0 - 0.5 * spread))).otherwise(0.0).alias("confidence"),
        F.when(known, spread).otherwise(1.0).alias("disagreement"),
        sum([s.isNotNull().cast("int") for s in signals.values()], F.lit(0)).alias("modalities"),
        F.when(~known, "unknown").when(spread > c.contested_over, "contested").otherwise("stable").alias("state"),
    )


def anchor_downgrade(divergence: Column, confidence: Column, threshold: float) -> Column:
    return F.when(divergence >= threshold, F.least(confidence, F.lit(0.2))).otherwise(confidence)
