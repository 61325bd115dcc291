"""Privacy audit of JSON records and reduction of raw Wi-Fi scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FORBIDDEN_KEYS
from ..sources.tables import cut_lineage


def audit(records: DataFrame, most_depth: int = 128) -> DataFrame:
    """id, path of every key, at any depth, whose lower-cased name is forbidden. Payloads that don't parse have none.

    Only records whose text holds such a name or an escape, which may spell one, are opened. Each round opens one level
    of all of them at once; a hit is opened too. Of these, records deeper than most_depth fail."""
    spark = records.sparkSession
    suspect = records.where(F.regexp_like("payload", F.lit("(?i)" + "|".join(FORBIDDEN_KEYS) + r"|\\u")))
    level = suspect.select("id", F.lit("$").alias("path"), F.expr("try_parse_json(payload)").alias("v"))
    hits = None
    for _ in range(most_depth):
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = opened.select("id", F.concat("path", F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))).alias("path"), "key", F.col("value").alias("v"))
        step = cut_lineage(step.select("id", "path", "key", F.expr("to_json(v)").alias("text"), F.expr("schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'").alias("inner")))
        found = step.where(F.lower("key").isin(*FORBIDDEN_KEYS)).select("id", "path")
        hits = found if hits is None else hits.unionByName(found)
        deeper = step.where("inner")
        if deeper.isEmpty():
            return hits
        level = deeper.select("id", "path", F.expr("parse_json(text)").alias("v"))
    raise RuntimeError(f"a record is deeper than {most_depth}")


def wifi_mode_a(hits: DataFrame, scans: DataFrame | None = None, missing: int | None = -(2**31)) -> DataFrame:
    """scan_id with mean rssi and noise, count and the three strongest; scans lists scans that may have no hits.

    The three strongest come from a bounded aggregation, so a wide scan is never one array."""
    rows = hits.groupBy("scan_id").agg(F.avg("rssi").alias("rssi_mean"), F.avg("noise").alias("noise_mean"), F.count(F.lit(1)).alias("visible_network_count"))
    from pyspark.sql import Window

    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("rssi")))).where("n <= 3")
    top = first.groupBy("scan_id").agg(*[F.max(F.when(F.col("n") == i, F.col("rssi"))).alias(f"strongest_{i}") for i in (1, 2, 3)])
    out = rows.join(top, "scan_id")
    out = out if scans is None else scans.select("scan_id").distinct().join(out, "scan_id", "left").fillna(0, ["rssi_mean", "noise_mean", "visible_network_count"])
    return out if missing is None else out.fillna(missing, ["strongest_1", "strongest_2", "strongest_3"])
