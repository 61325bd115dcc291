"""Envelope, ledger and label sources; append, export and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RAW_EXTENSIONS
from ..functions.scan import scan
from .shared import cut_lineage, shared_path

__all__ = ["append", "committed", "cut_lineage", "envelope_stream", "envelopes", "export", "labels", "ledger_scan", "media_paths", "numbered_lines", "raw_media", "shared_path", "write_batch", "write_report"]

ENVELOPE = "ledger_id long, arrival long, schema_version int, message_id string, sensor_stream_id string, monotonic_sequence long, captured_at_utc_us long, captured_at_mono_ns long, payload string"
LEDGER = "ledger_id long, sequence long, id string, kind string, payload string, previous_hash string, hash string"


def envelopes(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(ENVELOPE).format(kind).load(path)


def envelope_stream(spark: SparkSession, path: str, kind: str = "parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files).format(kind).load(path)


def ledger_scan(rows: DataFrame) -> DataFrame:
    """rows with payload parsed; what doesn't parse is a null payload."""
    return rows.withColumn("body", F.expr("try_parse_json(payload)"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line of text files, numbered in parallel.

    Files are read by byte ranges. The rows of a range are counted, and a file's ranges before it give its first number;
    inside a range a row's number is its distance from the range's first row, both in the order of reading.
    """
    file, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    rows = spark.read.option("lineSep", "\n").text(path).select(file, block, F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    ranges = cut_lineage(rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_low")))
    first = scan(ranges, ["file"], ["block"], F.floor(F.col("block") / (1 << 40)), {"_before": ("sum_before", F.col("n"))}).select("file", "block", "_low", "_before")
    numbered = rows.join(F.broadcast(first) if first.count() <= 200_000 else first, ["file", "block"])
    return numbered.select("file", (F.col("_before") + F.col("_at") - F.col("_low") + 1).alias("line_no"), "line")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """line_no, ts_us, occupied of JSON lines; blank lines are skipped, and a bad line fails with its number in its file."""
    text = numbered_lines(spark, path).where(F.col("line").rlike(r"\S")).withColumn("_body", F.expr("try_parse_json(line)"))
    ok = F.expr("schema_of_variant(try_variant_get(_body, '$.ts_us', 'variant')) = 'BIGINT' AND schema_of_variant(try_variant_get(_body, '$.occupied', 'variant')) = 'BOOLEAN'")
    bad = F.raise_error(F.concat(F.lit("invalid label at line "), F.col("line_no").cast("string")))
    return text.select(
        "line_no",
        F.when(F.coalesce(ok, F.lit(False)), F.expr("try_variant_get(_body, '$.ts_us', 'bigint')")).otherwise(bad.cast("long")).alias("ts_us"),
        F.expr("try_variant_get(_body, '$.occupied', 'boolean')").alias("occupied"),
    )


def write_batch(parts: dict[str, DataFrame], path: str, batch: str) -> bool:
    """The tables of parts under one batch id, then the mark by which readers take the batch. False, and nothing written, if it was
    committed before; what an attempt left without its mark is overwritten. So a batch that is replayed after a failure at
    any point counts once, in all tables or none."""
    spark = next(iter(parts.values())).sparkSession
    marks = _marks(spark, path)
    if marks is not None and marks.where(F.col("batch") == batch).take(1):
        return False
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/name={batch}")
    return True


def append(rows: DataFrame, edges: DataFrame, path: str, batch: str) -> None:
    """Ledger rows and their edges as one batch, see write_batch(); ids that committed batches hold are left out."""
    old = committed(rows.sparkSession, path, "events")
    fresh = rows if old is None else rows.join(old.select("ledger_id", "id"), ["ledger_id", "id"], "left_anti")
    fresh = cut_lineage(fresh)
    near = edges.join(fresh.select("ledger_id", F.col("id").alias("derived_id")), ["ledger_id", "derived_id"], "left_semi")
    write_batch({"events": fresh, "edges": near}, path, batch)


def _marks(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("batch string, name string").parquet(f"{path}/commits").select("batch")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def committed(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """Rows of committed batches, or None before the first."""
    marks = _marks(spark, path)
    if marks is None:
        return None
    rows = spark.read.parquet(f"{path}/{table}").withColumn("batch", F.col("batch").cast("string"))
    return rows.join(F.broadcast(marks) if marks.count() <= 100_000 else marks, "batch", "left_semi")


def export(bundle: DataFrame, path: str, name: str = "evidence.export.v1") -> None:
    """JSON records with a one-row manifest beside them."""
    bundle.write.mode("overwrite").json(f"{path}/records")
    bundle.agg(F.lit(name).alias("schema"), F.count(F.lit(1)).alias("records")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_report(report: DataFrame, path: str) -> None:
    """A calibration report or a retention plan as JSON records, null fields included."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def media_paths(files: DataFrame) -> DataFrame:
    """The rows of files (path) whose name ends in a raw-media ending, in either case; a name that is all ending has none."""
    return files.where(F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)).isin(*RAW_EXTENSIONS))


def raw_media(spark: SparkSession, path: str) -> DataFrame:
    """path of files whose ending names raw media, in either case; contents are not read. A missing folder has none."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "path string")
        raise
    return media_paths(files).orderBy("path")
