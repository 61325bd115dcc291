"""Validation of envelopes: predicates, and one reject reason for a row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALLOWED_KEYS, Ingest

#: The payload as a variant. Checks take the name of a column that holds it, so that a row is parsed once for all of them.
PARSE = "try_parse_json(payload)"
#: How the types that count as numbers begin.
NUMBER = "'BIG', 'DOU', 'FLO', 'DEC'"


def version_ok(c: Ingest = Ingest()) -> Column:
    return F.coalesce(F.col("schema_version") == c.schema_version, F.lit(False))


def message_id_ok(c: Ingest = Ingest()) -> Column:
    return F.coalesce(F.octet_length("message_id").between(1, c.most_id_bytes), F.lit(False))


def size_ok(c: Ingest = Ingest()) -> Column:
    return F.coalesce(F.octet_length("payload") <= c.most_payload_bytes, F.lit(False))


def json_ok(body: str = PARSE) -> Column:
    return F.expr(body).isNotNull()


def object_ok(body: str = PARSE) -> Column:
    return F.coalesce(F.expr(body).isNotNull() & F.regexp_like("payload", F.lit(r"^[ \t\r\n]*\{")), F.lit(False))


def stream_ok() -> Column:
    return F.coalesce(F.col("sensor_stream_id").isin(*ALLOWED_KEYS), F.lit(False))


def offending_key(body: str | None = None) -> Column:
    """The first key, by code point, that the row's stream may not carry; null if all are allowed. body spares reading the payload again."""
    allowed = F.create_map(*[x for s, keys in ALLOWED_KEYS.items() for x in (F.lit(s), F.array(*map(F.lit, keys)))])
    keys = F.coalesce(F.json_object_keys("payload") if body is None else F.expr(f"map_keys({_object(body)})"), F.array().cast("array<string>"))
    return F.array_min(F.array_except(keys, F.coalesce(F.try_element_at(allowed, F.col("sensor_stream_id")), F.array().cast("array<string>"))))


def _variant(body: str, path: str) -> str:
    return f"try_variant_get({body}, '{path}', 'variant')"


def _object(variant: str) -> str:
    """The fields of an object, null for other types; unlike schema_of_variant it does not look into them."""
    return f"try_variant_get({variant}, '$', 'map<string,variant>')"


def _items(body: str, path: str, keys: tuple[str, ...], item: str, most: int) -> str:
    """Absent, or an array of at most `most` objects with no other keys, each satisfying item (over j)."""
    listed = ", ".join(f"'{k}'" for k in keys)
    array = f"try_variant_get({body}, '{path}', 'array<variant>')"
    ok = f"coalesce(size(array_except(map_keys({_object('j')}), array({listed}))) = 0 AND {item}, false)"
    return f"coalesce(forall(array({array}), list -> size(list) <= {most} AND forall(list, j -> {ok})), {_variant(body, path)} IS NULL)"  # one list in an array, so that it is made once


def _numeric(variant: str, key: str) -> str:
    return f"substr(schema_of_variant(try_variant_get({variant}, '$.{key}', 'variant')), 1, 3) IN ({NUMBER})"


def camera_ok(c: Ingest = Ingest(), body: str = PARSE) -> Column:
    joint = f"octet_length(try_variant_get(j, '$.name', 'string')) <= {c.most_string_bytes} AND schema_of_variant(try_variant_get(j, '$.name', 'variant')) = 'STRING' AND " + " AND ".join(_numeric("j", k) for k in ("x", "y", "confidence"))
    count = f"try_variant_get({body}, '$.body_count', 'string') IN ('zero', 'one', 'two_or_more', 'unknown')"
    return F.coalesce(F.expr(f"{count} AND {_items(body, '$.joints', ('name', 'x', 'y', 'confidence'), joint, c.most_items)}"), F.lit(False))


def numeric_ok(stream: str, body: str = PARSE) -> Column:
    return F.coalesce(F.expr(" AND ".join(f"({_variant(body, '$.' + k)} IS NULL OR {_numeric(body, k)})" for k in ALLOWED_KEYS[stream])), F.lit(False))


def bluetooth_ok(c: Ingest = Ingest(), body: str = PARSE) -> Column:
    cluster = f"try_variant_get(j, '$.pseudonym', 'string') RLIKE '^ble:[0-9a-f]{{64}}$' AND {_numeric('j', 'rssi')}"
    count = f"({_variant(body, '$.cluster_count')} IS NULL OR {_numeric(body, 'cluster_count')})"
    return F.coalesce(F.expr(f"{count} AND {_items(body, '$.clusters', ('pseudonym', 'rssi'), cluster, c.most_items)}"), F.lit(False))


def shape_ok(c: Ingest = Ingest(), body: str = PARSE) -> Column:
    s = F.col("sensor_stream_id")
    return F.when(s == "camera", camera_ok(c, body)).when(s == "bluetooth", bluetooth_ok(c, body)).when(s == "microphone", numeric_ok("microphone", body)).when(s == "wifi", numeric_ok("wifi", body)).otherwise(False)


def reject_reason(c: Ingest = Ingest(), body: str = PARSE) -> Column:
    """The first failed check in their fixed order, or null."""
    return (
        F.when(~version_ok(c), "version")
        .when(~message_id_ok(c), "message_id")
        .when(~size_ok(c), "size")
        .when(~json_ok(body), "json")
        .when(~stream_ok(), "stream")
        .when(~object_ok(body), "shape")
        .when(offending_key(body).isNotNull(), "field")
        .when(~shape_ok(c, body), "shape")
    )


def classified(envelopes: DataFrame, c: Ingest = Ingest(), persisted: DataFrame | None = None, also: Mapping[str, Column] | None = None) -> DataFrame:
    """envelopes with status: accepted, duplicate, or a reject reason; also names columns that are read from the payload's variant _body on the way.

    The first valid arrival of an id is accepted. What arrives later under that id, valid or not, is a duplicate and
    no reject, unless its version or id is bad. persisted (ledger_id, id) holds ids that were stored before.
    """
    reasoned = envelopes.withColumn("_body", F.expr(PARSE)).withColumn("reason", reject_reason(c, "_body")).withColumns(dict(also or {})).drop("_body")
    first = F.min(F.when(F.col("reason").isNull(), F.col("arrival"))).over(Window.partitionBy("ledger_id", "message_id"))
    out = reasoned.withColumn("_first", first)
    old = F.lit(False)
    if persisted is not None:
        known = persisted.select(F.col("ledger_id").alias("_l"), F.col("id").alias("_m"), F.lit(True).alias("_old")).distinct()
        out = out.join(known, F.col("ledger_id").eqNullSafe(F.col("_l")) & (F.col("message_id") == F.col("_m")), "left").drop("_l", "_m")
        old = F.coalesce(F.col("_old"), F.lit(False))
    status = F.when(F.col("reason").isin("version", "message_id"), F.col("reason")).when(old | (F.col("_first") < F.col("arrival")), "duplicate").otherwise(F.coalesce("reason", F.lit("accepted")))
    return out.withColumn("status", status).select(*envelopes.columns, *(also or ()), "status")


def accepted(envelopes: DataFrame, c: Ingest = Ingest(), persisted: DataFrame | None = None, also: Mapping[str, Column] | None = None) -> DataFrame:
    return classified(envelopes, c, persisted, also).where("status = 'accepted'").drop("status")
