"""Inputs derived from the given tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage

_EVENTS = """
with b as (
  select event_id, user_id % 8 as led, cast(regexp_extract(props,'([0-9]+)',1) as bigint) as k, value,
    case event_type when 'click' then 'camera' when 'view' then 'microphone' when 'purchase' then 'bluetooth'
      when 'signup' then 'wifi' else case when event_id % 2 = 0 then 'camera' else 'thermal' end end as stream_id
  from events)"""
_MONO = """row_number() over (partition by led, stream_id order by event_id)
          + sum(case when k % 20 = 7 then 2 else 0 end) over (partition by led, stream_id order by event_id) as mono"""
_ITEMS = """
    event_id * 250000 + k * 1000 - case when event_id % 41 = 0 then 3000000 else 0 end as ts_us,
    concat('{"name":"j', cast(k % 5 as varchar(20)), '","x":', cast(k as varchar(20)), '.25,"y":0.5,"confidence":0.', cast(k as varchar(20)), '}') as j1,
    concat('{"confidence":1,"y":-', cast(k as varchar(20)), '.5,"x":2,"name":"é"}') as j2,
    concat('{"pseudonym":"ble:', md5(cast(k as varchar(20))), md5('a'), '","rssi":-', cast(k + 30 as varchar(20)), '}') as c1,
    concat('{"rssi":-4', cast(k % 10 as varchar(20)), '.5,"pseudonym":"ble:', md5('b'), md5(cast(k as varchar(20))), '"}') as c2"""
_ROWS = """
p as (
  select led, event_id, stream_id, cast(mono as bigint) as mono, ts_us, k, case when k = 99 then 2 else 1 end as schema_version,
    concat('m', cast(event_id as varchar(20))) as message_id,
    case stream_id
      when 'camera' then concat('{', case when k % 40 = 21 then '' else concat('"body_count":"', case when value < 15 then 'zero' when value < 90 then 'one' when value < 150 then 'two_or_more' else 'unknown' end, '",') end, '"joints":',
        case when k % 40 = 11 then concat('[', j1, ',{"name":"z","x":1,"y":1,"confidence":1,"z":1}]') when k % 40 = 12 then concat('[', j1, ',{"name":"n","x":"1","y":1,"confidence":1}]')
          when k % 40 = 14 then '[{"x":1,"y":1,"confidence":1}]' when k % 40 = 15 then '[{"name":7,"x":1,"y":1,"confidence":1}]' when k % 40 = 16 then '{}' when k % 40 = 17 then '[1,2]'
          when k % 40 = 18 then concat('[{"name":"', repeat('é', 65), '","x":1,"y":1,"confidence":1}]') when k % 40 = 19 then '[{"name":"n","x":1,"y":1,"confidence":null}]' when k % 40 = 20 then 'null'
          when k = 61 then concat('[', repeat(concat(j1, ','), 128), j1, ']') when k = 62 then concat('[', repeat(concat(j1, ','), 127), j1, ']')
          when k % 4 = 0 then '[]' when k % 4 = 1 then concat('[', j1, ']') when k % 4 = 2 then concat('[', j1, ',', j2, ']') else concat('[', j2, ',', j1, ',', j2, ']') end, case when k = 13 then ',"raw_frame":"x"' else '' end, '}')
      when 'microphone' then concat('{"voice_activity_probability":', cast(cast(least(value / 100.0, 1.2) as decimal(10,4)) as varchar(20)), ',"rms":', case when k % 40 = 22 then '"loud"' else cast(k as varchar(20)) end, ',"spectral_centroid_hz":', cast(k * 20 as varchar(20)), '}')
      when 'bluetooth' then concat('{"cluster_count":', case when k = 33 then '"2"' else cast(k % 7 as varchar(20)) end, ',"clusters":',
        case when k % 40 = 11 then concat('[', replace(c1, '}', ',"name":1}'), ']') when k % 40 = 12 then concat('[', c1, ',', replace(c1, 'ble:', 'ble:A'), ']') when k % 40 = 14 then concat('[', replace(replace(c1, '"rssi":-', '"rssi":"-'), '}', '"}'), ']')
          when k % 40 = 15 then '[{"rssi":-5}]' when k % 40 = 16 then '{}' when k % 40 = 17 then '[null]' when k % 40 = 18 then concat('[', replace(c1, 'ble:', 'bel:'), ']')
          when k = 61 then concat('[', repeat(concat(c1, ','), 128), c1, ']')
          when k % 4 = 0 then '[]' when k % 4 = 1 then concat('[', c1, ']') when k % 4 = 2 then concat('[', c1, ',', c2, ']') else concat('[', c2, ',', c1, ',', c2, ']') end, '}')
      when 'wifi' then concat('{"rssi_mean":-', cast(k as varchar(20)), ',"noise_mean":', case when k % 40 = 23 then 'true' else concat('-', cast(k + 20 as varchar(20))) end, ',"visible_network_count":', cast(k % 9 as varchar(20)), '}')
      else '{}' end as payload
  from m)
select led as ledger_id, event_id * 2 as arrival, schema_version, message_id, stream_id as sensor_stream_id, mono as monotonic_sequence, ts_us as captured_at_utc_us, payload from p
union all
select led, event_id * 2 + 21, schema_version, message_id, stream_id, mono, ts_us, payload from p where event_id % 25 = 0
"""
ENVELOPES = f"{_EVENTS},\nm as (\n  select *, {_MONO},{_ITEMS}\n  from b),{_ROWS}"

#: name -> (tables it reads, SQL)
VIEWS = {
    "capture_files": (("events",), """
select concat('capture/', event_type, '/', case when event_id % 11 = 0 then '' else cast(event_id as varchar(20)) end,
  case event_id % 8 when 0 then '.WAV' when 1 then '.png' when 2 then '.json' when 3 then '.tar.Mp4' when 4 then '.png.txt' when 5 then 'wav' when 6 then '.jpeg' else '.parquet' end) as path
from events"""),
    "envelopes": (("events",), ENVELOPES),
    "fusion_labels": (("events",), """
select user_id % 8 as ledger_id, event_id as line_no, event_id * 250000 + cast(regexp_extract(props,'([0-9]+)',1) as bigint) * 10000 - 500000 as ts_us, value > 50 as occupied
from events where event_id % 7 = 0"""),
    "lineage_nodes": (("lineitem", "orders", "customer", "nation", "region"), """
select concat('r:', cast(r_regionkey as varchar(20))) as id, 'region' as kind, 0 as sequence_class, cast(r_regionkey as bigint) as n from region
union all select concat('n:', cast(n_nationkey as varchar(20))), 'nation', 1, cast(n_nationkey as bigint) from nation
union all select concat('c:', cast(c_custkey as varchar(20))), 'customer', 2, cast(c_custkey as bigint) from customer
union all select concat('o:', cast(o_orderkey as varchar(20))), 'order', 3, cast(o_orderkey as bigint) from orders
union all select id, 'line', 4, n from (
  select concat('l:', cast(l_orderkey as varchar(20)), ':', cast(l_linenumber as varchar(20)), ':', cast(row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as varchar(20))) as id, cast(l_orderkey as bigint) * 8 + l_linenumber as n from lineitem) x"""),
    "lineage_edges": (("lineitem", "orders", "customer", "nation"), """
select concat('n:', cast(n_nationkey as varchar(20))) as derived_id, concat('r:', cast(n_regionkey as varchar(20))) as source_id, 0 as ordinal from nation
union all select concat('c:', cast(c_custkey as varchar(20))), concat('n:', cast(c_nationkey as varchar(20))), 0 from customer
union all select concat('o:', cast(o_orderkey as varchar(20))), concat('c:', cast(o_custkey as varchar(20))), 0 from orders
union all select id, source_id, 0 from (
  select concat('l:', cast(l_orderkey as varchar(20)), ':', cast(l_linenumber as varchar(20)), ':', cast(row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as varchar(20))) as id, concat('o:', cast(l_orderkey as varchar(20))) as source_id from lineitem) x"""),
    "chain_rows": (("events",), """
select user_id % 8 as ledger_id, event_id as sequence, concat('e', cast(event_id as varchar(20))) as id, props as payload from events"""),
    "retained_records": (("events",), """
select user_id % 8 as ledger_id, event_id as sequence, concat('e', cast(event_id as varchar(20))) as id,
  case event_type when 'click' then 'observation' when 'view' then 'belief' when 'purchase' then 'event' when 'signup' then 'episode' else 'sensor_gap' end as kind,
  event_id * 600000000 as recorded_us from events"""),
    "retained_edges": (("events",), """
select derived_id, source_id, 0 as ordinal from (
  select concat('e', cast(event_id as varchar(20))) as derived_id, concat('e', cast(event_id - 1 - event_id % 5 as varchar(20))) as source_id, event_type, event_id, min(event_id) over () as low from events) x
where event_type in ('view', 'signup') and event_id - 1 - event_id % 5 >= low"""),
    "audit_json": (("events", "conversations"), """
select concat('e', cast(event_id as varchar(20))) as id,
  case event_id % 50
    when 1 then concat('{"SSID":"x","p":', props, '}')
    when 2 then concat('{"a":{"mac_address":"00","p":', props, '}}')
    when 3 then concat('{"a":[{"b":1},{"raw_pcm":[1,2],"c":', props, '}]}')
    when 4 then concat('{"a":{"b":[{"c":{"Device_Name":{"ssid":1}}}]},"p":', props, '}')
    else concat('{"p":', props, ',"q":[1,{"r":null}]}') end as payload
from events
union all select concat('t', cast(conv_id as varchar(20)), ':', cast(turn as varchar(20))), concat('{"role":"', role, '","transcript":', cast(length(text) as varchar(20)), '}') from conversations"""),
    "wifi_hits": (("lineitem",), """
select l_orderkey as scan_id, -cast(floor(l_quantity) as int) as rssi, cast(l_linenumber as int) - 90 as noise from lineitem"""),
    "ble_hits": (("events",), """
select user_id as device, event_id * 250000 + cast(regexp_extract(props,'([0-9]+)',1) as bigint) * 1000 as ts_us, cast(-30 - cast(regexp_extract(props,'([0-9]+)',1) as bigint) as int) as rssi from events"""),
    "claims": (("orders",), """
select o_orderkey as claim_id, case o_custkey % 5 when 0 then 'archivist' when 1 then 'ethnographer' when 2 then 'skeptic' when 3 then 'cartographer' else 'poet' end as role,
  case o_orderkey % 4 when 0 then 'observed' when 1 then 'inferred' when 2 then 'interpreted' else 'imagined' end as layer from orders"""),
    "claim_evidence": (("lineitem",), """
select l_orderkey as claim_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as ordinal, concat('p', cast(l_partkey as varchar(20))) as evidence_id,
  case l_linenumber % 4 when 0 then 'observed' when 1 then 'inferred' when 2 then 'interpreted' else 'imagined' end as layer from lineitem"""),
}


#: How the views number lines that repeat an order and line number. Only how many repeat both shows in the numbers, so Spark counts them.
_REPEAT = "row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice)"
_BLOCK = 4096


def _sql(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], text: str) -> DataFrame:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"_src_{t}")
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 _src_{t}", text)
    return spark.sql(text)


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENVELOPES in steps: events are numbered once, by ledger and stream, then dealt evenly, so that payloads are made and checked
    by as many tasks as there are, not by a few that hold a ledger's stream each. What payloads are made of is written in
    between (few values, so small): the methods of both together are beyond the 8,000 bytes that the JVM compiles."""
    numbered = _sql(spark, sf_dir, ("events",), f"{_EVENTS} select *, {_MONO} from b")
    numbered.repartition("led", "event_id").createOrReplaceTempView("_numbered")
    cut_lineage(spark.sql(f"select *, {_ITEMS} from _numbered")).createOrReplaceTempView("_items")
    return spark.sql(f"with m as (select * from _items), {_ROWS}")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, n: the rows of lineitem counted, near keys together."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").repartitionByRange("l_orderkey")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


def _lineage(spark: SparkSession, sf_dir: str, name: str, counted: DataFrame | None) -> DataFrame:
    """A lineage view over counted lines, which are unfolded in blocks. No row is moved but by lines()."""
    tables, text = VIEWS[name]
    blocks = (lines(spark, sf_dir) if counted is None else counted).withColumn("_block", F.explode(F.expr(f"sequence(0L, (n - 1) div {_BLOCK})")))
    repeat = F.explode(F.expr(f"sequence(_block * {_BLOCK} + 1, least(n, (_block + 1) * {_BLOCK}))")).alias("_repeat")
    blocks.select("l_orderkey", "l_linenumber", repeat).createOrReplaceTempView("_lines")
    return _sql(spark, sf_dir, tuple(t for t in tables if t != "lineitem"), text.replace(_REPEAT, "_repeat").replace("from lineitem", "from _lines"))


def view(spark: SparkSession, sf_dir: str, name: str, counted: DataFrame | None = None) -> DataFrame:
    """A derived view as a DataFrame, over the tables in sf_dir; lineage views over what lines() counted, if that is given."""
    if name in ("lineage_nodes", "lineage_edges"):
        return _lineage(spark, sf_dir, name, counted)
    return _envelopes(spark, sf_dir) if name == "envelopes" else _sql(spark, sf_dir, *VIEWS[name])
