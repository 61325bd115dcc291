"""Registered queries against their DuckDB SQL on the smallest tables."""

import os
import re
import sys

import duckdb
import pytest

from tracefold.plans import oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
SOME = ["ingest_rejects", "ledger_build", "fusion_beliefs", "fusion_evidence", "occupancy_sessions", "episodes", "session_evidence", "chain_build", "range_erase", "retention_plan", "privacy_audit", "pseudonymize", "audio_features", "ble_windows", "wifi_mode_a", "role_violations", "density_histogram", "validate_camera", "validate_bluetooth", "telemetry", "latest_joints", "calibration_match", "calibration_report_sink", "chain_verify_heads", "chain_verify_tree", "erase_tree", "erase_compact", "retention_apply", "label_scan"]


def test_every_query_has_sql():
    assert set(oracles.ORACLES) == set(queries.QUERIES)


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 5) if isinstance(value, (int, float)) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got, want = queries.QUERIES[name](spark, SF), con.sql(oracles.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = lambda xs: sorted((tuple(map(plain, x)) for x in xs), key=str)
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["ledger_counts", "session_evidence"])
def test_envelopes_are_validated_once(spark, monkeypatch, name):
    calls, check = [], queries.validate.accepted
    for module in (queries.validate, queries.ingest):
        monkeypatch.setattr(module, "accepted", lambda *a: calls.append(1) or check(*a))
    assert queries.QUERIES[name](spark, SF).count() >= 0 and len(calls) == 1


def test_methods_of_fusion_are_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes, which made fusion six times slower."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = queries.cut_lineage(queries.ingest.with_gaps(queries.env(spark, SF).limit(100)))
        made = queries.ingest.belief_table(queries.ingest.believed(found, small=True))
        text = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000


def test_validation_writes_no_text_and_no_schema_of_lists(spark):
    rows = queries.env(spark, SF).withColumn("_body", queries.F.expr(queries.validate.PARSE))
    plan = rows.select(queries.validate.reject_reason(body="_body"))._jdf.queryExecution().optimizedPlan().toString()
    assert "StructsToJson" not in plan and "jsonObjectKeys" not in plan and "schemaOfVariant(_body" not in plan


@pytest.mark.parametrize("joints,ok", [("null", False), ("{}", False), ("[]", True), ("[null]", False), ("[[]]", False), ("[1]", False), ('[{"name":"a","x":1,"y":1.5,"confidence":1e3}]', True), ('[{"name":"a","x":"1","y":1,"confidence":1}]', False), ('[{"name":"a","x":1,"y":1,"confidence":1,"q":1}]', False)])
def test_lists_of_objects(spark, joints, ok):
    row = spark.createDataFrame([("camera", f' {{"body_count":"one","joints":{joints}}}')], "sensor_stream_id string, payload string")
    assert row.select(queries.validate.camera_ok(), queries.validate.object_ok()).first() == (ok, True)


@pytest.mark.parametrize("name", ["ledger_counts", "agent_runs", "stream_counts", "latest_ts", "observation_rates"])
def test_rows_are_not_numbered_for_what_reads_no_sequence(spark, monkeypatch, name):
    calls, number = [], queries.ingest.scan
    monkeypatch.setattr(queries.ingest, "scan", lambda df, keys, *a: calls.append(a[0]) or number(df, keys, *a))
    assert queries.QUERIES[name](spark, SF).count() >= 0 and ["arrival", "part"] not in calls
    test_query_equals_sql(spark, name)


def test_payloads_of_one_stream_are_made_by_several_tasks(spark, tmp_path):
    """All rows of a ledger's stream were one task's, from their numbers to their validation."""
    spark.range(400).selectExpr("id AS event_id", "8L AS user_id", "'click' AS event_type", "1.5D AS value", "'{\"k\": 5}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = queries.env(spark, str(tmp_path)).where("arrival % 2 = 0 AND monotonic_sequence > 0")
        assert rows.count() == 400 and rows.select(queries.F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [r[0] for r in rows.orderBy("arrival").select("monotonic_sequence").collect()] == list(range(1, 401))


@pytest.mark.parametrize("name", ["episode_evidence", "recent_zoom_256", "recent_records"])
def test_payloads_are_not_written_for_what_reads_none(spark, monkeypatch, name):
    written, cut = [], queries.cut_lineage
    for module in (queries, queries.ingest, sys.modules["tracefold.functions.scan"]):
        monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    test_query_equals_sql(spark, name)
    assert written and not any("payload" in columns for columns in written)


@pytest.mark.parametrize("name", ["recent_zoom_24", "recent_records"])
def test_only_recent_rows_are_numbered(spark, monkeypatch, name):
    numbered, number = [], queries.ingest.scan
    monkeypatch.setattr(queries.ingest, "scan", lambda df, keys, order, *a: numbered.append((order, df)) or number(df, keys, order, *a))
    test_query_equals_sql(spark, name)
    assert all(order == ["arrival"] or df.groupBy("ledger_id").count().agg({"count": "max"}).first()[0] <= 32 for order, df in numbered)


def test_recent_rows_have_the_numbers_of_the_ledger(spark):
    rows = [(None if i % 3 == 0 else i % 3, i // 2, i % 2, None if i % 5 < 3 else "camera") for i in range(90)]
    entry = spark.createDataFrame(rows, "ledger_id long, arrival long, part int, stream_id string")
    want = queries.scan(entry, ["ledger_id"], ["arrival", "part"], queries.F.lit(0), {"sequence": ("sum_before", queries.F.lit(1).cast("long"))}).drop("arrival", "part")
    low = sorted(want.where("stream_id IS NOT NULL").collect(), key=lambda x: -x.sequence)
    low = {k: [x.sequence for x in low if x.ledger_id == k][3] for k in (None, 1, 2)}
    got = queries.ingest.recent(entry, 4, "stream_id IS NOT NULL").select(want.columns).collect()
    assert sorted(got, key=str) == sorted([x for x in want.collect() if x.sequence >= low[x.ledger_id]], key=str)


def test_slots_of_sparse_points_are_joined(spark):
    points = spark.range(1000).selectExpr("id % 2 AS ledger_id", "id * 60000000 AS ts_us")
    assert queries.cal.slot_width([points], 60_000_000, 100) == 100 * 60_000_000
    assert queries.cal.slot_width([points, points.selectExpr("0 AS ledger_id", "5 AS ts_us")], 60_000_000, 100) == 60_000_000
    assert queries.cal.slot_width([points.limit(0)], 7, 3) == 21


def test_entry(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
