"""DuckDB SQL for the registered queries, written apart from their Spark plans."""

from __future__ import annotations

from ..operators.merkle import FAN_OUT
from .queries import ACK_US, AGENT_US, ERASED_SEGMENT, FRAME, HMAC_KEY, RATE, SEGMENT, TREE_SEGMENT
from .views import VIEWS

V = {name: text for name, (_, text) in VIEWS.items()}


def _w(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({V[n]})" for n in names)


_ALLOWED = """CASE sensor_stream_id WHEN 'camera' THEN ['body_count','joints'] WHEN 'bluetooth' THEN ['clusters','cluster_count']
  WHEN 'microphone' THEN ['rms','peak','zero_crossing_rate','spectral_centroid_hz','spectral_rolloff_hz','spectral_flatness','voice_activity_probability']
  WHEN 'wifi' THEN ['rssi_mean','noise_mean','visible_network_count','strongest_1','strongest_2','strongest_3'] ELSE CAST([] AS VARCHAR[]) END"""
_FIELD = f"list_min(list_filter(json_keys(payload), lambda k: NOT list_contains({_ALLOWED}, k)))"
_NUM = "('DOUBLE','BIGINT','UBIGINT')"
_ITEMS = """(json_type(payload, '$.{0}') IS NULL OR (json_type(payload, '$.{0}') = 'ARRAY' AND json_array_length(payload, '$.{0}') <= 128
  AND len(list_filter(json_extract(payload, '$.{0}[*]'), lambda j: NOT coalesce(json_type(j) = 'OBJECT' AND list_has_all({1}, json_keys(j)) AND {2}, false))) = 0))"""
_JOINT = f"json_type(j, '$.name') = 'VARCHAR' AND strlen(json_extract_string(j, '$.name')) <= 128 AND json_type(j, '$.x') IN {_NUM} AND json_type(j, '$.y') IN {_NUM} AND json_type(j, '$.confidence') IN {_NUM}"
_CLUSTER = f"json_type(j, '$.pseudonym') = 'VARCHAR' AND regexp_full_match(json_extract_string(j, '$.pseudonym'), 'ble:[0-9a-f]{{64}}') AND json_type(j, '$.rssi') IN {_NUM}"
_CAMERA = "(coalesce(json_extract_string(payload, '$.body_count') IN ('zero','one','two_or_more','unknown'), false) AND " + _ITEMS.format("joints", "['name','x','y','confidence']", _JOINT) + ")"
_MIC = " AND ".join(f"coalesce(json_type(payload, '$.{k}') IN {_NUM}, true)" for k in ("voice_activity_probability", "rms", "spectral_centroid_hz"))
_WIFI = " AND ".join(f"coalesce(json_type(payload, '$.{k}') IN {_NUM}, true)" for k in ("rssi_mean", "noise_mean", "visible_network_count"))
_BLE = f"(coalesce(json_type(payload, '$.cluster_count') IN {_NUM}, true) AND " + _ITEMS.format("clusters", "['pseudonym','rssi']", _CLUSTER) + ")"
_SHAPE = f"CASE sensor_stream_id WHEN 'camera' THEN {_CAMERA} WHEN 'microphone' THEN {_MIC} WHEN 'wifi' THEN {_WIFI} WHEN 'bluetooth' THEN {_BLE} ELSE false END"

_SIG = """CASE sensor_stream_id WHEN 'camera' THEN CASE json_extract_string(payload,'$.body_count') WHEN 'zero' THEN 0.0::DOUBLE WHEN 'one' THEN 1.0::DOUBLE WHEN 'two_or_more' THEN 1.0::DOUBLE END
  WHEN 'microphone' THEN CASE WHEN json_extract(payload,'$.voice_activity_probability') IS NOT NULL THEN greatest(0.0, least(1.0, CAST(json_extract(payload,'$.voice_activity_probability') AS DOUBLE))) END
  WHEN 'bluetooth' THEN CASE WHEN json_extract(payload,'$.cluster_count') IS NOT NULL THEN greatest(0.0, least(1.0, CAST(json_extract(payload,'$.cluster_count') AS DOUBLE) / 4)) END END"""


def _latest(m: str) -> str:
    over = "OVER (PARTITION BY ledger_id ORDER BY arrival ROWS UNBOUNDED PRECEDING)"
    one = f"CASE WHEN sensor_stream_id = '{m}' THEN"
    return f"""last_value({one} {{'id': message_id, 'ts': captured_at_utc_us, 'sig': sig}} END IGNORE NULLS) {over} AS {m},
      coalesce(last_value({one} marker END IGNORE NULLS) {over}, false) AS {m}_pending"""


def _fresh(m: str) -> str:
    return f"CASE WHEN {m} IS NOT NULL THEN greatest(0.0, least(1.0, 1.0 - greatest(captured_at_utc_us - {m}.ts, 0) / 10000000.0::DOUBLE)) END"


_M = ("camera", "microphone", "bluetooth")
_WEIGHT = {"camera": 0.65, "microphone": 0.20, "bluetooth": 0.15}
BASE = f"""WITH envelopes AS ({V['envelopes']}),
reasons AS (SELECT *, CASE WHEN schema_version <> 1 THEN 'version' WHEN NOT strlen(message_id) BETWEEN 1 AND 128 THEN 'message_id' WHEN strlen(payload) > 1048576 THEN 'size'
  WHEN NOT json_valid(payload) THEN 'json' WHEN sensor_stream_id NOT IN ('camera','microphone','wifi','bluetooth') THEN 'stream' WHEN json_type(payload) <> 'OBJECT' THEN 'shape'
  WHEN {_FIELD} IS NOT NULL THEN 'field' WHEN NOT ({_SHAPE}) THEN 'shape' END AS reason FROM envelopes),
cls AS (SELECT * EXCLUDE (first_valid), CASE WHEN reason IN ('version','message_id') THEN reason WHEN first_valid < arrival THEN 'duplicate' ELSE coalesce(reason, 'accepted') END AS status
  FROM (SELECT *, min(CASE WHEN reason IS NULL THEN arrival END) OVER (PARTITION BY ledger_id, message_id) AS first_valid FROM reasons)),
acc AS (SELECT * EXCLUDE (status, reason) FROM cls WHERE status = 'accepted'),
g0 AS (SELECT *, max(monotonic_sequence) OVER (PARTITION BY ledger_id, sensor_stream_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_sequence,
  lag(captured_at_utc_us) OVER (PARTITION BY ledger_id, sensor_stream_id ORDER BY arrival) AS prev_us FROM acc),
g1 AS (SELECT *, coalesce(monotonic_sequence > last_sequence + 1, false) AS jump FROM g0),
g2 AS (SELECT *, NOT jump AND coalesce(captured_at_utc_us - prev_us > 30000000, false) AS silent FROM g1),
g3 AS (SELECT *, CASE WHEN jump THEN false WHEN silent THEN true END AS marker FROM g2),
gapped AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY ledger_id, sensor_stream_id ORDER BY arrival ROWS UNBOUNDED PRECEDING), false) AS pending, {_SIG} AS sig FROM g3),
state AS (SELECT ledger_id, sensor_stream_id, arg_max(captured_at_utc_us, arrival) AS last_ts_us, max(monotonic_sequence) AS max_sequence, arg_max(pending, arrival) AS pending FROM gapped GROUP BY ALL),
latest AS (SELECT *, {', '.join(map(_latest, _M))} FROM gapped),
f1 AS (SELECT *, {', '.join(f'{_fresh(m)} AS {m}_h' for m in _M)} FROM latest),
f2 AS (SELECT *, {' + '.join(f'({m}.sig IS NOT NULL)::INT' for m in _M)} AS modalities,
  ({' + '.join(f'coalesce({m}_h, 0)' for m in _M)}) / nullif({' + '.join(f'({m} IS NOT NULL)::INT' for m in _M)}, 0) AS health,
  {' + '.join(f'(CASE WHEN {m}.sig IS NOT NULL THEN {_WEIGHT[m]}::DOUBLE * {m}_h ELSE 0 END)' for m in _M)} AS weight,
  {' + '.join(f'(CASE WHEN {m}.sig IS NOT NULL THEN {m}.sig * ({_WEIGHT[m]}::DOUBLE * {m}_h) ELSE 0 END)' for m in _M)} AS total,
  greatest({', '.join(f'{m}.sig' for m in _M)}) - least({', '.join(f'{m}.sig' for m in _M)}) AS disagreement FROM f1),
fused AS (SELECT *, CASE WHEN modalities > 0 AND weight <> 0 THEN total / weight END AS probability,
  greatest(0.0, least(1.0, weight * health * (1 - 0.5 * disagreement))) AS confidence, CASE WHEN disagreement > 0.45 OR health < 0.25 THEN 'contested' ELSE 'stable' END AS state FROM f2),
beliefs AS (SELECT ledger_id, arrival, 'belief:' || message_id AS id, message_id AS source_observation_id, captured_at_utc_us AS ts_us, probability, confidence, disagreement, modalities, health, state,
  list_filter([{', '.join(f'{m}.id' for m in _M)}], lambda x: x IS NOT NULL) AS derived_from FROM fused WHERE NOT (camera_pending OR microphone_pending OR bluetooth_pending) AND probability IS NOT NULL),
bedges AS (SELECT ledger_id, id AS derived_id, unnest(derived_from) AS source_id, generate_subscripts(derived_from, 1) - 1 AS ordinal FROM beliefs),
lrows AS (SELECT ledger_id, arrival, 0 AS part, 'gap:' || sensor_stream_id || ':' || last_sequence || '-' || monotonic_sequence AS id, 'sensor_gap' AS kind, sensor_stream_id AS stream_id, captured_at_utc_us AS ts_us, NULL::VARCHAR AS payload, NULL::DOUBLE AS probability FROM gapped WHERE jump
  UNION ALL SELECT ledger_id, arrival, 1, message_id, 'observation', sensor_stream_id, captured_at_utc_us, left(payload, length(payload) - 1) || CASE WHEN payload = '{{}}' THEN '' ELSE ',' END || '"_monotonic_sequence":' || monotonic_sequence || '}}', NULL FROM gapped
  UNION ALL SELECT ledger_id, arrival, 2, id, 'belief', 'fusion', ts_us, NULL, probability FROM beliefs),
ledger AS (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY arrival, part) - 1 AS sequence FROM lrows),
samples AS (SELECT ledger_id, ts_us, arrival AS sequence, probability AS p FROM beliefs),
s1 AS (SELECT *, CASE WHEN p >= 0.7 THEN 'E' WHEN p <= 1.0::DOUBLE - 0.8::DOUBLE THEN 'X' ELSE '-' END AS k FROM samples),
s2 AS (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER (PARTITION BY ledger_id ORDER BY ts_us, sequence) THEN 1 ELSE 0 END AS turn FROM s1),
s3 AS (SELECT *, sum(turn) OVER (PARTITION BY ledger_id ORDER BY ts_us, sequence ROWS UNBOUNDED PRECEDING) AS run FROM s2),
runs AS (SELECT ledger_id, run, any_value(k) AS k, min(ts_us) AS start FROM s3 GROUP BY ledger_id, run HAVING any_value(k) <> '-' AND max(ts_us) - min(ts_us) >= CASE any_value(k) WHEN 'E' THEN 3000000 ELSE 5000000 END),
r1 AS (SELECT *, lag(k) OVER (PARTITION BY ledger_id ORDER BY run) AS prior FROM runs),
r2 AS (SELECT * FROM r1 WHERE k IS DISTINCT FROM prior AND NOT (k = 'X' AND prior IS NULL)),
r3 AS (SELECT *, lead(start) OVER (PARTITION BY ledger_id ORDER BY run) AS stop FROM r2),
raw_sessions AS (SELECT ledger_id, start AS start_us, coalesce(stop, final) AS end_us FROM r3 JOIN (SELECT ledger_id, max(ts_us) AS final FROM samples GROUP BY 1) USING (ledger_id) WHERE k = 'E'),
m1 AS (SELECT *, coalesce((start_us - lag(end_us) OVER (PARTITION BY ledger_id ORDER BY start_us, end_us) > 5000000)::INT, 1) AS fresh FROM raw_sessions),
m2 AS (SELECT *, sum(fresh) OVER (PARTITION BY ledger_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM m1),
merged AS (SELECT ledger_id, min(start_us) AS start_us, last(end_us ORDER BY start_us, end_us) AS end_us FROM m2 GROUP BY ledger_id, g),
e1 AS (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY start_us, end_us) - 1 AS idx, coalesce((start_us - lag(end_us) OVER (PARTITION BY ledger_id ORDER BY start_us, end_us) > 1800000000)::INT, 1) AS fresh FROM merged),
e2 AS (SELECT *, sum(fresh) OVER (PARTITION BY ledger_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) - 1 AS episode FROM e1),
episodes AS (SELECT ledger_id, episode, min(start_us) AS start_us, last(end_us ORDER BY idx) AS end_us, string_agg(idx, ',' ORDER BY idx) AS members FROM e2 GROUP BY ledger_id, episode),
patterns AS (SELECT ledger_id, 'Occupied:' || ((end_us - start_us) // 60000000) || 'min' AS signature, string_agg(CAST(episode AS BIGINT), ',' ORDER BY episode) AS episodes FROM episodes GROUP BY 1, 2),
memory AS (SELECT ledger_id, 'memory-episode-' || CAST(episode AS BIGINT) || '-' || start_us || '-' || end_us AS id, 'episode' AS kind FROM episodes
  UNION ALL SELECT ledger_id, 'memory-pattern-' || (row_number() OVER (PARTITION BY ledger_id ORDER BY signature) - 1) || '-' || signature, 'pattern' FROM patterns)
"""


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


_DFT = f"""WITH f AS (SELECT vec_id AS frame_id, embedding AS x FROM embeddings),
s AS (SELECT frame_id, generate_subscripts(x, 1) - 1 AS i, unnest(x)::DOUBLE AS v FROM f),
w AS (SELECT frame_id, i, v * (0.5 - 0.5 * cos(2 * pi() * i / {FRAME})) AS v FROM s),
dft AS (SELECT frame_id, b, sum(v * cos(2 * pi() * b * i / {FRAME})) AS re, sum(v * sin(2 * pi() * b * i / {FRAME})) AS im FROM w, (SELECT unnest(range({FRAME // 2 + 1})) AS b) GROUP BY 1, 2),
mag AS (SELECT d.frame_id, d.b AS bin, CASE WHEN d.b = 0 THEN sqrt(d.re * d.re + n.re * n.re) ELSE sqrt(d.re * d.re + d.im * d.im) END AS m FROM dft d JOIN dft n ON n.frame_id = d.frame_id AND n.b = {FRAME // 2} WHERE d.b < {FRAME // 2}),
mr AS (SELECT *, sum(m) OVER (PARTITION BY frame_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run, sum(m) OVER (PARTITION BY frame_id) AS total FROM mag),
energy AS (SELECT frame_id, sqrt(sum(v * v) / count(*)) AS rms, max(abs(v)) AS peak FROM s GROUP BY 1),
zc AS (SELECT frame_id, sum(CASE WHEN (v >= 0) <> (pv >= 0) THEN 1 ELSE 0 END) / (count(*) - 1)::DOUBLE AS zcr FROM (SELECT *, lag(v) OVER (PARTITION BY frame_id ORDER BY i) AS pv FROM s) GROUP BY 1),
cen AS (SELECT frame_id, sum(m * bin * {RATE} / {FRAME}) / sum(m) AS hz FROM mag GROUP BY 1),
roll AS (SELECT frame_id, min(bin) * {RATE} / {FRAME} AS hz FROM mr WHERE run >= total * 0.85 GROUP BY 1),
fl AS (SELECT frame_id, exp(avg(ln(m))) / avg(m) AS flatness FROM mag WHERE m > 0 GROUP BY 1),
vad AS (SELECT frame_id, CASE WHEN rms > 0.001 THEN ((zcr > 0.02 AND zcr < 0.35)::INT + (1 - least(flatness, 1.0)) + least(rms * 10, 1.0)) / 3 ELSE 0 END AS vad FROM energy JOIN zc USING (frame_id) JOIN fl USING (frame_id))
"""
_TELE = """, last_obs AS (SELECT ledger_id, arg_max(payload, sequence) FILTER (stream_id = 'camera') AS c, arg_max(payload, sequence) FILTER (stream_id = 'microphone') AS m, arg_max(payload, sequence) FILTER (stream_id = 'wifi') AS w,
  arg_max(payload, sequence) FILTER (stream_id = 'bluetooth') AS b FROM ledger WHERE kind = 'observation' GROUP BY 1),
tele AS (SELECT ledger_id, CASE json_extract_string(c, '$.body_count') WHEN 'zero' THEN 0.0::DOUBLE WHEN 'one' THEN 1.0::DOUBLE WHEN 'two_or_more' THEN 1.0::DOUBLE END AS camera_presence, CAST(json_extract(m, '$.rms') AS DOUBLE) AS audio_rms, CAST(json_extract(m, '$.spectral_centroid_hz') AS DOUBLE) AS audio_centroid_hz,
  CAST(json_extract(m, '$.voice_activity_probability') AS DOUBLE) AS audio_vad, CAST(json_extract(w, '$.rssi_mean') AS DOUBLE) AS wifi_rssi_mean, CAST(json_extract(w, '$.noise_mean') AS DOUBLE) AS wifi_noise_mean,
  CAST(json_extract(w, '$.visible_network_count') AS DOUBLE) AS wifi_network_count, CAST(json_extract(b, '$.cluster_count') AS DOUBLE) AS bluetooth_cluster_count, CASE WHEN json_array_length(b, '$.clusters') > 0 THEN list_sum(list_transform(json_extract(b, '$.clusters[*]'), lambda c: coalesce(CAST(json_extract(c, '$.rssi') AS DOUBLE), 0))) / json_array_length(b, '$.clusters') END AS bluetooth_mean_rssi FROM last_obs),
sig3 AS (SELECT ledger_id, camera_presence AS c, CASE WHEN audio_vad IS NOT NULL THEN greatest(0.0, least(1.0, audio_vad)) END AS m, CASE WHEN bluetooth_cluster_count IS NOT NULL THEN least(1.0, bluetooth_cluster_count / 4) END AS b FROM tele),
fb AS (SELECT *, (CASE WHEN c IS NULL THEN 0 ELSE 0.65::DOUBLE END) + (CASE WHEN m IS NULL THEN 0 ELSE 0.2::DOUBLE END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.15::DOUBLE END) AS w, coalesce(c, 0) * 0.65::DOUBLE + coalesce(m, 0) * 0.2::DOUBLE + coalesce(b, 0) * 0.15::DOUBLE AS t, greatest(c, m, b) - least(c, m, b) AS spread FROM sig3)
"""
_CLOSURE = f"""WITH RECURSIVE nodes AS ({V['lineage_nodes']}), edges AS ({V['lineage_edges']}),
gone(id) AS (SELECT 'r:1' UNION SELECT e.derived_id FROM gone JOIN edges e ON e.source_id = gone.id)
"""
_REC = f"""WITH RECURSIVE records AS ({V['retained_records']}), edges AS ({V['retained_edges']}), last AS (SELECT max(recorded_us) AS m FROM records),
cut AS (SELECT *, CASE kind WHEN 'observation' THEN 604800000000 WHEN 'belief' THEN 2592000000000 WHEN 'event' THEN 31536000000000 END AS cutoff FROM records)
"""
_PADS = tuple("".join(f"\\x{b ^ p:02X}" for b in HMAC_KEY.ljust(64, b"\0")) for p in (0x36, 0x5C))
_CLAIMS = f"""{_w('claims', 'claim_evidence')}, cited AS (SELECT claim_id, count(*) AS n, arg_min(evidence_id, ordinal) FILTER (layer = 'imagined') AS bad FROM claim_evidence GROUP BY 1),
bad AS (SELECT claim_id, CASE WHEN layer = 'observed' AND n > 0 THEN 'observed_cites' WHEN layer <> 'imagined' AND bad IS NOT NULL THEN 'imagined_as_fact' END AS violation, bad FROM claims JOIN cited USING (claim_id)),
allowed AS (SELECT * FROM (VALUES ('archivist','observed'),('archivist','inferred'),('ethnographer','interpreted'),('skeptic','interpreted'),('cartographer','inferred'),('poet','imagined')) t(role, layer))
"""
_OBS = "FROM ledger WHERE kind = 'observation' GROUP BY 1, 2"
_RUNS = " UNION ALL ".join(
    f"SELECT ledger_id, {i}::BIGINT AS sequence, 'agent-run-{role}-{AGENT_US + i}' AS id, '{role}' AS role, '{layer}' AS layer, '{status}' AS status, count(*) AS evidence FROM beliefs GROUP BY 1"
    for i, (role, layer, status) in enumerate((("archivist", "INFERRED", "DRAFT"), ("cartographer", "INFERRED", "DRAFT"), ("ethnographer", "INTERPRETED", "PENDING_INTERPRETATION"), ("poet", "IMAGINED", "ARTIFACT"), ("skeptic", "INTERPRETED", "INSUFFICIENT_EVIDENCE")))
)
_REACH = 500_000
_MATCHED = f""", labels AS (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY line_no) AS k FROM ({V['fusion_labels']})),
near AS (SELECT l.ledger_id, l.k, l.line_no, l.occupied, list(s.sequence ORDER BY abs(s.ts_us - l.ts_us), s.sequence) FILTER (s.sequence IS NOT NULL) AS found
  FROM labels l LEFT JOIN samples s ON s.ledger_id = l.ledger_id AND s.ts_us BETWEEN l.ts_us - {_REACH} AND l.ts_us + {_REACH} GROUP BY ALL),
turn AS (SELECT ledger_id, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS used, NULL::BIGINT AS sequence FROM (SELECT DISTINCT ledger_id FROM labels)
  UNION ALL SELECT ledger_id, k, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, best
  FROM (SELECT n.ledger_id, n.k, t.used, list_filter(coalesce(n.found, CAST([] AS BIGINT[])), lambda x: NOT list_contains(t.used, x))[1] AS best FROM turn t JOIN near n ON n.ledger_id = t.ledger_id AND n.k = t.k + 1)),
pairs AS (SELECT ledger_id, n.line_no, t.sequence, s.p, n.occupied FROM turn t JOIN near n USING (ledger_id, k) JOIN samples s USING (ledger_id, sequence))
"""
_RECURSIVE = BASE.replace("WITH envelopes", "WITH RECURSIVE envelopes", 1)
_REPORT = f"""_MATCHED_, scored AS (SELECT ledger_id, greatest(0.0, least(1.0, p)) AS p, greatest(0.0, least(1.0, p)) >= 0.5 AS said, occupied FROM pairs),
m AS (SELECT ledger_id, count(*) AS matched, count(*) FILTER (said = occupied) / count(*) AS accuracy, sum((p - occupied::INT) ** 2) / count(*) AS brier,
  coalesce(count(*) FILTER (said AND occupied) / nullif(count(*) FILTER (said), 0), 0) AS precision, coalesce(count(*) FILTER (said AND occupied) / nullif(count(*) FILTER (occupied), 0), 0) AS recall FROM scored GROUP BY 1)
SELECT ledger_id, n AS labels, coalesce(matched, 0) AS matched, round(coalesce(accuracy, 0), 6) AS accuracy, round(coalesce(brier, 0), 6) AS brier, round(coalesce(precision, 0), 6) AS precision, round(coalesce(recall, 0), 6) AS recall, n - coalesce(matched, 0) AS unmatched, {_REACH}::BIGINT AS max_offset_us
FROM (SELECT ledger_id, count(*) AS n FROM labels GROUP BY 1) LEFT JOIN m USING (ledger_id)"""
_JOINTS = "CASE WHEN vec_id % 10 = 0 THEN 0 ELSE 20 END"

_CHAINED = f"""WITH RECURSIVE rows_ AS (SELECT *, sequence // {SEGMENT} AS segment, row_number() OVER (PARTITION BY ledger_id, sequence // {SEGMENT} ORDER BY sequence) AS n FROM ({V['chain_rows']})),
c AS (SELECT ledger_id, sequence, id, payload, segment, n, '0' AS previous_hash, sha256('0' || payload) AS hash FROM rows_ WHERE n = 1
 UNION ALL SELECT r.ledger_id, r.sequence, r.id, r.payload, r.segment, r.n, c.hash, sha256(c.hash || r.payload) FROM c JOIN rows_ r ON r.ledger_id = c.ledger_id AND r.segment = c.segment AND r.n = c.n + 1)"""


def _chain(rows: str, columns: str, payload: str = "payload") -> str:
    """CTEs that chain rows (ledger_id, segment, sequence, columns) by ledger and segment from '0'; the last is c."""
    named = ", ".join(f"r.{x.strip()}" for x in columns.split(","))
    return f"""rows_ AS (SELECT *, row_number() OVER (PARTITION BY ledger_id, segment ORDER BY sequence) AS n FROM {rows}),
c AS (SELECT ledger_id, segment, sequence, n, {columns}, '0' AS previous_hash, sha256('0' || {payload}) AS hash FROM rows_ WHERE n = 1
 UNION ALL SELECT r.ledger_id, r.segment, r.sequence, r.n, {named}, c.hash, sha256(c.hash || r.{payload}) FROM c JOIN rows_ r ON r.ledger_id = c.ledger_id AND r.segment = c.segment AND r.n = c.n + 1)"""


def _tree(chained: str) -> str:
    """CTEs l0 to l4 and nodes: the hash tree over the segments of chained rows; levels end where all ledgers have one node."""
    up = lambda k: f"""l{k + 1} AS (SELECT ledger_id, {k + 1} AS level, node // {FAN_OUT} AS node, sum(rows)::BIGINT AS rows, sha256(string_agg(node || ':' || rows || ':' || hash, ';' ORDER BY node)) AS hash
  FROM l{k} WHERE (SELECT max(node) FROM l{k}) > 0 GROUP BY ledger_id, node // {FAN_OUT})"""  # noqa: E731
    return f"l0 AS (SELECT ledger_id, 0 AS level, segment AS node, count(*) AS rows, arg_max(hash, sequence) AS hash FROM {chained} GROUP BY ALL), " + ", ".join(map(up, range(4))) + ", tree AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(5)) + ")"


_STORED = "ledger_id, id, kind, stream_id, ts_us, recorded_us, payload, segment, sequence, previous_hash, hash"


def _left(gone: str, time: str) -> str:
    """CTEs: stored records that aren't gone, chained by their segments; n is their sequence. gone is a recursive CTE's body."""
    return f""", gone(id) AS ({gone}),
stored AS (SELECT ledger_id, event AS old, event // {ERASED_SEGMENT} AS segment, id, kind, 's' || event % 4 AS stream_id, {time} AS ts_us, recorded_us, '{{"ts_us":' || recorded_us || '}}' AS payload FROM (SELECT *, sequence AS event FROM records)),
left_ AS (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY old) - 1 AS sequence FROM stored WHERE id NOT IN (SELECT id FROM gone)),
""" + _chain("left_", "id, kind, stream_id, ts_us, recorded_us, payload")


_RANGE = "SELECT id FROM records WHERE kind <> 'episode' AND recorded_us BETWEEN 360000000000 AND 540000000000 UNION SELECT e.derived_id FROM gone JOIN edges e ON e.source_id = gone.id"
_TIME = "CASE WHEN kind <> 'episode' THEN recorded_us END"
_TREE_ROWS = f"""WITH RECURSIVE given AS (SELECT *, sequence // {TREE_SEGMENT} AS segment FROM ({V['chain_rows']})), """ + _chain("given", "id, payload")

ORACLES: dict[str, str] = {
    "envelope_scan": V["envelopes"],
    "ledger_scan": f"{_w('chain_rows')} SELECT ledger_id, sequence, CASE WHEN sequence % 10 = 0 THEN NULL ELSE CAST(json_extract(payload, '$.k') AS BIGINT) END AS k FROM chain_rows",
    "label_scan": f"{_w('fusion_labels')} SELECT ts_us, occupied FROM fusion_labels",
    "raw_media_audit": f"""{_w('capture_files')}, n AS (SELECT path, string_split(path, '/')[-1] AS name FROM capture_files)
SELECT path FROM n WHERE contains(name, '.') AND NOT (starts_with(name, '.') AND len(string_split(name, '.')) = 2)
  AND lower(string_split(name, '.')[-1]) IN ('aif','aiff','caf','jpeg','jpg','m4a','mov','mp3','mp4','png','wav')""",
    "ledger_append": BASE + "SELECT ledger_id, sequence, id, kind FROM ledger",
    "validate_schema_version": BASE + "SELECT arrival, schema_version = 1 AS ok FROM envelopes",
    "validate_message_id": BASE + "SELECT arrival, strlen(message_id) BETWEEN 1 AND 4 AS ok FROM envelopes",
    "validate_size": BASE + "SELECT arrival, strlen(payload) <= 40 AS ok FROM envelopes",
    "validate_json": BASE + "SELECT arrival, json_valid(payload) AND json_type(payload) = 'OBJECT' AS ok FROM envelopes",
    "validate_stream": BASE + "SELECT arrival, sensor_stream_id IN ('camera','microphone','wifi','bluetooth') AS ok FROM envelopes",
    "validate_camera": BASE + f"SELECT arrival, {_CAMERA} AS ok FROM envelopes WHERE sensor_stream_id = 'camera'",
    "validate_bluetooth": BASE + f"SELECT arrival, {_BLE} AS ok FROM envelopes WHERE sensor_stream_id = 'bluetooth'",
    "validate_numeric_streams": BASE + f"SELECT arrival, {_SHAPE} AS ok FROM envelopes WHERE sensor_stream_id IN ('microphone', 'wifi')",
    "validate_keys": BASE + f"SELECT arrival, {_FIELD} AS field FROM envelopes",
    "ingest_rejects": BASE + "SELECT ledger_id, arrival, message_id, status FROM cls",
    "ingest_dedup": BASE + "SELECT ledger_id, arrival, message_id FROM acc",
    "sequence_gaps": BASE + "SELECT ledger_id, id, ts_us, arrival FROM lrows WHERE part = 0",
    "ledger_build": BASE + "SELECT ledger_id, sequence, id, kind, stream_id, ts_us, payload FROM ledger",
    "silent_gaps": BASE + "SELECT ledger_id, sensor_stream_id, arrival, message_id FROM gapped WHERE silent",
    "gap_state": BASE + "SELECT * FROM state",
    "pending_gap_streams": BASE + "SELECT ledger_id, sensor_stream_id FROM state WHERE pending",
    "belief_guard": BASE + "SELECT ledger_id, arrival, sensor_stream_id FROM gapped WHERE NOT pending",
    "acknowledge_gaps": BASE + f"SELECT ledger_id, 'operator-gap-ack-' || sensor_stream_id || '-{ACK_US}-' || (row_number() OVER (PARTITION BY ledger_id ORDER BY sensor_stream_id) - 1) AS id, sensor_stream_id, {ACK_US}::BIGINT AS ts_us FROM state WHERE pending AND sensor_stream_id IN ('camera', 'wifi')",
    "asof_latest": BASE + f"SELECT ledger_id, arrival, {', '.join(f'{m}.id AS {m}_id, {m}.ts AS {m}_ts_us' for m in _M)} FROM latest",
    "fusion_signals": BASE + "SELECT arrival, round(sig, 6) AS signal FROM gapped",
    "sensor_freshness": BASE + f"SELECT arrival, {', '.join(f'round({m}_h, 6) AS {m}' for m in _M)} FROM f1",
    "fusion_probability": BASE + f"SELECT arrival, {_r('probability')} FROM fused",
    "fusion_beliefs": BASE + f"SELECT ledger_id, id, source_observation_id, ts_us, {_r('probability', 'confidence', 'disagreement', 'health')}, modalities, state FROM beliefs",
    "fusion_evidence": BASE + "SELECT ledger_id, derived_id, source_id, ordinal FROM bedges",
    "fallback_belief": BASE + _TELE + "SELECT ledger_id, round(CASE WHEN w > 0 THEN t / w ELSE 0.5 END, 6) AS probability, round(CASE WHEN w > 0 THEN greatest(0.0, least(1.0, w * (1 - 0.5 * spread))) ELSE 0 END, 6) AS confidence, round(CASE WHEN w > 0 THEN spread ELSE 1 END, 6) AS disagreement, (c IS NOT NULL)::INT + (m IS NOT NULL)::INT + (b IS NOT NULL)::INT AS modalities, CASE WHEN w = 0 THEN 'unknown' WHEN spread > 0.45 THEN 'contested' ELSE 'stable' END AS state FROM fb",
    "anchor_downgrade": BASE + "SELECT id, round(CASE WHEN disagreement >= 0.5 THEN least(confidence, 0.2) ELSE confidence END, 6) AS confidence FROM beliefs",
    "belief_samples": BASE + f"SELECT ledger_id, ts_us, sequence, round(probability, 6) AS p FROM ledger WHERE kind = 'belief'",
    "occupancy_sessions": BASE + "SELECT * FROM raw_sessions",
    "merge_sessions": BASE + "SELECT * FROM merged",
    "episodes": BASE + "SELECT ledger_id, CAST(episode AS BIGINT) AS episode, start_us, end_us, members FROM episodes",
    "patterns": BASE + "SELECT * FROM patterns",
    "session_evidence": BASE + "SELECT b.ledger_id, m.start_us, b.id AS belief_id FROM beliefs b JOIN merged m ON m.ledger_id = b.ledger_id AND b.ts_us BETWEEN m.start_us AND m.end_us",
    "episode_evidence": BASE + "SELECT DISTINCT b.ledger_id, CAST(e.episode AS BIGINT) AS episode, b.id AS belief_id FROM beliefs b JOIN merged m ON m.ledger_id = b.ledger_id AND b.ts_us BETWEEN m.start_us AND m.end_us JOIN episodes e ON e.ledger_id = m.ledger_id AND m.start_us BETWEEN e.start_us AND e.end_us",
    "pattern_evidence": BASE + "SELECT DISTINCT b.ledger_id, 'Occupied:' || ((e.end_us - e.start_us) // 60000000) || 'min' AS signature, b.id AS belief_id FROM beliefs b JOIN merged m ON m.ledger_id = b.ledger_id AND b.ts_us BETWEEN m.start_us AND m.end_us JOIN episodes e ON e.ledger_id = m.ledger_id AND m.start_us BETWEEN e.start_us AND e.end_us",
    "materialize_counts": BASE + "SELECT ledger_id, kind, count(*) AS total, count(*) FILTER (ledger_id % 2 = 1) AS written FROM memory GROUP BY 1, 2",
    "materialize_memory": BASE + "SELECT * FROM memory",
    "memory_counts": BASE + "SELECT ledger_id, e AS episodes, CASE WHEN ledger_id % 2 = 0 AND e > 0 THEN 0 ELSE p END AS patterns FROM (SELECT ledger_id, count(*) FILTER (kind = 'episode') AS e, count(*) FILTER (kind = 'pattern') AS p FROM memory GROUP BY 1)",
    "calibration_match": _RECURSIVE + _MATCHED + "SELECT ledger_id, line_no, sequence, round(p, 6) AS p, occupied FROM pairs",
    "calibration_report": _RECURSIVE + _REPORT.replace("_MATCHED_", _MATCHED),
    "calibration_report_sink": _RECURSIVE + _REPORT.replace("_MATCHED_", _MATCHED),
    "calibration_metrics": """WITH c AS (SELECT user_id % 8 AS ledger_id, greatest(0.0, least(1.0, value / 100.0::DOUBLE)) AS p, event_id % 3 = 0 AS y FROM events), n AS (SELECT *, p >= 0.5 AS s FROM c)
SELECT ledger_id, count(*) AS n, round(count(*) FILTER (s = y) / count(*), 6) AS accuracy, round(sum((p - y::INT) * (p - y::INT)) / count(*), 6) AS brier, round(coalesce(count(*) FILTER (s AND y) / nullif(count(*) FILTER (s), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (s AND y) / nullif(count(*) FILTER (y), 0), 0), 6) AS recall FROM n GROUP BY 1""",
    "chain_build": _CHAINED + " SELECT * EXCLUDE (n) FROM c",
    "chain_heads": _CHAINED + """, e AS (SELECT ledger_id, segment, arg_max(hash, sequence) AS head, count(*) AS rows, row_number() OVER (PARTITION BY ledger_id ORDER BY segment) AS k FROM c GROUP BY 1, 2),
h AS (SELECT ledger_id, segment, head, rows, k, '0' AS previous_hash, sha256('0' || head) AS hash FROM e WHERE k = 1
 UNION ALL SELECT e.ledger_id, e.segment, e.head, e.rows, e.k, h.hash, sha256(h.hash || e.head) FROM h JOIN e ON e.ledger_id = h.ledger_id AND e.k = h.k + 1)
SELECT * EXCLUDE (k) FROM h""",
    "chain_verify_heads": _CHAINED + """, ends AS (SELECT ledger_id, segment, arg_max(hash, sequence) AS head, count(*) AS rows, row_number() OVER (PARTITION BY ledger_id ORDER BY segment) AS k FROM c GROUP BY 1, 2),
h AS (SELECT ledger_id, segment, head, rows, k, '0' AS previous_hash, sha256('0' || head) AS hash FROM ends WHERE k = 1
 UNION ALL SELECT e.ledger_id, e.segment, e.head, e.rows, e.k, h.hash, sha256(h.hash || e.head) FROM h JOIN ends e ON e.ledger_id = h.ledger_id AND e.k = h.k + 1),
last AS (SELECT ledger_id, max(sequence) AS sequence FROM c WHERE segment = 0 GROUP BY 1),
now AS (SELECT ledger_id, segment, arg_max(hash, sequence) AS head, count(*) AS rows FROM c WHERE segment <> 1 AND (ledger_id, sequence) NOT IN (SELECT (ledger_id, sequence) FROM last) GROUP BY 1, 2),
linked AS (SELECT *, previous_hash = coalesce(lag(hash) OVER (PARTITION BY ledger_id ORDER BY segment), '0') AND hash = sha256(previous_hash || head) AS follows FROM h),
faults AS (SELECT ledger_id, segment, CASE WHEN n.head IS NULL THEN 'missing' WHEN l.head IS NULL THEN 'unknown' WHEN l.head <> n.head OR l.rows <> n.rows THEN 'changed' WHEN NOT l.follows THEN 'unlinked' END AS fault FROM linked l FULL JOIN now n USING (ledger_id, segment))
SELECT * FROM faults WHERE fault IS NOT NULL""",
    "chain_verify": f"{_w('chain_rows')} SELECT ledger_id, sequence // {SEGMENT} AS segment, min(sequence) AS first_broken FROM chain_rows WHERE sequence % 1777 = 5 GROUP BY 1, 2",
    "event_history": f"{_w('chain_rows')} SELECT ledger_id, sequence, id AS ancestor FROM chain_rows",
    "provenance_sources": f"{_w('lineage_edges')} SELECT derived_id, string_agg(source_id, ',' ORDER BY ordinal) AS sources FROM lineage_edges GROUP BY 1",
    "provenance_tree": f"""WITH RECURSIVE nodes AS ({V['lineage_nodes']}), edges AS ({V['lineage_edges']}),
t AS (SELECT id AS root, id, 0 AS depth FROM nodes UNION ALL SELECT t.root, e.source_id, t.depth + 1 FROM t JOIN edges e ON e.derived_id = t.id JOIN nodes n ON n.id = e.source_id) SELECT root, id, depth, depth AS place FROM t""",
    "erase_cascade": _CLOSURE + "SELECT id FROM gone",
    "erase_compact": _CLOSURE + f""", led AS (SELECT *, s // {ERASED_SEGMENT} AS segment FROM (SELECT 0 AS ledger_id, id, kind, kind AS stream_id, n * 1000 AS ts_us, '{{"id":"' || id || '"}}' AS payload, row_number() OVER (ORDER BY sequence_class, n, coalesce(try_cast(string_split(id, ':')[4] AS BIGINT), 0)) - 1 AS s FROM nodes)),
kept AS (SELECT *, row_number() OVER (ORDER BY s) - 1 AS sequence FROM led WHERE id NOT IN (SELECT id FROM gone)), """ + _chain("kept", "id, kind, stream_id, ts_us, payload") + " SELECT id, kind, stream_id, ts_us, payload, segment, sequence, previous_hash, hash FROM c",
    "range_erase": _REC + _left(_RANGE, _TIME) + f" SELECT {_STORED} FROM c",
    "erase_tree": _REC + _left(_RANGE, _TIME) + ", " + _tree("c") + " SELECT * FROM tree",
    "erase_edges": _REC + ", gone(id) AS (" + _RANGE + ") SELECT * FROM edges WHERE derived_id NOT IN (SELECT id FROM gone) AND source_id NOT IN (SELECT id FROM gone)",
    "chain_tree": _TREE_ROWS + ", " + _tree("c") + " SELECT * FROM tree",
    "chain_verify_tree": _TREE_ROWS + ", " + _tree("c") + f""", stored AS (SELECT * REPLACE (CASE WHEN level = 1 AND ledger_id = 3 THEN 'x' || hash ELSE hash END AS hash) FROM tree),
now AS (SELECT ledger_id, 0 AS level, segment AS node, count(*) AS rows, arg_max(CASE WHEN segment % 7 = 3 THEN 'x' || hash ELSE hash END, sequence) AS hash FROM c WHERE segment % 9 <> 2 GROUP BY ALL
  UNION ALL SELECT ledger_id, level + 1, node // {FAN_OUT}, sum(rows), sha256(string_agg(node || ':' || rows || ':' || hash, ';' ORDER BY node)) FROM stored WHERE level < (SELECT max(level) FROM stored) GROUP BY ledger_id, level + 1, node // {FAN_OUT}),
f AS (SELECT ledger_id, level, node, CASE WHEN n.hash IS NULL THEN CASE WHEN level = 0 THEN 'missing' ELSE 'unknown' END WHEN s.hash IS NULL THEN CASE WHEN level = 0 THEN 'unknown' ELSE 'missing' END WHEN n.hash <> s.hash OR n.rows <> s.rows THEN 'changed' END AS fault FROM stored s FULL JOIN now n USING (ledger_id, level, node))
SELECT * FROM f WHERE fault IS NOT NULL""",
    "claim_violations": _CLAIMS + "SELECT claim_id, violation, CASE WHEN violation = 'imagined_as_fact' THEN bad END AS evidence_id FROM bad WHERE violation IS NOT NULL",
    "role_violations": _CLAIMS + "SELECT claim_id, CASE WHEN a.role IS NULL THEN 'role_layer' ELSE violation END AS violation FROM claims LEFT JOIN allowed a USING (role, layer) LEFT JOIN bad USING (claim_id) WHERE a.role IS NULL OR violation IS NOT NULL",
    "agent_evidence": BASE + f"SELECT ledger_id, 'agent-run-skeptic-{AGENT_US}' AS id, 'INTERPRETED' AS layer, 'INSUFFICIENT_EVIDENCE' AS status, count(*) AS evidence FROM beliefs GROUP BY 1",
    "retention_eligible": _REC + "SELECT id, kind FROM cut, last WHERE m + 3600000000 - recorded_us >= cutoff",
    "retention_preview": _REC + ", x AS (SELECT *, m + 31449600000000 - recorded_us >= cutoff AS old FROM cut, last) SELECT count(*) FILTER (old AND kind = 'observation') AS observations, count(*) FILTER (old AND kind = 'belief') AS beliefs, count(*) FILTER (old AND kind = 'event') AS events, count(*) FILTER (kind IN ('episode','pattern','agent_run')) AS protected FROM x",
    "retention_plan": _REC + "SELECT id, kind, coalesce(sources, '') AS sources FROM (SELECT id, kind FROM cut, last WHERE m + 2419200000000 - recorded_us >= cutoff) LEFT JOIN (SELECT derived_id AS id, string_agg(source_id, ',' ORDER BY ordinal) AS sources FROM edges GROUP BY 1) USING (id)",
    "retention_plan_sink": _REC + "SELECT id, kind, coalesce(sources, '') AS sources FROM (SELECT id, kind FROM cut, last WHERE m + 2419200000000 - recorded_us >= cutoff) LEFT JOIN (SELECT derived_id AS id, string_agg(source_id, ',' ORDER BY ordinal) AS sources FROM edges GROUP BY 1) USING (id)",
    "retention_apply": _REC + _left("SELECT id FROM cut, last WHERE m + 3600000000 - recorded_us >= cutoff UNION SELECT e.derived_id FROM gone JOIN edges e ON e.source_id = gone.id", _TIME) + f" SELECT {_STORED} FROM c",
    "export_bundle": _REC + "SELECT id, kind, recorded_us AS ts_us, coalesce(sources, '') AS sources FROM records LEFT JOIN (SELECT derived_id AS id, string_agg(source_id, ',' ORDER BY ordinal) AS sources FROM edges GROUP BY 1) USING (id) WHERE kind <> 'episode' AND recorded_us BETWEEN 60000000000 AND 3000000000000",
    "export_sink": _REC + ", x AS (SELECT id, kind, recorded_us AS ts_us FROM records WHERE kind <> 'episode' AND recorded_us BETWEEN 60000000000 AND 3000000000000) SELECT *, count(*) OVER () AS records FROM x",
    "pseudonymize": f"SELECT c_custkey, 'ble:' || sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(c_custkey::VARCHAR)))) AS pseudonym FROM customer",
    "hash_id": "SELECT c_custkey, 'id:' || sha256(c_custkey::VARCHAR) AS hashed FROM customer",
    "privacy_audit": f"{_w('audit_json')} SELECT a.id, t.fullkey AS path FROM audit_json a, json_tree(a.payload) t WHERE lower(t.key) IN ('ssid','bssid','device_name','peripheral_name','mac_address','raw_audio','raw_frame','raw_pcm','transcript')",
    "wifi_mode_a": f"{_w('wifi_hits')} SELECT scan_id, round(avg(rssi), 6) AS rssi_mean, round(avg(noise), 6) AS noise_mean, count(*) AS visible_network_count, coalesce(list_sort(list(rssi), 'DESC')[1], -2147483648) AS strongest_1, coalesce(list_sort(list(rssi), 'DESC')[2], -2147483648) AS strongest_2, coalesce(list_sort(list(rssi), 'DESC')[3], -2147483648) AS strongest_3 FROM wifi_hits GROUP BY 1",
    "frame_samples": f"SELECT event_id // {FRAME} AS frame, count(*) AS n, round(first(value ORDER BY event_id), 6) AS first, round(last(value ORDER BY event_id), 6) AS last FROM events GROUP BY 1 HAVING count(*) = {FRAME}",
    "audio_energy": _DFT + f"SELECT frame_id, {_r('rms', 'peak')} FROM energy",
    "zero_crossing_rate": _DFT + f"SELECT frame_id, {_r('zcr')} FROM zc",
    "magnitude_spectrum": _DFT + "SELECT frame_id, bin, round(m, 5) AS magnitude FROM mag",
    "spectral_centroid": _DFT + f"SELECT frame_id, {_r('hz', digits=3)} FROM cen",
    "spectral_rolloff": _DFT + f"SELECT frame_id, {_r('hz', digits=3)} FROM roll",
    "spectral_flatness": _DFT + f"SELECT frame_id, {_r('flatness')} FROM fl",
    "voice_activity": _DFT + f"SELECT frame_id, {_r('vad')} FROM vad",
    "audio_features": _DFT + f"SELECT frame_id, {_r('rms', 'peak')}, round(zcr, 6) AS zero_crossing_rate, round(cen.hz, 3) AS spectral_centroid_hz, round(roll.hz, 3) AS spectral_rolloff_hz, round(flatness, 6) AS spectral_flatness, round(vad, 6) AS voice_activity_probability FROM energy JOIN zc USING (frame_id) JOIN cen USING (frame_id) JOIN roll USING (frame_id) JOIN fl USING (frame_id) JOIN vad USING (frame_id)",
    "ble_windows": f"""{_w('ble_hits')}, e AS (SELECT ts_us // 5000000 * 5000000 AS w, 'ble:' || sha256(device::VARCHAR) AS p, CAST(trunc(sum(rssi) / count(*)) AS BIGINT) AS rssi FROM ble_hits GROUP BY 1, 2), g AS (SELECT w, count(*) AS n, sum(rssi) AS s, min(p) AS f FROM e GROUP BY 1), spine AS (SELECT unnest(range(min(w), max(w) + 1, 5000000)) AS w FROM g)
SELECT w AS window_us, coalesce(n, 0) AS cluster_count, coalesce(s, 0)::BIGINT AS rssi_sum, f AS first_pseudonym FROM spine LEFT JOIN g USING (w)""",
    "pose_filter": f"""WITH j AS (SELECT vec_id, i, abs(embedding[3 * i + 3])::DOUBLE AS c FROM embeddings, (SELECT unnest(range(20)) AS i) WHERE i < {_JOINTS}), k AS (SELECT * FROM j WHERE c >= 0.25)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS at, 'j' || i AS name, round(c, 6) AS confidence FROM k""",
    "pose_observation": "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'zero' ELSE 'one' END AS body_count FROM embeddings",
    "conflate_latest": BASE + "SELECT ledger_id, arrival // 100 AS batch, sensor_stream_id, arg_max(message_id, arrival) AS message_id, max(arrival) AS arrival FROM envelopes GROUP BY 1, 2, 3",
    "assign_sequence": BASE + "SELECT ledger_id, sensor_stream_id, arrival, row_number() OVER (PARTITION BY ledger_id, sensor_stream_id ORDER BY arrival) AS sequence FROM (SELECT ledger_id, sensor_stream_id, max(arrival) AS arrival FROM envelopes GROUP BY ledger_id, arrival // 100, sensor_stream_id)",
    "acceptance_status": BASE + """, e AS (SELECT DISTINCT ledger_id, sensor_stream_id FROM envelopes), c AS (SELECT ledger_id, sensor_stream_id, count(*) AS n FROM acc GROUP BY 1, 2)
SELECT ledger_id || '/' || sensor_stream_id AS stream, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'observed' WHEN ledger_id % 3 > 0 AND ledger_id % 2 = 1 THEN 'advertisers_detected_keychain_unavailable' WHEN ledger_id % 2 = 0 THEN 'no_advertisers_observed' ELSE 'unauthorized' END AS status FROM e LEFT JOIN c USING (ledger_id, sensor_stream_id)""",
    "ledger_counts": BASE + "SELECT ledger_id, count(*) AS total, count(*) FILTER (kind = 'sensor_gap') AS gaps, count(*) FILTER (kind = 'belief') AS beliefs, 0::BIGINT AS agent_runs FROM ledger GROUP BY 1",
    "stream_counts": BASE + f"SELECT ledger_id, stream_id, count(*) AS n {_OBS}",
    "recent_records": BASE + "SELECT l.ledger_id, l.sequence, l.id, l.kind, l.stream_id, l.ts_us, coalesce(e.sources, '') AS sources FROM (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY sequence DESC) <= 32) l LEFT JOIN (SELECT ledger_id, derived_id AS id, string_agg(source_id, ',' ORDER BY ordinal) AS sources FROM bedges GROUP BY 1, 2) e USING (ledger_id, id)",
    "recent_observations": BASE + "SELECT ledger_id, sequence, stream_id, ts_us FROM ledger QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY sequence DESC) <= 4096",
    "recent_zoom": BASE + "SELECT ledger_id, sequence, stream_id, ts_us FROM ledger QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY sequence DESC) <= 96",
    "latest_ts": BASE + f"SELECT ledger_id, stream_id, max(ts_us) AS ts_us {_OBS}",
    "observation_age": BASE + f"SELECT ledger_id, stream_id, greatest({ACK_US} - max(ts_us), 0) // 1000000 AS seconds {_OBS}",
    "observation_rates": BASE + f"SELECT ledger_id, stream_id, round(coalesce(count(*) / nullif((max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE, 0), 0), 6) AS rate {_OBS}",
    "day_buckets": f"{_w('retained_records')} SELECT ledger_id, recorded_us * 2 // 86400000000 AS day, count(*) AS n FROM retained_records WHERE kind <> 'sensor_gap' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY day DESC) <= 30",
    "telemetry": BASE + _TELE + f"SELECT ledger_id, {_r('camera_presence', 'audio_rms', 'audio_centroid_hz', 'audio_vad', 'wifi_rssi_mean', 'wifi_noise_mean', 'wifi_network_count', 'bluetooth_cluster_count', 'bluetooth_mean_rssi')} FROM tele",
    "latest_belief": BASE + f"SELECT ledger_id, id, {_r('probability', 'confidence', 'disagreement', 'health')}, modalities, state, array_to_string(derived_from, ',') AS evidence FROM beliefs QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY arrival DESC) = 1",
    "latest_joints": BASE + """SELECT ledger_id, id, kind, CASE WHEN kind = 'observation' THEN json_array_length(payload, '$.joints') END AS joints,
  CASE WHEN kind = 'observation' THEN round(coalesce(list_sum(list_transform(json_extract(payload, '$.joints[*]'), lambda j: CAST(json_extract(j, '$.x') AS DOUBLE) + 10 * CAST(json_extract(j, '$.y') AS DOUBLE) + 100 * CAST(json_extract(j, '$.confidence') AS DOUBLE))), 0), 6) END AS weighed
FROM ledger WHERE stream_id = 'camera' QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY sequence DESC) = 1""",
    "agent_runs": BASE + f"SELECT * FROM ({_RUNS}) QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY sequence DESC) <= 3",
    "density_histogram": BASE + """, e AS (SELECT ledger_id, min(ts_us) AS lo, max(ts_us) AS hi FROM ledger GROUP BY 1), h AS (SELECT ledger_id, CASE stream_id WHEN 'camera' THEN 0 WHEN 'microphone' THEN 1 WHEN 'wifi' THEN 2 WHEN 'bluetooth' THEN 3 ELSE 4 END AS lane, CAST(floor((ts_us - lo) / greatest(hi - lo, 1)::DOUBLE * 95) AS BIGINT) AS bin, count(*) AS n FROM ledger JOIN e USING (ledger_id) GROUP BY 1, 2, 3)
SELECT *, max(n) OVER (PARTITION BY ledger_id) AS most FROM h""",
    "events_list": BASE + "SELECT ledger_id, sequence, id, kind, ts_us FROM ledger",
    "event_show": BASE + "SELECT ledger_id, sequence, id, kind, stream_id, payload FROM ledger WHERE id = 'm75'",
    "ledger_summary": BASE + """SELECT l.ledger_id, l.total, l.gaps, l.beliefs, 0::BIGINT AS agent_runs, coalesce(e.n, 0) AS episodes, coalesce(p.n, 0) AS patterns, coalesce(s.t, '') AS streams, coalesce(w.t, '') AS pending
FROM (SELECT ledger_id, count(*) AS total, count(*) FILTER (kind = 'sensor_gap') AS gaps, count(*) FILTER (kind = 'belief') AS beliefs FROM ledger GROUP BY 1) l
LEFT JOIN (SELECT ledger_id, count(*) AS n FROM episodes GROUP BY 1) e USING (ledger_id) LEFT JOIN (SELECT ledger_id, count(*) AS n FROM patterns GROUP BY 1) p USING (ledger_id)
LEFT JOIN (SELECT ledger_id, string_agg(stream_id || ':' || n, ' ' ORDER BY stream_id || ':' || n) AS t FROM (SELECT ledger_id, stream_id, count(*) AS n FROM ledger WHERE kind = 'observation' GROUP BY 1, 2) GROUP BY 1) s USING (ledger_id)
LEFT JOIN (SELECT ledger_id, string_agg(sensor_stream_id, ',' ORDER BY sensor_stream_id) AS t FROM state WHERE pending GROUP BY 1) w USING (ledger_id)""",
}
ORACLES |= {f"recent_zoom_{n}": BASE + f"SELECT ledger_id, sequence, stream_id, ts_us FROM ledger QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY sequence DESC) <= {n}" for n in (24, 256, 1024, 4096)}
