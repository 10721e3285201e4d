"""Incidents, the chain, the store, evaluation, sets and sorts over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alerts as fn
from ..functions import scalars
from ..operators import chain, evaluation, joins, lifecycle, store
from . import views
from .registry import query
from .scalar_queries import DEDUP_SQL, SEVERITY_SQL
from .views import sql

C = F.col

KEYED = f"keyed AS (SELECT *, {DEDUP_SQL} AS dedup_key, substr(sha256({DEDUP_SQL}), 1, 16) AS incident_id, {SEVERITY_SQL} AS severity FROM v_alert)"
UPDATES = KEYED + """, u AS (SELECT *, row_number() OVER w AS ordinal, sum(packets) OVER w AS event_count, max(score) OVER w AS peak, max(list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)) OVER w AS rank, first_value(t_us) OVER w AS first_us, max(t_us) OVER w AS last_us FROM keyed
WINDOW w AS (PARTITION BY incident_id ORDER BY t_us, event_seq ROWS UNBOUNDED PRECEDING)),
led AS (SELECT *, CASE WHEN ordinal = 1 THEN 'NEW' WHEN ordinal = 2 THEN 'ACTIVE' ELSE 'UPDATED' END AS status, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][rank] AS top_severity FROM u)"""
SNAP = UPDATES + ", snap AS (SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY ordinal DESC) = 1)"


def _alerts(spark, d):
    return lifecycle.keyed(views.alert(spark, d)).withColumns({"severity": fn.severity_of(C("score"), F.lit("anomaly_score")), "event_count": C("packets"), "score_type": F.lit("anomaly_score")})


def _updates(spark, d):
    return lifecycle.updates(_alerts(spark, d))


@query("alert_contract", sql("WITH " + KEYED + """, r AS (SELECT *, CASE WHEN detector IN ('scan', 'dga') THEN src_ip WHEN detector = 'c2' THEN '["' || src_ip || '","' || dst_ip || '",' || dst_port || ']' WHEN detector = 'dns' THEN '["' || src_ip || '","NOT_OBSERVABLE"]' WHEN detector = 'exfil' THEN '["' || src_ip || '","' || dst_ip || '"]' WHEN detector = 'tls_quic' THEN '["' || src_ip || '","NOT_OBSERVABLE","' || dst_ip || '"]' ELSE dedup_key END AS text FROM keyed)
SELECT event_seq, '1.3' AS schema_version, substr(sha256(text), 1, 16) AS flow_id, CASE WHEN detector IN ('scan', 'dga') THEN 'entity' ELSE 'aggregate' END AS flow_ref_type, incident_id, dedup_key, severity, 'NEW' AS status, packets AS event_count, t_us AS first_us, t_us AS last_us, FALSE AS calibrated FROM r""", "v_alert"))
def alert_contract(spark, d):
    a = _alerts(spark, d).withColumns({"confidence": F.lit(None).cast("double"), "calibrated_on": F.lit(None).cast("string")})
    return lifecycle.contract(fn.scored(a)).select("event_seq", "schema_version", "flow_id", "flow_ref_type", "incident_id", "dedup_key", "severity", "status", "event_count", "first_us", "last_us", "calibrated")


def _ledger(spark, d):
    """Updates with their arrival as seq."""
    return _updates(spark, d).withColumns({"seq": C("event_seq"), "last_observed": scalars.iso8601(C("last_observed_us")), "created_at": C("t_us")})


@query("dedup_lifecycle", sql("WITH " + UPDATES + " SELECT event_seq, incident_id, ordinal, status, event_count, round(peak, 6) AS score, top_severity AS severity, first_us AS first_observed_us, last_us AS last_observed_us, round(greatest((last_us - first_us) / 1e6, 0.001), 6) AS duration_s FROM led", "v_alert"))
def dedup_lifecycle(spark, d):
    return _updates(spark, d).select("event_seq", "incident_id", C("ordinal").cast("long").alias("ordinal"), "status", "event_count", F.round("score", 6).alias("score"), "severity", "first_observed_us", "last_observed_us", F.round("duration_s", 6).alias("duration_s"))


@query("dedup_merge", sql("WITH " + KEYED + ", f AS (SELECT incident_id, src_ip AS flow, min((t_us - 1700000000000000) * 100000 + event_seq) AS o FROM keyed GROUP BY 1, 2), g AS (SELECT incident_id, list(flow ORDER BY o)[1:32] AS flows FROM f GROUP BY 1), e AS (SELECT incident_id, arg_max(k, (t_us - 1700000000000000) * 100000 + event_seq) AS k, arg_max(event_seq, (t_us - 1700000000000000) * 100000 + event_seq) FILTER (event_seq % 2 = 0) AS even FROM keyed GROUP BY 1) SELECT incident_id, array_to_string(flows, ',') AS flows, CAST(k AS VARCHAR) AS k, CAST(even AS VARCHAR) AS even FROM g JOIN e USING (incident_id)", "v_alert"))
def dedup_merge(spark, d):
    even = F.map_filter(F.create_map(F.lit("even"), C("event_seq").cast("string")), lambda _, v: C("event_seq") % 2 == 0)
    a = _alerts(spark, d).withColumns({"flows": F.array("src_ip"), "evidence": F.map_concat(F.create_map(F.lit("k"), C("k").cast("string")), even)})
    i = lifecycle.incidents(lifecycle.updates(a))
    return i.select("incident_id", F.array_join("flows", ",").alias("flows"), F.try_element_at("evidence", F.lit("k")).alias("k"), F.try_element_at("evidence", F.lit("even")).alias("even"))


@query("incident_confidence", sql("WITH " + KEYED + ", c AS (SELECT incident_id, CASE WHEN event_seq % 4 > 0 THEN round(least(score, 1), 1) END AS conf, event_seq, t_us FROM keyed) SELECT incident_id, max(conf) AS confidence, 's' || arg_max(event_seq, (t_us - 1700000000000000) * 100000 + event_seq) FILTER (conf = m) AS source FROM (SELECT *, max(conf) OVER (PARTITION BY incident_id) AS m FROM c) GROUP BY 1", "v_alert"))
def incident_confidence(spark, d):
    a = _alerts(spark, d).withColumns({"confidence": F.when(C("event_seq") % 4 > 0, F.round(F.least("score", F.lit(1.0)), 1)), "calibrated_on": F.concat(F.lit("s"), "event_seq")})
    return lifecycle.incidents(lifecycle.updates(a)).select("incident_id", "confidence", C("calibrated_on").alias("source"))


@query("resolve_sweep", sql("WITH " + SNAP + " SELECT incident_id, CASE WHEN (SELECT max(last_us) FROM snap) - last_us >= 432000000000 THEN 'RESOLVED' ELSE status END AS status FROM snap", "v_alert"))
def resolve_sweep(spark, d):
    from ..config import LifecycleConfig

    i = lifecycle.incidents(_updates(spark, d))
    now = i.agg(F.max("last_observed_us")).first()[0]
    return lifecycle.resolved(i, now, LifecycleConfig(resolve_s=5 * 86_400.0)).select("incident_id", "status")


@query("lru_eviction", sql("WITH " + SNAP + " SELECT incident_id FROM snap ORDER BY last_us DESC, incident_id LIMIT 25", "v_alert"))
def lru_eviction(spark, d):
    return lifecycle.most_recent(lifecycle.incidents(_updates(spark, d)), 25).select("incident_id")


@query("incident_snapshot", sql("WITH " + SNAP + ", f AS (SELECT incident_id, arg_min(t_us, event_seq) AS created_at FROM led GROUP BY 1), l AS (SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY event_seq DESC) = 1) SELECT l.incident_id, event_seq AS seq, created_at, status, event_count FROM l JOIN f USING (incident_id)", "v_alert"))
def incident_snapshot(spark, d):
    return store.snapshot(_ledger(spark, d)).select("incident_id", "seq", "created_at", "status", "event_count")


@query("incident_ledger", sql("WITH " + UPDATES + " SELECT event_seq AS seq, incident_id, status FROM led", "v_alert"))
def incident_ledger(spark, d):
    return _ledger(spark, d).select("seq", "incident_id", "status")


@query("metadata_kv", sql("SELECT 'user' || (user_id % 10) AS key, CAST(arg_max(k, (t_us - 1700000000000000) * 100000 + event_seq) AS VARCHAR) AS value FROM v_flow GROUP BY 1", "v_flow"))
def metadata_kv(spark, d):
    w = views.flow(spark, d).select(F.concat(F.lit("user"), C("user_id") % 10).alias("key"), C("k").cast("string").alias("value"), C("t_us").alias("updated_at"), C("event_seq").alias("seq"))
    return store.metadata_latest(w)


@query("list_incidents", sql("WITH " + UPDATES + ", l AS (SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY event_seq DESC) = 1) SELECT incident_id, event_seq AS seq FROM l WHERE status = 'NEW' ORDER BY last_us DESC, event_seq DESC LIMIT 20 OFFSET 5", "v_alert"))
def list_incidents(spark, d):
    return store.incidents_page(store.snapshot(_ledger(spark, d)), status="NEW", limit=20, offset=5).select("incident_id", "seq")


@query("incident_history", sql("WITH " + UPDATES + " SELECT event_seq AS seq, status FROM led WHERE incident_id = substr(sha256('[\"Port scanning / reconnaissance\",\"10.10.0.7\"]'), 1, 16)", "v_alert"))
def incident_history(spark, d):
    ledger = _ledger(spark, d)
    own = spark.range(1).select(scalars.identifier(F.lit('["Port scanning / reconnaissance","10.10.0.7"]'))).first()[0]
    return joins.history_or_nothing(ledger, store.snapshot(ledger), own).select("seq", "status")


@query("incident_update_join", sql("WITH " + UPDATES + " SELECT event_seq AS seq FROM led WHERE incident_id IN (SELECT incident_id FROM keyed WHERE detector = 'exfil')", "v_alert"))
def incident_update_join(spark, d):
    ledger = _ledger(spark, d)
    return joins.updates_of(ledger, ledger.where("detector = 'exfil'")).select("seq")


@query("ring_buffer_merge", sql("WITH " + UPDATES + ", l AS (SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY event_seq % 2 DESC, event_seq DESC) = 1) SELECT incident_id, event_seq AS seq FROM l ORDER BY last_us DESC, event_seq DESC LIMIT 50", "v_alert"))
def ring_buffer_merge(spark, d):
    ledger = _ledger(spark, d)
    return store.merged_ring(ledger.where("seq % 2 = 0"), ledger.where("seq % 2 = 1"), 50).select("incident_id", "seq")


@query("export_json", sql("""WITH """ + UPDATES + """ SELECT event_seq AS seq, '{"incident_id":"' || incident_id || '","seq":' || event_seq || ',"status":"' || status || '"}' AS json FROM led""", "v_alert"))
def export_json(spark, d):
    return store.export_json(_ledger(spark, d).select("incident_id", "seq", "status"))


@query("export_csv", sql("""SELECT event_seq AS seq, CAST(k AS VARCHAR) AS evidence_k, CASE WHEN event_seq % 2 = 0 THEN dst_ip ELSE '' END AS evidence_target_ip, CASE WHEN event_seq % 2 = 0 THEN CAST(dst_port AS VARCHAR) ELSE '' END AS evidence_target_port, '[1,2]' AS evidence_list FROM v_alert""", "v_alert"))
def export_csv(spark, d):
    target = F.when(C("event_seq") % 2 == 0, F.struct(C("dst_ip").alias("ip"), C("dst_port").alias("port")))
    a = views.alert(spark, d).select(C("event_seq").alias("seq"), F.to_json(F.struct("k", target.alias("target"), F.array(F.lit(1), F.lit(2)).alias("list"))).alias("evidence"))
    out = store.export_table(a, ["seq"])
    return out.toDF(*[c.replace(".", "_") for c in out.columns])


DEEP = [("k", "k"), ("a.ip", "dst_ip"), ("a.b.port", "dst_port"), ("a.b.c.n", "event_seq"), ("a.b.c.d.text", "'{' || src_ip"), ("a.b.c.list", "'[' || k || ',{\"z\":1}]'"), ("a.b.dot.ted", "detector")]


@query("flatten_evidence", sql(" UNION ALL ".join(f"SELECT event_seq, '{key}' AS key, CAST({value} AS VARCHAR) AS value FROM v_alert" for key, value in DEEP), "v_alert"))
def flatten_evidence(spark, d):
    """Evidence of five levels with a list, a text like an object and a dotted key, by key."""
    a = views.alert(spark, d)
    c = F.struct(C("event_seq").alias("n"), F.struct(F.concat(F.lit("{"), "src_ip").alias("text")).alias("d"), F.array(C("k").cast("string"), F.lit("Z")).alias("list"))
    deep = F.struct("k", F.struct(C("dst_ip").alias("ip"), F.struct(C("dst_port").alias("port"), c.alias("c"), C("detector").alias("dot.ted")).alias("b")).alias("a"))
    text = F.regexp_replace(F.to_json(deep), r'\["(\d+)","Z"\]', r'[$1,{"z":1}]')
    return store.flattened(a.select("event_seq", text.alias("evidence")), levels=3).select("event_seq", F.explode("flat").alias("key", "value"))


@query("count_incidents", sql("WITH " + SNAP + " SELECT (SELECT count(*) FROM snap) AS incidents, (SELECT count(*) FROM led) AS updates", "v_alert"))
def count_incidents(spark, d):
    ledger = _ledger(spark, d)
    return store.health(store.snapshot(ledger), ledger)


@query("severity_counts", sql("WITH " + SNAP + " SELECT s AS severity, (SELECT count(*) FROM snap WHERE top_severity = s) AS n FROM (SELECT unnest(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS s)", "v_alert"))
def severity_counts(spark, d):
    return store.severity_counts(lifecycle.incidents(_updates(spark, d)))


@query("class_breakdown", sql("WITH " + SNAP + """ SELECT CASE detector WHEN 'scan' THEN 'Port scanning / reconnaissance' WHEN 'dga' THEN 'DGA / DNS tunnelling' WHEN 'dns' THEN 'DGA / DNS tunnelling' WHEN 'c2' THEN 'Botnet C2 beaconing' WHEN 'exfil' THEN 'Data exfiltration' WHEN 'tls_quic' THEN 'Malware in encrypted sessions' ELSE 'Volumetric DDoS / flooding' END AS ps_class, count(*) AS n FROM snap GROUP BY 1""", "v_alert"))
def class_breakdown(spark, d):
    return store.class_breakdown(lifecycle.incidents(_updates(spark, d)))


@query("payload_hash", sql("""SELECT event_seq, sha256('{"a":{"x":' || k || ',"y":"é"},"k":' || k || '}') AS by_keys, sha256('{"dst_ip":"' || dst_ip || '","src_ip":"' || src_ip || '"}') AS by_struct FROM v_alert""", "v_alert"))
def payload_hash(spark, d):
    text = F.concat(F.lit('{"seq": 5, "k": '), "k", F.lit(', "a": {"y": "é", "x": '), "k", F.lit("}}"))
    return views.alert(spark, d).select("event_seq", chain.payload_hash(text).alias("by_keys"), chain.struct_hash(["src_ip", "dst_ip"]).alias("by_struct"))


CHAIN = """RECURSIVE e AS (SELECT row_number() OVER (ORDER BY event_seq) AS seq, CAST(event_seq AS VARCHAR) AS incident_id, CAST(t_us AS VARCHAR) AS last_observed, sha256(dst_ip) AS payload_hash FROM v_alert),
c AS (SELECT seq, incident_id, last_observed, payload_hash, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || seq || incident_id || last_observed || payload_hash) AS entry_hash FROM e WHERE seq = 1
UNION ALL SELECT e.seq, e.incident_id, e.last_observed, e.payload_hash, c.entry_hash, sha256(c.entry_hash || e.seq || e.incident_id || e.last_observed || e.payload_hash) FROM c JOIN e ON e.seq = c.seq + 1)
SELECT seq, incident_id, prev_hash, entry_hash FROM c"""


def _chain(spark, d):
    a = views.alert(spark, d).select(C("event_seq").alias("order"), C("event_seq").cast("string").alias("incident_id"), C("t_us").cast("string").alias("last_observed"), F.sha2("dst_ip", 256).alias("payload_hash"))
    return chain.sealed(a)


@query("hash_chain_append", "WITH " + CHAIN.replace("RECURSIVE e", "RECURSIVE " + sql("SELECT 1", "v_alert").removeprefix("WITH ").removesuffix("\nSELECT 1") + ",\ne"))
def hash_chain_append(spark, d):
    return _chain(spark, d).select("seq", "incident_id", "prev_hash", "entry_hash")


@query("hash_chain_verify", sql("SELECT FALSE AS valid, count(*) AS entries, 20 AS index, 'entry_hash' AS fault FROM v_alert", "v_alert"))
def hash_chain_verify(spark, d):
    """An entry whose incident was changed after it was sealed."""
    broken = _chain(spark, d).withColumn("incident_id", F.when(C("seq") == 21, "x").otherwise(C("incident_id")))
    return chain.verified(broken)


@query("allocate_chain_latest", sql("SELECT count(*) AS seq FROM v_alert", "v_alert"))
def allocate_chain_latest(spark, d):
    return chain.latest(_chain(spark, d)).select("seq")


ATTRIBUTED = """al AS (SELECT event_seq AS alert_id, detector, substr('abcdef', CAST(event_seq % 6 + 1 AS INT), 1) AS letter, src_ip, dst_ip, t_us AS first_us, t_us + 1000000 AS last_us, CAST(event_seq % 40 AS VARCHAR) AS incident_id FROM v_alert),
fit AS (SELECT alert_id, attack_id, l.letter AS attack_letter, t_start, l.letter = al.letter AS same FROM al JOIN v_label l ON l.key_ip IN (al.src_ip, al.dst_ip) AND first_us <= t_end + 120000000 AND last_us >= t_start - 5000000),
best AS (SELECT alert_id, coalesce(arg_max(attack_id, t_start) FILTER (same), arg_min(attack_id, t_start)) AS attack_id, coalesce(arg_max(attack_letter, t_start) FILTER (same), arg_min(attack_letter, t_start)) AS attack_letter FROM fit GROUP BY 1),
att AS (SELECT al.*, attack_id, attack_letter FROM al LEFT JOIN best USING (alert_id))"""


def _attributed(spark, d):
    a = views.alert(spark, d).select(C("event_seq").alias("alert_id"), "detector", F.substr(F.lit("abcdef"), (C("event_seq") % 6 + 1).cast("int"), F.lit(1)).alias("letter"), F.array("src_ip", "dst_ip").alias("ips"), C("t_us").alias("first_us"), (C("t_us") + 1_000_000).alias("last_us"), (C("event_seq") % 40).cast("string").alias("incident_id"))
    return joins.attributed(a, views.label(spark, d).withColumn("key_ips", F.array("key_ip")))


@query("alert_attribution", sql("WITH " + ATTRIBUTED + " SELECT alert_id, attack_id, attack_letter FROM att", "v_alert", "v_label"))
def alert_attribution(spark, d):
    return _attributed(spark, d).select("alert_id", "attack_id", "attack_letter")


@query("class_letter", sql("WITH " + KEYED + " SELECT event_seq, CASE detector WHEN 'scan' THEN 'e' WHEN 'dga' THEN 'c' WHEN 'dns' THEN 'c' WHEN 'c2' THEN 'b' WHEN 'exfil' THEN 'f' WHEN 'tls_quic' THEN 'd' ELSE 'a' END AS letter FROM keyed", "v_alert"))
def class_letter(spark, d):
    return joins.with_letter(lifecycle.keyed(views.alert(spark, d))).select("event_seq", "letter")


@query("eval_per_class", sql("WITH " + ATTRIBUTED + """, n AS (SELECT letter, count(DISTINCT attack_id) AS attacks FROM v_label GROUP BY 1), f AS (SELECT letter, count(DISTINCT attack_id) AS detected FROM att WHERE attack_letter = letter GROUP BY 1),
a AS (SELECT letter, count(*) AS alerts, count(*) FILTER (attack_letter = letter) AS true_alerts, count(*) FILTER (attack_letter <> letter) AS overlap_alerts, count(*) FILTER (attack_id IS NULL) AS false_alerts, count(DISTINCT incident_id) FILTER (attack_id IS NULL) AS false_incidents FROM att GROUP BY 1)
SELECT letter, coalesce(attacks, 0) AS attacks, coalesce(detected, 0) AS detected, coalesce(alerts, 0) AS alerts, coalesce(true_alerts, 0) AS true_alerts, coalesce(overlap_alerts, 0) AS overlap_alerts, coalesce(false_alerts, 0) AS false_alerts, coalesce(false_incidents, 0) AS false_incidents,
CASE WHEN attacks > 0 THEN round(coalesce(detected, 0) / attacks, 3) END AS recall FROM n LEFT JOIN f USING (letter) FULL JOIN a USING (letter)""", "v_alert", "v_label"))
def eval_per_class(spark, d):
    return evaluation.per_class(_attributed(spark, d), views.label(spark, d), 24.0).select("letter", "attacks", "detected", "alerts", "true_alerts", "overlap_alerts", "false_alerts", "false_incidents", "recall")


@query("eval_per_attack", sql("WITH " + ATTRIBUTED + " SELECT attack_id, detector, count(*) AS alerts FROM att WHERE attack_id IS NOT NULL GROUP BY 1, 2", "v_alert", "v_label"))
def eval_per_attack(spark, d):
    return evaluation.per_attack(_attributed(spark, d))


@query("overlap_matrix", sql("WITH " + ATTRIBUTED + " SELECT letter, " + ", ".join(f"count(*) FILTER (attack_letter = '{x}') AS {x}" for x in "abcdef") + " FROM att WHERE attack_letter IS NOT NULL GROUP BY 1", "v_alert", "v_label"))
def overlap_matrix(spark, d):
    return evaluation.overlap_matrix(_attributed(spark, d))


@query("false_alerts_benign", sql("WITH " + ATTRIBUTED + " SELECT letter, detector, count(*) AS n, round(count(*) / 24e0, 3) AS per_hour FROM att WHERE attack_id IS NULL GROUP BY ROLLUP (letter, detector)", "v_alert", "v_label"))
def false_alerts_benign(spark, d):
    return evaluation.false_alerts(_attributed(spark, d), 24.0)


PAIRS = "p AS (SELECT round(least(score, 1), 3) AS p, CAST(event_seq % 3 = 0 AS INT) AS y, detector, k FROM v_alert)"


def _pairs(spark, d):
    return views.alert(spark, d).select(F.round(F.least("score", F.lit(1.0)), 3).alias("p"), (C("event_seq") % 3 == 0).cast("int").alias("y"), "detector", "k")


@query("class_report", sql("""WITH c AS (SELECT detector AS t, ['ddos', 'scan', 'c2'][k % 3 + 1] AS p FROM v_alert), n AS (SELECT DISTINCT unnest([t, p]) AS class FROM c),
r AS (SELECT class, count(*) FILTER (t = class AND p = class) AS tp, count(*) FILTER (t <> class AND p = class) AS fp, count(*) FILTER (t = class AND p <> class) AS fn FROM n, c GROUP BY 1)
SELECT class, tp, fp, fn, tp + fn AS support, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) ELSE 0 END AS f1 FROM r""", "v_alert"))
def class_report(spark, d):
    pairs = views.alert(spark, d).select(C("detector").alias("truth"), F.element_at(scalars.any_of(["ddos", "scan", "c2"]), C("k") % 3 + 1).alias("predicted"))
    return evaluation.class_report(pairs)


@query("reliability_bins", sql("WITH " + PAIRS + " SELECT CAST(least(floor(p * 5), 4) AS INT) AS bin, count(*) AS n, round(avg(p), 4) AS mean_p, round(avg(y), 4) AS observed FROM p GROUP BY 1", "v_alert"))
def reliability_bins(spark, d):
    return evaluation.reliability(_pairs(spark, d))


@query("brier_roc_auc", sql("WITH " + PAIRS + " SELECT (SELECT round(avg((p - y) * (p - y)), 6) FROM p) AS brier, round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auc FROM p a, p b WHERE a.y = 1 AND b.y = 0", "v_alert"))
def brier_roc_auc(spark, d):
    pairs = _pairs(spark, d)
    return evaluation.brier(pairs).select(F.round("brier", 6).alias("brier")).join(evaluation.roc_auc(pairs).select(F.round("auc", 6).alias("auc")), how="cross")


@query("brier_by_detector", sql("WITH " + PAIRS + " SELECT detector, count(*) AS n, sum(y) AS positives, round(avg((p - y) * (p - y)), 4) AS brier, round(avg(p), 4) AS mean_confidence, string_agg(DISTINCT CASE WHEN k % 2 = 0 THEN 'platt_dga' ELSE 'uncalibrated' END, ',' ORDER BY CASE WHEN k % 2 = 0 THEN 'platt_dga' ELSE 'uncalibrated' END) AS sources FROM p GROUP BY 1", "v_alert"))
def brier_by_detector(spark, d):
    p = _pairs(spark, d).withColumnsRenamed({"p": "confidence", "y": "truth"}).withColumn("calibrated_on", F.when(C("k") % 2 == 0, "platt_dga").otherwise("uncalibrated"))
    return evaluation.brier_by_detector(p)


@query("latency_percentiles", sql("WITH o AS (SELECT bytes AS v, row_number() OVER (ORDER BY bytes) AS r, count(*) OVER () AS n FROM v_flow) SELECT min(v) FILTER (r >= round(0.5 * n)) AS p50, min(v) FILTER (r >= round(0.95 * n)) AS p95, min(v) FILTER (r >= round(0.99 * n)) AS p99, max(v) AS max FROM o", "v_flow"))
def latency_percentiles(spark, d):
    return evaluation.latency_percentiles(views.flow(spark, d), "bytes")


@query("fold_split", sql("SELECT event_seq, CASE WHEN protocol = 'UDP' THEN 'family_holdout' WHEN src_ip = '10.10.0.7' THEN 'entity_holdout' WHEN t_us >= 1705276800000000 THEN 'time_holdout' ELSE 'train' END AS fold, CAST('0x' || substr(sha256(src_ip), 1, 8) AS BIGINT) % 5 AS bucket FROM v_flow", "v_flow"))
def fold_split(spark, d):
    f = views.flow(spark, d).withColumns({"family": C("protocol"), "entity": C("src_ip")})
    return evaluation.grouped_split(evaluation.fold_of(f, "UDP", "10.10.0.7", 1_705_276_800_000_000), "src_ip").select("event_seq", "fold", "bucket")


@query("leave_one_family_out", sql("SELECT event_type AS family, (SELECT count(*) FROM events) - count(*) AS train, count(*) AS held FROM events GROUP BY 1"))
def leave_one_family_out(spark, d):
    from functools import reduce

    parts = evaluation.leave_one_out(views.table(spark, d, "events"), "event_type")
    rows = [a.agg(F.count(F.lit(1)).alias("train")).join(b.agg(F.count(F.lit(1)).alias("held")), how="cross").withColumn("family", F.lit(k)) for k, (a, b) in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("distinct_canonical_domain", sql("SELECT string_split(qname, '.')[-2] || '.' || string_split(qname, '.')[-1] AS domain, qname, t_us FROM v_dns QUALIFY row_number() OVER (PARTITION BY string_split(qname, '.')[-2] || '.' || string_split(qname, '.')[-1] ORDER BY t_us, qname) = 1", "v_dns"))
def distinct_canonical_domain(spark, d):
    from ..functions.domains import registered_domain_dataset

    return evaluation.earliest_by_domain(views.dns(spark, d).withColumn("domain", registered_domain_dataset(C("qname")))).select("domain", "qname", "t_us")


@query("union_streams", sql("SELECT event_seq, t_us, 0 AS kind FROM v_flow UNION ALL SELECT event_seq, t_us, 1 FROM v_dns", "v_flow", "v_dns"))
def union_streams(spark, d):
    a, b = views.flow(spark, d).withColumn("kind", F.lit(0)), views.dns(spark, d).withColumn("kind", F.lit(1))
    return a.unionByName(b, allowMissingColumns=True).select("event_seq", "t_us", "kind").orderBy("t_us", "event_seq")


@query("set_difference", sql("SELECT DISTINCT src_ip AS ip FROM v_flow EXCEPT SELECT key_ip FROM v_label", "v_flow", "v_label"))
def set_difference(spark, d):
    return views.flow(spark, d).select(C("src_ip").alias("ip")).distinct().exceptAll(views.label(spark, d).select(C("key_ip").alias("ip")).distinct())


@query("set_intersection", sql("SELECT DISTINCT src_ip AS ip FROM v_flow INTERSECT SELECT key_ip FROM v_label", "v_flow", "v_label"))
def set_intersection(spark, d):
    return views.flow(spark, d).select(C("src_ip").alias("ip")).intersect(views.label(spark, d).select(C("key_ip").alias("ip")))


@query("sample_topk", sql("SELECT src_ip, array_to_string(list_sort(list(DISTINCT dst_port))[1:10], ',') AS ports, array_to_string(list(k ORDER BY t_us, event_seq)[-10:], ',') AS last FROM v_flow GROUP BY 1", "v_flow"))
def sample_topk(spark, d):
    last = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("t_us", "event_seq", "k")))), 1, 10)
    g = views.flow(spark, d).groupBy("src_ip").agg(F.slice(F.sort_array(F.collect_set("dst_port")), 1, 10).alias("p"), F.reverse(last)["k"].alias("l"))
    return g.select("src_ip", F.array_join("p", ",").alias("ports"), F.array_join("l", ",").alias("last"))


@query("event_time_sort", sql("SELECT event_seq, row_number() OVER (ORDER BY t_us, event_seq) AS place FROM v_flow", "v_flow"))
def event_time_sort(spark, d):
    """The place of every flow in the order of all flows."""
    return store.placed(views.flow(spark, d), "t_us", "event_seq").select("event_seq", "place")
