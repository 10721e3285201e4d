"""Windows, aggregates, detectors and joins over the derived views, with settings scaled to how sparse these are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import C2Config, DdosConfig, DgaConfig, DnsConfig, ExfilConfig, ReflectionConfig, ScanConfig, SlowlorisConfig, TlsConfig
from ..functions import scalars
from ..operators import aggregates, detectors, flood, joins, sessions
from . import replay, views
from .registry import query
from .scalar_queries import CORE
from .views import sql

C = F.col
HOUR = 3_600_000_000
DAY = 24 * HOUR

WINDOW = f"""
w AS (SELECT t_us // {HOUR} * {HOUR} AS w_us, * FROM v_flow),
one AS (SELECT w_us, count(*) AS event_count, sum(packets) AS packets, sum(bytes) AS bytes, sum(CAST(protocol = 'UDP' AS INT)) AS udp, sum(CAST(direction = 'inbound' AS INT)) AS inbound, count(DISTINCT src_ip) AS unique_src, count(DISTINCT dst_port) AS unique_dst_ports,
  sum(CASE WHEN tcp_flags = 2 THEN 2 WHEN tcp_flags = 18 THEN 1 ELSE 0 END) AS syn, sum(CASE WHEN tcp_flags = 16 THEN 2 WHEN tcp_flags IN (18, 24, 17) THEN 1 ELSE 0 END) AS ack FROM w GROUP BY 1),
srcs AS (SELECT w_us, src_ip, sum(packets) AS n FROM w GROUP BY 1, 2), se AS (SELECT w_us, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS src_entropy FROM srcs GROUP BY 1),
dsts AS (SELECT w_us, dst_ip, sum(packets) AS n, min(event_seq) AS f FROM w GROUP BY 1, 2), de AS (SELECT w_us, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS dst_entropy FROM dsts GROUP BY 1),
td AS (SELECT w_us, dst_ip AS top_dst_ip FROM dsts QUALIFY row_number() OVER (PARTITION BY w_us ORDER BY n DESC, f) = 1),
fl AS (SELECT w_us, src_ip, dst_ip, src_port, dst_port, protocol, sum(packets) AS n FROM w GROUP BY ALL), ts AS (SELECT w_us, max(n) / sum(n) AS top_flow_share FROM fl GROUP BY 1),
win AS (SELECT *, packets / 3600.0::DOUBLE AS pps FROM one JOIN se USING (w_us) JOIN de USING (w_us) JOIN td USING (w_us) JOIN ts USING (w_us))
"""


def _windows(spark, d):
    from ..functions.scalars import tcp_flag_letters

    return aggregates.windows(views.flow(spark, d).withColumn("tcp_flags_str", tcp_flag_letters(C("tcp_flags"))), 3600.0)


@query("window_summary", sql("WITH " + WINDOW + "SELECT w_us, event_count, packets, bytes, udp, inbound, syn, ack, unique_src, unique_dst_ports, top_dst_ip, round(src_entropy, 6) AS src_entropy, round(dst_entropy, 6) AS dst_entropy, round(top_flow_share, 6) AS top_flow_share, round(pps, 9) AS pps FROM win", "v_flow"))
def window_summary(spark, d):
    w = _windows(spark, d)
    return w.select("w_us", "event_count", "packets", "bytes", "udp", "inbound", "syn", "ack", "unique_src", "unique_dst_ports", "top_dst_ip", *[F.round(c, 6).alias(c) for c in ("src_entropy", "dst_entropy", "top_flow_share")], F.round("pps", 9).alias("pps"))


@query("window_samples", sql(f"""WITH r AS (SELECT t_us // {HOUR} * {HOUR} AS w_us, *, row_number() OVER (PARTITION BY t_us // {HOUR} ORDER BY md5(CAST(event_seq AS VARCHAR)), event_seq) AS rn FROM v_flow)
SELECT w_us, count(*) AS n, string_agg(event_seq || ' ' || src_ip || ' ' || dst_ip, ',' ORDER BY rn) AS samples FROM r WHERE rn <= 8 GROUP BY 1""", "v_flow"))
def window_samples(spark, d):
    """Eight events of every hour, the same ones however the table is divided."""
    s = aggregates.window_samples(views.flow(spark, d), 3600.0, ["src_ip", "dst_ip"])
    return s.select("w_us", "n", F.array_join(F.transform("samples", lambda e: F.concat_ws(" ", e["event_seq"], e["src_ip"], e["dst_ip"])), ",").alias("samples"))


@query("tumbling_window", sql(f"SELECT t_us // {HOUR} * {HOUR} AS w_us, count(*) AS n FROM v_flow GROUP BY 1", "v_flow"))
def tumbling_window(spark, d):
    w = F.window(F.timestamp_micros("t_us"), "1 hour")
    return views.flow(spark, d).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("w_us"), "n")


@query("entropy_weighted", sql("WITH s AS (SELECT direction, src_ip, sum(packets) AS n FROM v_flow GROUP BY 1, 2) SELECT direction, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS h, count(*) AS distinct_src FROM s GROUP BY 1", "v_flow"))
def entropy_weighted(spark, d):
    from ..functions.features import entropy_from_counts

    s = views.flow(spark, d).groupBy("direction", "src_ip").agg(F.sum("packets").alias("n"))
    return s.groupBy("direction").agg(F.round(entropy_from_counts(C("n")), 6).alias("h"), F.count(F.lit(1)).alias("distinct_src"))


@query("syn_ack_ratio", sql("WITH " + WINDOW + "SELECT w_us, round(bytes * 8 / 3600.0::DOUBLE, 6) AS bps, round(CASE WHEN ack > 0 THEN syn / ack ELSE syn END, 6) AS syn_ack_ratio FROM win", "v_flow"))
def syn_ack_ratio(spark, d):
    return _windows(spark, d).select("w_us", F.round("bps", 6).alias("bps"), F.round("syn_ack_ratio", 6).alias("syn_ack_ratio"))


@query("resolver_balance", sql(f"WITH w AS (SELECT t_us // {DAY} AS day, CASE WHEN event_seq % 2 = 0 THEN '10.10.0.53' ELSE src_ip END AS s, CASE WHEN event_seq % 2 = 1 THEN '10.10.0.53' ELSE dst_ip END AS t, packets, src_port, dst_port FROM v_flow) SELECT day, 2 * least(sum(CASE WHEN s = '10.10.0.53' AND dst_port = 53 THEN packets ELSE 0 END), sum(CASE WHEN NOT (s = '10.10.0.53' AND dst_port = 53) AND t = '10.10.0.53' AND src_port = 53 THEN packets ELSE 0 END)) AS packets FROM w GROUP BY 1", "v_flow"))
def resolver_balance(spark, d):
    from ..functions.scalars import tcp_flag_letters

    odd = C("event_seq") % 2 == 1
    f = views.flow(spark, d).withColumns({"src_ip": F.when(~odd, "10.10.0.53").otherwise(C("src_ip")), "dst_ip": F.when(odd, "10.10.0.53").otherwise(C("dst_ip")), "tcp_flags_str": tcp_flag_letters(C("tcp_flags"))})
    w = aggregates.windows(f, 86_400.0)
    return w.select(F.floor(C("w_us") / DAY).alias("day"), C("resolver_packets").alias("packets"))


@query("histograms", sql("SELECT src_ip, protocol AS value, count(*) AS n FROM v_flow GROUP BY 1, 2", "v_flow"))
def histograms(spark, d):
    h = aggregates.histogram(views.flow(spark, d), ["src_ip"], "protocol")
    return h.select("src_ip", F.explode("histogram").alias("value", "n"))


@query("packet_counter", sql("""SELECT count(*) AS packets, sum(bytes) AS bytes, round((max(t_us) - min(t_us)) / 1e6, 6) AS duration_s, sum(CAST(tcp_flags = 2 AS INT)) AS syn, sum(CAST(tcp_flags = 18 AS INT)) AS syn_ack, sum(CAST(tcp_flags = 17 AS INT)) AS fin, sum(CAST(tcp_flags = 4 AS INT)) AS rst,
round(count(*) / ((max(t_us) - min(t_us)) / 1e6), 9) AS pps FROM v_flow""", "v_flow"))
def packet_counter(spark, d):
    return aggregates.packet_counter(views.flow(spark, d)).select("packets", "bytes", F.round("duration_s", 6).alias("duration_s"), "syn", "syn_ack", "fin", "rst", F.round("pps", 9).alias("pps"))


@query("packet_counter_by", sql("SELECT 'protocol' AS dimension, protocol AS value, count(*) AS n FROM v_flow GROUP BY 2 UNION ALL SELECT 'direction', direction, count(*) FROM v_flow GROUP BY 2 UNION ALL SELECT 'tcp_flags', CAST(tcp_flags AS VARCHAR), count(*) FROM v_flow WHERE tcp_flags IS NOT NULL GROUP BY 2", "v_flow"))
def packet_counter_by(spark, d):
    return aggregates.counted_by(views.flow(spark, d), ["protocol", "direction", "tcp_flags"])


@query("capture_loss", sql("SELECT count(*) AS read, sum(CAST(event_seq % 7 > 0 AS INT)) AS parsed, round(100.0 * sum(CAST(event_seq % 7 = 0 AS INT)) / count(*), 6) AS parse_loss_pct, round(100.0 * sum(CAST(event_seq % 9 = 0 AS INT)) / count(*), 6) AS truncated_pct, TRUE AS is_lower_bound FROM v_flow", "v_flow"))
def capture_loss(spark, d):
    seq = C("event_seq")
    none = F.lit(None).cast("long")
    f = views.flow(spark, d).select(F.lit(1).alias("read"), (seq % 7 > 0).cast("int").alias("parsed"), (seq % 9 == 0).cast("int").alias("truncated"), F.lit(0).alias("malformed"), none.alias("kernel_drops"), none.alias("ring_drops"))
    return aggregates.capture_loss(f).select("read", "parsed", F.round("parse_loss_pct", 6).alias("parse_loss_pct"), F.round("truncated_pct", 6).alias("truncated_pct"), "is_lower_bound")


@query("replay_stats", sql("SELECT count(*) AS packets, sum(bytes) AS bytes, min_by(t_us, event_seq) AS first_us, max_by(t_us, event_seq) AS last_us FROM v_flow", "v_flow"))
def replay_stats(spark, d):
    return views.flow(spark, d).agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"), F.min_by("t_us", "event_seq").alias("first_us"), F.max_by("t_us", "event_seq").alias("last_us"))


FLOWS = f"""
f AS (SELECT *, CASE WHEN src_ip < dst_ip THEN src_ip || '|' || dst_ip ELSE dst_ip || '|' || src_ip END AS flow_id FROM v_flow),
g AS (SELECT *, sum(CASE WHEN t_us - prev > {48 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY t_us, event_seq) AS session FROM (SELECT *, lag(t_us) OVER (PARTITION BY flow_id ORDER BY t_us, event_seq) AS prev FROM f)),
h AS (SELECT *, (t_us - min(t_us) OVER (PARTITION BY flow_id, session)) // {240 * HOUR} AS slice FROM g),
i AS (SELECT *, first_value(src_ip) OVER p AS i_ip, first_value(src_port) OVER p AS i_port FROM h WINDOW p AS (PARTITION BY flow_id, session, slice ORDER BY t_us, event_seq))
"""


@query("flow_table", sql("WITH " + FLOWS + """SELECT flow_id, session, slice, count(*) AS events, min(t_us) AS first_us, max(t_us) AS last_us, sum(CASE WHEN src_ip = i_ip AND src_port = i_port THEN packets ELSE 0 END) AS fwd_packets, sum(CASE WHEN src_ip = i_ip AND src_port = i_port THEN 0 ELSE bytes END) AS rev_bytes, bit_or(coalesce(tcp_flags, 0)) AS flags,
coalesce(arg_max(CASE tcp_flags WHEN 4 THEN 'RESET' WHEN 17 THEN 'CLOSING' END, (t_us - 1700000000000000) * 100000 + event_seq) FILTER (tcp_flags IN (4, 17)), CASE WHEN count(*) > 1 THEN 'ACTIVE' ELSE 'NEW' END) AS state FROM i GROUP BY 1, 2, 3""", "v_flow"))
def flow_table(spark, d):
    f = views.flow(spark, d).withColumn("flow_id", F.concat_ws("|", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")))
    return aggregates.flow_table(f, 48 * 3600.0, 240 * 3600.0).select("flow_id", "session", "slice", "events", "first_us", "last_us", "fwd_packets", "rev_bytes", "flags", "state")


@query("flow_summary_running", sql("SELECT event_seq, sum(packets) OVER w AS run_packets, sum(bytes) OVER w AS run_bytes FROM v_flow WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY t_us, event_seq ROWS UNBOUNDED PRECEDING)", "v_flow"))
def flow_summary_running(spark, d):
    return aggregates.running_totals(views.flow(spark, d), ["src_ip", "dst_ip"]).select("event_seq", "run_packets", "run_bytes")


@query("baseline_snapshot", sql("SELECT src_ip, round(median(CAST(bytes AS DOUBLE)), 6) AS median, round(mad(CAST(bytes AS DOUBLE)), 6) AS mad FROM v_flow GROUP BY 1", "v_flow"))
def baseline_snapshot(spark, d):
    m = aggregates.median_and_mad(views.flow(spark, d).withColumn("bytes", C("bytes").cast("double")), ["src_ip"], "bytes")
    return m.select("src_ip", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("learn_fingerprints", sql("SELECT 'ja3' AS kind, ja3 AS fingerprint, max(t_us) AS last_us FROM v_tls GROUP BY 2 UNION ALL SELECT 'ja4', ja4, max(t_us) FROM v_tls GROUP BY 2", "v_tls"))
def learn_fingerprints(spark, d):
    return aggregates.learned_fingerprints(views.tls(spark, d))


@query("top_destination", sql(f"WITH n AS (SELECT t_us // {DAY} AS day, dst_ip, sum(packets) AS n, min(event_seq) AS f FROM v_flow GROUP BY 1, 2) SELECT day, dst_ip AS top, n FROM n QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, f) = 1", "v_flow"))
def top_destination(spark, d):
    return aggregates.top_target(views.flow(spark, d).withColumn("day", F.floor(C("t_us") / DAY)), ["day"], "dst_ip")


def SESSION(keys: str, gap: int, source: str) -> str:
    return f"s AS (SELECT *, sum(CASE WHEN t_us - prev > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY t_us, event_seq) AS session FROM (SELECT *, lag(t_us) OVER (PARTITION BY {keys} ORDER BY t_us, event_seq) AS prev FROM {source}))"


@query("sessions", sql("WITH " + SESSION("src_ip", 48 * HOUR, "v_flow") + " SELECT src_ip, session, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us FROM s GROUP BY 1, 2", "v_flow"))
def sessions_query(spark, d):
    s = sessions.sessions(views.flow(spark, d), ["src_ip"], 48 * 3600.0)
    return s.groupBy("src_ip", "session").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


SCAN = ScanConfig(gap_s=48 * 3600.0, min_hosts=6, min_ports=5)


@query("scan_detect", sql(f"""
WITH e AS (SELECT * FROM v_flow WHERE NOT ((src_port < 1024 OR src_port IN (53, 123, 389, 1900, 11211)) AND dst_port >= 1024) AND NOT (src_ip IN ('10.10.0.53', '10.0.1.2') AND dst_port = 53)), {SESSION("src_ip", 48 * HOUR, "e")},
r AS (SELECT a.src_ip, a.session, a.t_us, a.event_seq, count(DISTINCT b.dst_ip) AS hosts, count(DISTINCT b.dst_port) AS ports, sum(b.packets) AS sent, min(b.t_us) AS first_us FROM s a JOIN s b ON a.src_ip = b.src_ip AND a.session = b.session AND (b.t_us, b.event_seq) <= (a.t_us, a.event_seq) GROUP BY 1, 2, 3, 4)
SELECT src_ip, t_us, event_seq, hosts AS unique_dst_count, ports AS unique_port_count, CASE WHEN hosts >= 6 AND ports >= 5 THEN 'hybrid' WHEN ports >= 5 THEN 'vertical' ELSE 'horizontal' END AS scan_pattern, sent AS packets_sent, round((t_us - first_us) / 1e6, 6) AS duration_s, round(greatest(hosts / 6, ports / 5), 6) AS score FROM r WHERE hosts >= 6 OR ports >= 5
QUALIFY row_number() OVER (PARTITION BY src_ip, session ORDER BY t_us, event_seq) = 1""", "v_flow"))
def scan_detect(spark, d):
    return detectors.scan(views.flow(spark, d), SCAN).select("src_ip", "t_us", "event_seq", "unique_dst_count", "unique_port_count", "scan_pattern", "packets_sent", F.round("duration_s", 6).alias("duration_s"), F.round("score", 6).alias("score"))


@query("c2_detect", sql(f"""
WITH e AS (SELECT * FROM v_flow WHERE NOT ((protocol = 'UDP' AND dst_port IN (53, 123)) OR (protocol = 'TCP' AND dst_port = 53)) AND direction <> 'inbound'), {SESSION("src_ip, dst_ip", 240 * HOUR, "e")},
i AS (SELECT *, CASE WHEN gap > 0.001 THEN gap END AS iat FROM (SELECT *, (t_us - lag(t_us) OVER (PARTITION BY src_ip, dst_ip, session ORDER BY t_us, event_seq)) / 1e6 AS gap FROM s)),
r AS (SELECT *, count(*) OVER a AS n, count(iat) OVER p AS valid, avg(iat) OVER p AS m, stddev_samp(iat) OVER p AS sd FROM i WINDOW a AS (PARTITION BY src_ip, dst_ip, session ORDER BY t_us, event_seq ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY src_ip, dst_ip, session ORDER BY t_us, event_seq ROWS 62 PRECEDING))
SELECT src_ip, dst_ip, t_us, event_seq, least(n, 64) AS event_count, round(m, 3) AS iat_mean, round(sd / m, 6) AS iat_cv, round(least(1, greatest(0, 1 - 0.5::DOUBLE * (sd / m) / 0.3::DOUBLE)), 6) AS score FROM r WHERE n >= 4 AND valid >= 3 AND sd / m <= 0.3
QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip, session ORDER BY t_us, event_seq) = 1""", "v_flow"))
def c2_detect(spark, d):
    cfg = C2Config(key=("src_ip", "dst_ip"), gap_s=240 * 3600.0, min_events=4, min_valid=3, max_cv=0.3, fleet_hosts=None)
    return detectors.c2(views.flow(spark, d), cfg).select("src_ip", "dst_ip", "t_us", "event_seq", C("event_count").cast("long").alias("event_count"), F.round("iat_mean", 3).alias("iat_mean"), F.round("iat_cv", 6).alias("iat_cv"), F.round("score", 6).alias("score"))


@query("fleet_prevalence", sql("WITH f AS (SELECT *, CAST(row_number() OVER (PARTITION BY dst_ip, dst_port, src_ip ORDER BY t_us, event_seq) = 1 AS INT) AS new FROM v_flow) SELECT event_seq, sum(new) OVER (PARTITION BY dst_ip, dst_port ORDER BY t_us, event_seq) AS fleet FROM f", "v_flow"))
def fleet_prevalence(spark, d):
    return detectors.fleet_size(views.flow(spark, d), ["dst_ip", "dst_port"]).select("event_seq", "fleet")


@query("dga_detect", sql("WITH " + CORE + """, e AS (SELECT v.*, score, row_number() OVER (PARTITION BY src_ip ORDER BY t_us, event_seq) AS rn FROM v_dns v JOIN scored USING (qname)),
r AS (SELECT *, least(rn, 100) AS n, avg(CASE WHEN rn <= 100 THEN score END) OVER w AS avg_score, sum(CAST(nxdomain AS INT)) OVER w AS nx FROM e WINDOW w AS (PARTITION BY src_ip ORDER BY t_us, event_seq ROWS UNBOUNDED PRECEDING))
SELECT src_ip, t_us, event_seq, n AS query_count, round(avg_score, 3) AS avg_score, round(nx / n, 6) AS nxdomain_rate FROM r WHERE n >= 5 AND (avg_score >= 0.3 OR (avg_score >= 0.15 AND nx / n >= 0.2)) QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY t_us, event_seq) = 1""", "v_dns"))
def dga_detect(spark, d):
    return detectors.dga(views.dns(spark, d), DgaConfig(high=0.3, low=0.15, nx_rate=0.2)).select("src_ip", "t_us", "event_seq", C("query_count").cast("long").alias("query_count"), scalars.rounded(C("avg_score"), 3).alias("avg_score"), scalars.rounded(C("nxdomain_rate"), 6).alias("nxdomain_rate"))


@query("dns_tunnel_detect", sql(f"""
WITH {SESSION("src_ip", 48 * HOUR, "v_dns")},
h AS (SELECT qname, entropy(ch) AS h FROM (SELECT qname, unnest(string_split(qname, '')) AS ch FROM (SELECT DISTINCT qname FROM v_dns)) GROUP BY 1),
n AS (SELECT s.*, h, row_number() OVER (PARTITION BY src_ip, session ORDER BY t_us, event_seq) AS rn FROM s JOIN h USING (qname)),
r AS (SELECT *, avg(CASE WHEN rn <= 100 THEN length(qname) END) OVER w AS avg_length, avg(CASE WHEN rn <= 100 THEN h END) OVER w AS avg_entropy, avg(CAST(qtype = 'TXT' AS INT)) OVER w AS txt, avg(CAST(qtype = 'NULL' AS INT)) OVER w AS nul, min(t_us) OVER w AS first_us FROM n WINDOW w AS (PARTITION BY src_ip, session ORDER BY t_us, event_seq ROWS UNBOUNDED PRECEDING))
SELECT src_ip, t_us, event_seq, rn AS query_count, round(avg_length, 6) AS avg_length, round(avg_entropy, 6) AS avg_entropy, round(txt, 6) AS txt_share, round(nul, 6) AS null_share FROM r
WHERE rn >= 3 AND ((avg_length >= 50 AND avg_entropy >= 3.5) OR (rn / greatest((t_us - first_us) / 1e6, 0.001) >= 10 AND avg_length >= 30) OR ((txt > 0.2 OR nul > 0.1) AND avg_length >= 15)) QUALIFY row_number() OVER (PARTITION BY src_ip, session ORDER BY t_us, event_seq) = 1""", "v_dns"))
def dns_tunnel_detect(spark, d):
    cfg = DnsConfig(key=("src_ip",), gap_s=48 * 3600.0, min_queries=3, share_length=15.0)
    return detectors.dns_tunnel(views.dns(spark, d), cfg).select("src_ip", "t_us", "event_seq", C("query_count").cast("long").alias("query_count"), *[F.round(c, 6).alias(c) for c in ("avg_length", "avg_entropy", "txt_share", "null_share")])


EXFIL = f"""WITH e AS (SELECT *, CASE WHEN direction = 'inbound' THEN dst_ip ELSE src_ip END AS internal, CASE WHEN direction = 'inbound' THEN src_ip ELSE dst_ip END AS ext, CASE WHEN direction = 'inbound' THEN 0 ELSE bytes END AS ob, CASE WHEN direction = 'inbound' THEN bytes ELSE 0 END AS ib FROM v_flow WHERE direction IN ('inbound', 'outbound', 'external')), {SESSION("internal, ext", 120 * HOUR, "e")},
r AS (SELECT *, sum(ob) OVER w AS outbound_bytes, sum(ib) OVER w AS inbound_bytes, min(t_us) OVER w AS first_us FROM s WINDOW w AS (PARTITION BY internal, ext, session ORDER BY t_us, event_seq ROWS UNBOUNDED PRECEDING))"""
EXFIL_HITS = "FROM r WHERE direction <> 'inbound' AND outbound_bytes >= 20000 AND outbound_bytes / greatest(inbound_bytes, 1) >= 3 QUALIFY row_number() OVER (PARTITION BY internal, ext, session ORDER BY t_us, event_seq) = 1"
EXFIL_SETTINGS = ExfilConfig(gap_s=120 * 3600.0, min_bytes=20_000, min_ratio=3.0)


@query("exfil_detect", sql(f"{EXFIL} SELECT internal AS src_ip, ext AS dst_ip, t_us, event_seq, outbound_bytes, inbound_bytes, round(outbound_bytes / greatest(inbound_bytes, 1), 6) AS outbound_ratio {EXFIL_HITS}", "v_flow"))
def exfil_detect(spark, d):
    return detectors.exfil(views.flow(spark, d), EXFIL_SETTINGS).select("src_ip", "dst_ip", "t_us", "event_seq", "outbound_bytes", "inbound_bytes", scalars.rounded(C("outbound_ratio"), 6).alias("outbound_ratio"))


@query("evidence_contract", sql(f"{EXFIL} SELECT event_seq, internal AS source, ext AS destination, 'outbound' AS direction, CAST(outbound_bytes AS VARCHAR) AS outbound_bytes, round(outbound_bytes / greatest(inbound_bytes, 1), 2) AS outbound_ratio, CASE WHEN t_us - first_us >= 30000000 THEN 'sustained' ELSE 'burst' END AS burst_or_sustained {EXFIL_HITS}", "v_flow"))
def evidence_contract(spark, d):
    """Evidence as it stands in an alert, read back from its JSON."""
    a = replay.as_alerts(detectors.exfil(views.flow(spark, d), EXFIL_SETTINGS), "exfil")
    told = {n: F.get_json_object("evidence_json", f"$.{n}") for n in ("source", "destination", "direction", "outbound_bytes", "outbound_ratio", "burst_or_sustained")}
    return a.select("event_seq", *[(c.cast("double") if n == "outbound_ratio" else c).alias(n) for n, c in told.items()])


@query("tls_quic_detect", sql(f"""
WITH o AS (SELECT *, lag(t_us) OVER (PARTITION BY ja3 ORDER BY t_us, event_seq) AS p3, lag(t_us) OVER (PARTITION BY ja4 ORDER BY t_us, event_seq) AS p4, min(t_us) OVER () AS t0 FROM v_tls),
e AS (SELECT *, t_us - t0 >= {DAY} AND ((p3 IS NULL OR t_us - p3 > {3 * DAY}) OR (p4 IS NULL OR t_us - p4 > {3 * DAY})) AS new FROM o), {SESSION("src_ip, dst_ip, dst_port", 300 * HOUR, "e")},
n AS (SELECT *, row_number() OVER w AS rn, (t_us - lag(t_us) OVER w) / 1e6 AS gap FROM s WINDOW w AS (PARTITION BY src_ip, dst_ip, dst_port, session ORDER BY t_us, event_seq)),
r AS (SELECT *, first_value(sni IGNORE NULLS) OVER w AS s_sni, first_value(ja3) OVER w AS s_ja3, min(CASE WHEN rn <= 32 THEN pkt_size END) OVER w AS low, max(CASE WHEN rn <= 32 THEN pkt_size END) OVER w AS high, least(rn, 32) AS sizes, stddev_samp(CASE WHEN rn <= 32 AND gap > 0.001 THEN gap END) OVER w AS sd, avg(CASE WHEN rn <= 32 AND gap > 0.001 THEN gap END) OVER w AS m, bool_or(new) OVER w AS novel FROM n WINDOW w AS (PARTITION BY src_ip, dst_ip, dst_port, session ORDER BY t_us, event_seq ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, s_sni IS NULL AND dst_port <> 443 AS nameless, sizes >= 2 AND low = high AND low < 500 AND coalesce(coalesce(sd, 0) / m, 0) < 0.2 AS even FROM r)
SELECT src_ip, dst_ip, dst_port, t_us, event_seq, s_ja3 AS ja3, nameless AS no_sni, even AS fixed_size, novel, CAST(CASE WHEN nameless OR even THEN 0.75 ELSE 0.6 END AS DOUBLE) AS score FROM c WHERE nameless OR even OR novel QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port, session ORDER BY t_us, event_seq) = 1""", "v_tls"))
def tls_quic_detect(spark, d):
    cfg = TlsConfig(gap_s=300 * 3600.0, usual_ports=(443,), min_sizes=2, novelty_s=3 * 86_400.0, warm_up_s=86_400.0)
    return detectors.tls_quic(views.tls(spark, d), cfg).select("src_ip", "dst_ip", "dst_port", "t_us", "event_seq", "ja3", "no_sni", "fixed_size", "novel", "score")


def _ddos_windows(spark, d):
    return _windows(spark, d).withColumn("pps", C("packets").cast("double"))


@query("hysteresis_runs", sql("WITH " + WINDOW + ", n AS (SELECT w_us, packets, row_number() OVER (ORDER BY w_us) AS n FROM win), i AS (SELECT *, n - row_number() OVER (ORDER BY w_us) AS island FROM n WHERE packets >= 45) SELECT min(w_us) AS start_us, max(w_us) AS end_us, count(*) AS windows, CAST(max(packets) AS DOUBLE) AS peak_pps FROM i GROUP BY island HAVING count(*) >= 2", "v_flow"))
def hysteresis_runs(spark, d):
    return flood.runs(_ddos_windows(spark, d), 45.0)


# The fold as a recursion: one step a window, with the run and the baseline as state.
FOLD = "WITH " + WINDOW + """,
rw AS (SELECT w_us, 2 * least(sum(CASE WHEN q THEN packets ELSE 0 END), sum(CASE WHEN a AND NOT q THEN packets ELSE 0 END)) AS resolver FROM (SELECT w_us, packets, src_ip IN ('10.10.0.53', '10.0.1.2') AND dst_port = 53 AS q, dst_ip IN ('10.10.0.53', '10.0.1.2') AND src_port = 53 AS a FROM w) GROUP BY 1),
n AS (SELECT w_us, CAST(packets AS DOUBLE) AS x, resolver / packets >= 0.8 AS res, row_number() OVER (ORDER BY w_us) AS n, CASE WHEN syn > 0 AND (ack = 0 OR syn / greatest(ack, 1) >= 3 OR syn / packets >= 0.5) THEN 'syn_flood' WHEN udp > 0 AND udp / packets >= 0.6 THEN 'udp_flood' WHEN top_flow_share < 0.5 THEN 'volumetric_flood' END AS kind FROM win JOIN rw USING (w_us)),
f AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS w_us, CAST(NULL AS DOUBLE) AS pps, CAST(NULL AS DOUBLE) AS m, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS z, CAST(0 AS INT) AS run, FALSE AS flood, CAST(NULL AS VARCHAR) AS kind, CAST([] AS DOUBLE[]) AS hist
  UNION ALL SELECT n, w_us, x, m, s, z, CASE WHEN run1 >= 2 AND kind IS NULL THEN 0 ELSE run1 END, flood, CASE WHEN run1 >= 2 THEN kind END, CASE WHEN flood OR x <= 0 THEN hist WHEN len(hist) >= 100 THEN list_append(hist[2:], x) ELSE list_append(hist, x) END
  FROM (SELECT *, CASE WHEN flood AND NOT res THEN prev + 1 ELSE 0 END AS run1
    FROM (SELECT *, x >= 60 OR (m IS NOT NULL AND z >= 3 AND x > 10) AS flood
      FROM (SELECT *, CASE WHEN m IS NULL THEN 0 WHEN s > 1e-6 THEN (x - m) / (1.4826e0 * s) WHEN abs(x - m) < 1e-6 THEN 0 ELSE x - m END AS z
        FROM (SELECT n.*, f.run AS prev, hist, CASE WHEN len(hist) >= 5 THEN list_aggregate(hist, 'median') END AS m, CASE WHEN len(hist) >= 5 THEN list_aggregate(hist, 'mad') END AS s FROM f JOIN n ON n.n = f.n + 1)))))
SELECT w_us, pps, m AS median_pps, s AS mad_pps, z, run, flood, kind AS threat_class, kind IS NOT NULL AS alert FROM f WHERE n > 0"""


@query("ddos_detect", sql(FOLD, "v_flow").replace("WITH ", "WITH RECURSIVE ", 1))
def ddos_detect(spark, d):
    return flood.verdicts(_ddos_windows(spark, d), DdosConfig(min_pps=60.0, z_min_pps=10.0, min_z=3.0))


@query("ddos_alerts")
def ddos_alerts(spark, d):
    return flood.alerts(_ddos_windows(spark, d), DdosConfig(min_pps=50.0, z_min_pps=10.0, min_z=3.0, hysteresis=1))


@query("slowloris_detect", sql(f"""
WITH f AS (SELECT dst_ip, dst_port, t_us // {HOUR} * {HOUR} AS w_us, CAST(k AS DOUBLE) AS duration, bytes, packets FROM v_flow WHERE protocol = 'TCP' AND dst_port IN (80, 443, 8443)),
r AS (SELECT a.dst_ip, a.dst_port, a.w_us, count(*) AS concurrency, list_sort(list(b.duration)) AS ds, sum(b.bytes) AS b, sum(b.packets) AS p FROM (SELECT DISTINCT dst_ip, dst_port, w_us FROM f) a JOIN f b ON a.dst_ip = b.dst_ip AND a.dst_port = b.dst_port AND b.w_us BETWEEN a.w_us - {24 * HOUR} AND a.w_us GROUP BY 1, 2, 3)
SELECT dst_ip, dst_port, w_us, concurrency, ds[CAST(ceil(0.95 * len(ds)) AS INT)] AS duration_p95, round(b / concurrency, 6) AS bytes_per_connection FROM r WHERE concurrency >= 10 AND ds[CAST(ceil(0.95 * len(ds)) AS INT)] >= 90 AND b / concurrency <= 8000 AND p <= 1000""", "v_flow"))
def slowloris_detect(spark, d):
    out = detectors.slowloris(views.slow_flows(spark, d), SlowlorisConfig(memory_s=86_400.0, min_flows=10, min_p95_s=90.0, max_bytes=8000.0, max_pps=1000.0))
    return out.select("dst_ip", "dst_port", "w_us", "concurrency", "duration_p95", F.round("bytes_per_connection", 6).alias("bytes_per_connection"))


RESPONSES = "q AS (SELECT src_ip AS host, dst_ip AS amp, dst_port AS port, t_us, event_seq FROM v_flow WHERE protocol = 'UDP' AND direction <> 'inbound' AND dst_port IN (53, 123)), p AS (SELECT * FROM v_flow WHERE protocol = 'UDP' AND direction = 'inbound' AND src_port IN (53, 123)), a AS (SELECT p.event_seq, p.dst_ip, p.src_ip, p.src_port, p.t_us, p.packets, p.bytes, coalesce(max(CASE WHEN p.t_us - q.t_us <= {} THEN 1 END), 0) = 1 AS solicited FROM p LEFT JOIN q ON q.host = p.dst_ip AND q.amp = p.src_ip AND q.port = p.src_port AND (q.t_us, q.event_seq) <= (p.t_us, p.event_seq) GROUP BY ALL)"


@query("solicited_asof", sql("WITH " + RESPONSES.format(DAY * 10) + " SELECT event_seq, solicited FROM a", "v_flow"))
def solicited_asof(spark, d):
    from ..operators import filters

    f = views.flow(spark, d)
    return detectors.solicited(filters.reflection_responses(f), filters.reflection_requests(f), 10 * 86_400.0).select("event_seq", "solicited")


REFLECTION = ReflectionConfig(window_s=5, min_fan_in=3, min_unsolicited=0.5, min_pps=1.0, min_bps=1e9, cooldown_s=8, memory_s=86_400.0)


@query("reflection_windows", sql("WITH " + RESPONSES.format(DAY) + f""", b AS (SELECT dst_ip, src_port, src_ip, t_us // {DAY} AS day, sum(packets) AS p, arg_min(solicited, (t_us - 1700000000000000) * 100000 + event_seq) AS s FROM a GROUP BY 1, 2, 3, 4),
w AS (SELECT x.dst_ip, x.src_port, x.day, count(DISTINCT y.src_ip) AS fan_in, sum(y.p) AS packets FROM (SELECT DISTINCT dst_ip, src_port, day FROM b) x JOIN b y ON x.dst_ip = y.dst_ip AND x.src_port = y.src_port AND y.day BETWEEN x.day - 4 AND x.day GROUP BY 1, 2, 3),
u AS (SELECT x.dst_ip, x.src_port, x.day, y.src_ip, max(CAST(y.s AS INT)) AS s FROM (SELECT DISTINCT dst_ip, src_port, day FROM b) x JOIN b y ON x.dst_ip = y.dst_ip AND x.src_port = y.src_port AND y.day BETWEEN x.day - 4 AND x.day GROUP BY 1, 2, 3, 4)
SELECT w.dst_ip, w.src_port AS amplifier_port, w.day, fan_in, packets, round(avg(1 - s), 6) AS unsolicited_share FROM w JOIN u ON w.dst_ip = u.dst_ip AND w.src_port = u.src_port AND w.day = u.day GROUP BY 1, 2, 3, 4, 5 HAVING fan_in >= 3 AND avg(1 - s) >= 0.5""", "v_flow"))
def reflection_windows(spark, d):
    cfg = ReflectionConfig(**(REFLECTION.__dict__ | {"cooldown_s": 0, "min_pps": 0.0}))
    r = detectors.reflection(views.flow(spark, d), cfg, second_us=DAY)
    return r.select("dst_ip", "amplifier_port", C("event_seq").alias("day"), "fan_in", "packets", F.round("unsolicited_share", 6).alias("unsolicited_share"))


REFLECTED = sql("WITH " + RESPONSES.format(DAY) + f""", b AS (SELECT dst_ip, src_port, src_ip, t_us // {DAY} AS day, sum(packets) AS p, sum(bytes) AS size, arg_min(solicited, (t_us - 1700000000000000) * 100000 + event_seq) AS s FROM a GROUP BY 1, 2, 3, 4),
y AS (SELECT x.dst_ip, x.src_port, x.day, y.src_ip, sum(y.p) AS p, sum(y.size) AS size, max(CAST(y.s AS INT)) AS s, min(y.day) AS first_day FROM (SELECT DISTINCT dst_ip, src_port, day FROM b) x JOIN b y ON x.dst_ip = y.dst_ip AND x.src_port = y.src_port AND y.day BETWEEN x.day - 4 AND x.day GROUP BY 1, 2, 3, 4),
w AS (SELECT dst_ip, src_port AS amplifier_port, day, count(*) AS fan_in, avg(1 - s) AS unsolicited_share, CAST(sum(p) AS BIGINT) AS packets, CAST(sum(size) AS BIGINT) AS bytes, min(first_day) AS first_day, sum(p) / (day - min(first_day) + 1) AS pps FROM y GROUP BY 1, 2, 3),
hot AS (SELECT *, row_number() OVER (PARTITION BY dst_ip, amplifier_port ORDER BY day) AS rn FROM w WHERE fan_in >= 3 AND unsolicited_share >= 0.5 AND pps >= 1.0),
f AS (SELECT *, day AS fired FROM hot WHERE rn = 1 UNION ALL SELECT h.*, CASE WHEN h.day - f.fired >= 8 THEN h.day ELSE f.fired END FROM f JOIN hot h ON h.dst_ip = f.dst_ip AND h.amplifier_port = f.amplifier_port AND h.rn = f.rn + 1)
SELECT dst_ip, amplifier_port, day, first_day, fan_in, round(unsolicited_share, 6) AS unsolicited_share, round(pps, 6) AS pps, packets, bytes, round(0.5 + 0.5 * least(greatest((pps - 1) / 4, 0), 1), 6) AS score, CASE WHEN pps >= 5 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM f WHERE fired = day""", "v_flow").replace("WITH ", "WITH RECURSIVE ", 1)


@query("reflection_detect", REFLECTED)
def reflection_detect(spark, d):
    """With the cooldown, a recurrence over the candidate days."""
    r = detectors.reflection(views.flow(spark, d), REFLECTION, second_us=DAY)
    return r.select("dst_ip", "amplifier_port", C("event_seq").alias("day"), F.floor(C("first_us") / DAY).alias("first_day"), "fan_in", F.round("unsolicited_share", 6).alias("unsolicited_share"), F.round("pps", 6).alias("pps"), "packets", "bytes", F.round("score", 6).alias("score"), "severity")


@query("reflection_window_rule", sql(f"WITH w AS (SELECT src_port AS port, t_us // {DAY} AS day, count(DISTINCT src_ip) AS fan_in, sum(packets) AS pps FROM v_flow GROUP BY 1, 2) SELECT port, day, CASE WHEN port IN (53, 123, 389, 1900, 11211) AND fan_in >= 5 AND pps >= 20 THEN 'ALERT' ELSE 'QUIET' END AS outcome FROM w UNION ALL SELECT NULL, 0, 'NOT_OBSERVABLE'", "v_flow"))
def reflection_window_rule(spark, d):
    w = views.flow(spark, d).groupBy(C("src_port").alias("port"), F.floor(C("t_us") / DAY).alias("day")).agg(F.count_distinct("src_ip").alias("fan_in"), F.sum("packets").alias("pps"))
    w = w.unionByName(spark.createDataFrame([(None, 0, None, None)], "port int, day long, fan_in long, pps long"))
    return detectors.reflection_rule(w, min_fan_in=5, min_pps=20.0).select("port", "day", "outcome")


@query("ja3_intel_semi", sql("SELECT event_seq FROM v_tls WHERE ja3 IN (SELECT md5(CAST(i AS VARCHAR)) FROM range(3) t(i))", "v_tls"))
def ja3_intel_semi(spark, d):
    listed = spark.range(3).select(F.upper(F.md5(C("id").cast("string"))).alias("ja3"))
    return joins.known_bad(views.tls(spark, d), listed).select("event_seq")


@query("allowlist_anti", sql("SELECT event_seq FROM v_dns WHERE qname NOT LIKE '%.info'", "v_dns"))
def allowlist_anti(spark, d):
    dns = views.dns(spark, d)
    allowed = dns.where(C("qname").endswith(".info")).select(F.upper("qname").alias("domain")).distinct()
    return joins.not_allowlisted(dns, allowed).select("event_seq")


@query("resolver_lookup", sql("SELECT event_seq FROM v_flow WHERE src_ip IN ('10.10.0.53', '10.0.1.2') OR dst_ip IN ('10.10.0.53', '10.0.1.2')", "v_flow"))
def resolver_lookup(spark, d):
    return joins.from_or_to_resolver(views.flow(spark, d)).select("event_seq")


@query("fingerprint_asof", sql("SELECT event_seq, CASE WHEN ja3 < '8' THEN coalesce(greatest(lag(t_us) OVER (PARTITION BY ja3 ORDER BY t_us, event_seq), 1000), 1000) ELSE lag(t_us) OVER (PARTITION BY ja3 ORDER BY t_us, event_seq) END AS last_us FROM v_tls", "v_tls"))
def fingerprint_asof(spark, d):
    t = views.tls(spark, d).withColumn("fingerprint", C("ja3"))
    base = t.where("ja3 < '8'").select("fingerprint").distinct().withColumn("last_us", F.lit(1000).cast("long"))
    return joins.previous_sighting(t, base).select("event_seq", "last_us")


@query("template_asof", sql(f"""WITH t AS (SELECT k % 7 AS id, t_us, event_seq AS version FROM v_flow WHERE event_seq % 5 = 0), x AS (SELECT k % 7 AS id, t_us, event_seq FROM v_flow WHERE event_seq % 5 <> 0),
j AS (SELECT event_seq, x.t_us, t.t_us AS reg_us, version FROM x ASOF LEFT JOIN (SELECT id, t_us, max(version) AS version FROM t GROUP BY 1, 2) t ON x.id = t.id AND t.t_us <= x.t_us) SELECT event_seq, CASE WHEN t_us - reg_us <= {HOUR} THEN version END AS version FROM j""", "v_flow"))
def template_asof(spark, d):
    f = views.flow(spark, d).withColumns({"exporter": F.lit("e"), "domain": F.lit(1), "template_id": C("k") % 7})
    key = ["exporter", "domain", "template_id", "t_us", "event_seq"]
    t = f.where("event_seq % 5 = 0").select(*key, C("event_seq").alias("version"))
    return joins.latest_template(f.where("event_seq % 5 <> 0").select(*key), t, 3600.0).select("event_seq", "version")
