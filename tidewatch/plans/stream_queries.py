"""Detectors and late rows over streams: the events table arrives in fixed micro-batches, and what the stream has put out at the end is held against SQL over the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..config import AddressPlan, C2Config, TlsConfig, WindowConfig
from ..sources import flowrec, flowstream, pcap
from ..streaming import detect, late, windows
from ..streaming.inorder import rocks
from . import views
from .detect_queries import DAY, HOUR, REFLECTED, REFLECTION, SESSION
from .registry import query
from .source_queries import _finished, _hex
from .views import sql

C = F.col
SLICES = 4
#: Rows of a micro-batch's file.
FILE_ROWS = 1_000_000
WINDOW = WindowConfig(width_s=3600.0)
#: Up to where the watermark gets: the latest event, in whole milliseconds, less the delay.
REACHED = "(SELECT (max(epoch_us(ts)) // 1000 - 300) * 1000 FROM events)"
ARRIVAL = "event_id * 4 // (SELECT max(event_id) + 1 FROM events) + CASE WHEN {} THEN 1 + event_id % 3 ELSE 0 END"


def arriving(spark, d, delayed="false"):
    """The events table as a stream of SLICES micro-batches in order of event_id; rows that meet `delayed` come one to three micro-batches later."""
    e = views.table(spark, d, "events")
    n = e.agg(F.max("event_id")).first()[0] + 1
    arrival = F.floor(C("event_id") * SLICES / n) + F.when(F.expr(delayed), 1 + C("event_id") % 3).otherwise(0)
    e, files, path = e.withColumn("_arrival", arrival), -(-n // SLICES // FILE_ROWS) or 1, scratch.path(spark, "arriving")
    for k in range(SLICES + (3 if delayed != "false" else 0)):
        e.where(C("_arrival") == k).drop("_arrival").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(e.drop("_arrival").schema).option("maxFilesPerTrigger", files).parquet(path)


def flows(spark, d):
    return views.flow_of(arriving(spark, d)).select("event_seq", "t_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "direction", "packets", "bytes")


@query("stream_late", f"""
WITH e AS (SELECT event_id, epoch_us(ts) AS t_us, {ARRIVAL.format("event_id % 17 = 0")} AS arrival FROM events),
w AS (SELECT x.arrival, coalesce((max(y.t_us) // 1000 - 300) * 1000, 0) AS watermark_us FROM (SELECT DISTINCT arrival FROM e) x LEFT JOIN e y ON y.arrival < x.arrival GROUP BY 1)
SELECT event_id AS event_seq, t_us, (t_us // {HOUR} + 1) * {HOUR} <= watermark_us AS late, watermark_us FROM e JOIN w USING (arrival)""")
def stream_late(spark, d):
    """Every row with whether it came when its window had been closed."""
    e = arriving(spark, d, "event_id % 17 = 0").select(C("event_id").alias("event_seq"), F.unix_micros(C("ts").cast("timestamp")).alias("t_us"))
    with rocks(spark):
        return _finished(spark, late.marked(e, WINDOW))


@query("stream_c2", sql(f"""
WITH e AS (SELECT * FROM v_flow WHERE NOT ((protocol = 'UDP' AND dst_port IN (53, 123)) OR (protocol = 'TCP' AND dst_port = 53)) AND direction <> 'inbound'), {SESSION("src_ip, dst_ip", 240 * HOUR, "e")},
i AS (SELECT *, CASE WHEN gap > 0.001 THEN gap END AS iat FROM (SELECT *, (t_us - lag(t_us) OVER (PARTITION BY src_ip, dst_ip, session ORDER BY t_us, event_seq)) / 1e6 AS gap FROM s)),
r AS (SELECT *, count(*) OVER a AS n, count(iat) OVER p AS valid, avg(iat) OVER p AS m, stddev_samp(iat) OVER p AS sd FROM i WINDOW a AS (PARTITION BY src_ip, dst_ip, session ORDER BY t_us, event_seq ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY src_ip, dst_ip, session ORDER BY t_us, event_seq ROWS 62 PRECEDING)),
sight AS (SELECT dst_ip, src_ip, min((t_us, event_seq)) AS seen FROM e GROUP BY 1, 2), nth AS (SELECT dst_ip, seen FROM sight QUALIFY row_number() OVER (PARTITION BY dst_ip ORDER BY seen) = 120)
SELECT src_ip, r.dst_ip, t_us, event_seq, CAST(least(n, 64) AS INT) AS event_count, round(m, 3) AS iat_mean, round(sd / m, 6) AS iat_cv, round(least(1, greatest(0, 1 - 0.5::DOUBLE * (sd / m) / 0.3::DOUBLE)), 6) AS score
FROM r LEFT JOIN nth ON nth.dst_ip = r.dst_ip WHERE n >= 4 AND valid >= 3 AND sd / m <= 0.3 AND (seen IS NULL OR (t_us, event_seq) < seen) AND t_us <= {REACHED}
QUALIFY row_number() OVER (PARTITION BY src_ip, r.dst_ip, session ORDER BY t_us, event_seq) = 1""", "v_flow"))
def stream_c2(spark, d):
    """Beacons to destinations of fewer than 120 hosts, up to the watermark."""
    cfg = C2Config(key=("src_ip", "dst_ip"), gap_s=240 * 3600.0, min_events=4, min_valid=3, max_cv=0.3, fleet_hosts=120)
    with rocks(spark):
        a = _finished(spark, detect.c2_alerts(flows(spark, d), cfg, WINDOW))
    return a.select("src_ip", "dst_ip", "t_us", "event_seq", "event_count", F.round("iat_mean", 3).alias("iat_mean"), F.round("iat_cv", 6).alias("iat_cv"), F.round("score", 6).alias("score"))


@query("stream_reflection", f"SELECT * FROM ({REFLECTED}) WHERE (day + 1) * {DAY} <= {REACHED}")
def stream_reflection(spark, d):
    """Reflection alerts of the days that the watermark has closed."""
    with rocks(spark):
        a = _finished(spark, detect.reflection_alerts(flows(spark, d), REFLECTION, AddressPlan(), WINDOW, DAY))
    return a.select("dst_ip", "amplifier_port", C("second").alias("day"), C("first_second").alias("first_day"), C("fan_in").cast("long").alias("fan_in"), F.round("unsolicited_share", 6).alias("unsolicited_share"), F.round("pps", 6).alias("pps"), "packets", "bytes", F.round("score", 6).alias("score"), "severity")


SHOWN = "UNION ALL".join(f" SELECT '{k}' AS kind, {k} AS fingerprint, t_us, event_seq FROM v_tls " for k in ("ja3", "ja4"))


@query("stream_novelty", sql(f"""
WITH shown AS ({SHOWN}), start AS (SELECT min(epoch_us(ts)) AS t0 FROM events), known AS (SELECT DISTINCT kind, fingerprint, t0 - {DAY // 4} AS last_us FROM shown, start WHERE fingerprint < '8'),
b AS (SELECT shown.*, greatest(lag(t_us) OVER (PARTITION BY shown.kind, shown.fingerprint ORDER BY t_us, event_seq), known.last_us) AS before_us FROM shown LEFT JOIN known ON known.kind = shown.kind AND known.fingerprint = shown.fingerprint)
SELECT kind, fingerprint, t_us, event_seq FROM b WHERE (before_us IS NULL OR t_us - before_us > {DAY // 2}) AND (t_us // 60000000 + 1) * 60000000 <= (SELECT (max(t_us) // 1000 - 300) * 1000 FROM v_tls)""", "v_tls"))
def stream_novelty(spark, d):
    """First sightings within half a day, with half of the fingerprints known from a quarter of a day before."""
    t = views.tls(spark, d)
    start = views.table(spark, d, "events").agg(F.min(F.unix_micros(C("ts").cast("timestamp")))).first()[0]
    shown = t.select(F.explode(F.array(F.struct(F.lit("ja3").alias("kind"), C("ja3").alias("fingerprint")), F.struct(F.lit("ja4").alias("kind"), C("ja4").alias("fingerprint")))).alias("f"))
    known = shown.select("f.*").where("fingerprint < '8'").distinct().withColumn("last_us", F.lit(start - DAY // 4))
    with rocks(spark):
        shown = views.tls_of(views.flow_of(arriving(spark, d)))
        return _finished(spark, detect.novel_fingerprints(shown, TlsConfig(novelty_s=43_200.0), known, WINDOW))


@query("stream_flow_records", sql("SELECT t_us // 1000000 AS export_s, src_ip, dst_ip, dst_port, packets, bytes FROM v_flow WHERE k % 4 < 3 AND t_us // 1000000 * 1000000 <= (SELECT max(epoch_us(ts)) // 1000000 * 1000000 - 300000 FROM events)", "v_flow"))
def stream_flow_records(spark, d):
    """IPFIX messages of four exporters in files, read as a stream. Each exporter's template comes in its first message alone, and the fourth has none."""
    f = views.flow(spark, d).withColumn("exporter", C("k") % 4)
    first = f.groupBy("exporter").agg(F.min("event_seq").alias("first"))
    # The fields' types and lengths, as in flow_records.
    template = "0002001C" + "01000005" + "".join(f"{kind:04X}{size:04X}" for kind, size in [(8, 4), (12, 4), (11, 2), (2, 4), (1, 8)])
    told = F.when((C("event_seq") == C("first")) & (C("exporter") < 3), F.lit(template)).otherwise("")
    data = F.concat(F.lit("0100001A"), views.wire(C("src_ip")), views.wire(C("dst_ip")), _hex("dst_port", 4), _hex("packets", 8), _hex("bytes", 16))
    head = F.concat(F.lit("000A"), _hex(F.shiftright(F.length(told) + F.length(data), 1) + 16, 4), _hex(F.floor(C("t_us") / 1_000_000), 8), F.lit("0000000000000001"))
    m = f.join(F.broadcast(first), "exporter").select("exporter", "event_seq", F.unhex(F.concat(head, told, data)).alias("message"))
    path = scratch.path(spark, "messages")
    for k in range(4):
        flowstream.write_messages(m.where(C("exporter") == k).repartitionByRange(3, "event_seq").sortWithinPartitions("event_seq"), f"{path}/e{k}")
    out = scratch.path(spark, "stream")
    with rocks(spark):
        found = flowstream.decoded(flowstream.read_stream(spark, path), 40 * 86_400.0, WINDOW)
        windows.drained(found, f"{out}/rows", f"{out}/checkpoint")
    r = spark.read.schema(found.schema).parquet(f"{out}/rows")
    ip = lambda k: F.concat_ws(".", *[pcap.number(n, 1, F.try_element_at("v", F.lit(k))) for n in range(4)])
    return r.where("fault is null").select("export_s", views.from_wire(ip(8)).alias("src_ip"), views.from_wire(ip(12)).alias("dst_ip"), flowrec.value(11).cast("int").alias("dst_port"), flowrec.value(2).alias("packets"), flowrec.value(1).alias("bytes"))
