import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidewatch.config import C2Config, DdosConfig, DgaConfig, DnsConfig, ExfilConfig, ReflectionConfig, ScanConfig, SlowlorisConfig, TlsConfig
from tidewatch.operators import aggregates, detectors, evaluation, flood
from tidewatch.sources.tables import attack

T0 = 1_773_280_000_000_000
EVENT = "event_seq long, t_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packets long, bytes long, direction string"


def events(spark, rows):
    """Rows of (seconds, then any of the columns)."""
    names = [c.split()[0] for c in EVENT.split(", ")]
    base = {"src_ip": "10.10.0.5", "dst_ip": "203.0.113.9", "src_port": 50_000, "dst_port": 443, "protocol": "TCP", "packets": 1, "bytes": 60, "direction": "outbound"}
    data = [{**base, "event_seq": k, "t_us": T0 + round(s * 1e6), **r} for k, (s, r) in enumerate(rows)]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in data], EVENT)


def test_scan_kinds_and_latch(spark):
    cfg = ScanConfig(min_ports=20, min_hosts=15)
    r = detectors.scan(attack("scan", spark, T0, 60), cfg).collect()
    assert [(x.threat_class, x.unique_port_count, x.severity, x.score) for x in r] == [("port_scan", 20, "MEDIUM", 1.0)]
    assert r[0].sample_ports == list(range(1, 11)) and r[0].packets_sent == 20
    assert detectors.scan(attack("sweep", spark, T0, 30), cfg).first().threat_class == "host_sweep"
    both = events(spark, [(k * 0.01, {"dst_ip": f"203.0.113.{k}", "dst_port": 1000 + k}) for k in range(20)])
    assert detectors.scan(both, replace(cfg, min_ports=10, min_hosts=10)).first().threat_class == "network_scan"
    # Exactly the gap joins; a microsecond more begins anew, and can alert again.
    rows = [(k * 10.0, {"dst_port": k + 1}) for k in range(20)]
    assert detectors.scan(events(spark, rows), cfg).count() == 1
    assert detectors.scan(events(spark, rows[:10] + [(s + 0.000001, r) for s, r in rows[10:]]), cfg).count() == 0
    replies = events(spark, [(k * 0.01, {"src_port": 443, "dst_port": 2000 + k}) for k in range(60)])
    resolver = events(spark, [(k * 0.01, {"src_ip": "10.10.0.53", "dst_ip": f"8.8.{k}.1", "dst_port": 53}) for k in range(60)])
    assert detectors.scan(replies, cfg).count() == 0 and detectors.scan(resolver, cfg).count() == 0


def test_beacons(spark):
    rng = random.Random(4)
    at, rows = 0.0, []
    for _ in range(10):
        rows.append((at, {}))
        at += rng.uniform(9.8, 10.2)
    r = detectors.c2(events(spark, rows)).first()
    assert r.event_count == 8 and r.iat_cv <= 0.15 and r.severity == "CRITICAL" and 9.7 < r.iat_median < 10.3
    assert detectors.c2(events(spark, [(k * 0.01, {}) for k in range(12)])).count() == 0
    fleet = [(s + h * 0.1, {"src_ip": f"10.10.0.{h}"}) for s, _ in rows for h in (1, 2, 3, 4)]
    assert detectors.c2(events(spark, sorted(fleet, key=lambda x: x[0]))).count() == 0
    assert detectors.c2(events(spark, [(s, {"direction": "inbound"}) for s, _ in rows])).count() == 0
    assert detectors.c2(events(spark, [(s, {"direction": None}) for s, _ in rows])).count() == 1


DNS = "event_seq long, t_us long, src_ip string, qname string, qtype string, nxdomain boolean"


def dns(spark, rows):
    return spark.createDataFrame([(k, T0 + round(s * 1e6), "10.10.0.7", *r) for k, (s, *r) in enumerate(rows)], DNS)


def test_generated_names(spark):
    odd = dns(spark, [(k, f"xzkjqwyfp793{k}bcdf.info.com", "A", True) for k in range(6)])
    odd = odd.withColumn("qname", F.concat(F.lit("xzkjqwvfp7931"), F.col("event_seq"), F.lit("bcdfg.com")))
    r = detectors.dga(odd).first()
    assert (r.query_count, r.threat_class, r.score_type) == (5, "dga_domain", "rule_score") and r.score >= 0.85 and r.nxdomain_rate == 1.0
    assert detectors.dga(dns(spark, [(k, "www.google.com", "A", False) for k in range(9)])).count() == 0
    model = odd.select("qname").distinct().withColumn("p", F.lit(0.97))
    on = detectors.dga(odd, model=model, mode="on").first()
    assert on.score_type == "model_probability" and on.severity == "HIGH" and on.model_mean == pytest.approx(0.97)
    # The failure count goes on past the first hundred queries.
    many = dns(spark, [(k, "stillplainname.com" if k < 100 else "x.com", "A", k >= 100) for k in range(260)])
    assert detectors.dga(many, DgaConfig(high=2.0, low=0.0, nx_rate=1.5)).first().nxdomain_rate > 1


def test_dns_tunnels(spark):
    long = "a1b2c3d4e5f6g7h8i9j0k1l2m3n4o5p6q7r8s9t0u1v2w3x4y5.evil.com"
    r = detectors.dns_tunnel(dns(spark, [(k, f"{k}{long}", "A", False) for k in range(6)])).first()
    assert (r.query_count, r.registered_domain, r.threat_class) == (5, "evil.com", "dns_tunnel") and r.score == 1.0
    assert detectors.dns_tunnel(dns(spark, [(k, "www.example.com", "A", False) for k in range(20)])).count() == 0
    txt = detectors.dns_tunnel(dns(spark, [(k, "somewhatlongername.evil.com", "TXT", False) for k in range(6)])).first()
    assert txt.severity == "HIGH" and txt.txt_share == 1.0
    assert detectors.dns_tunnel(dns(spark, [(k * 61, f"{k}{long}", "A", False) for k in range(9)])).count() == 0


def test_exfiltration(spark):
    r = detectors.exfil(attack("exfil", spark, T0, 10)).first()
    assert (r.outbound_bytes, r.inbound_bytes, r.burst_or_sustained, r.severity) == (400_000, 0, "burst", "HIGH")
    back = events(spark, [(k, {"bytes": 200_000} if k % 2 else {"bytes": 200_000, "src_ip": "203.0.113.9", "dst_ip": "10.10.0.5", "direction": "inbound"}) for k in range(10)])
    assert detectors.exfil(back).count() == 0
    z = detectors.exfil(back, ExfilConfig(median_bytes=1000.0, mad_bytes=500.0)).first()
    assert z.score_type == "robust_z" and z.score == z.robust_z
    assert detectors.exfil(events(spark, [(k, {"bytes": 200_000, "direction": "internal"}) for k in range(9)])).count() == 0
    assert detectors.exfil(events(spark, [(k, {"bytes": 200_000, "direction": None}) for k in range(9)])).count() == 1
    two_way = events(spark, [(0, {})]).withColumn("flow_summary", F.expr("named_struct('bytes_toserver', 10L, 'bytes_toclient', 900000L, 'pkts_toserver', 1L, 'pkts_toclient', 9L)"))
    two_way = two_way.withColumns({"src_ip": F.lit("203.0.113.9"), "dst_ip": F.lit("10.10.0.5"), "direction": F.lit("inbound")})
    assert detectors.exfil(two_way).first().outbound_bytes == 900_000


def tls(spark, rows):
    e = events(spark, [(s, {"dst_port": r.get("dst_port", 443)}) for s, r in rows])
    extra = spark.createDataFrame([(k, r.get("ja3"), r.get("ja4"), r.get("sni", "a.b"), r.get("size")) for k, (_, r) in enumerate(rows)], "event_seq long, ja3 string, ja4 string, sni string, pkt_size int")
    return e.join(extra, "event_seq")


def test_encrypted_sessions(spark):
    bad = detectors.tls_quic(tls(spark, [(0, {"ja3": "72A589DA586844D7F0818CE684948EEA"})])).first()
    assert (bad.score, bad.severity, bad.bad_ja3) == (0.9, "HIGH", True)
    assert detectors.tls_quic(tls(spark, [(0, {"sni": None, "dst_port": 4433})])).first().no_sni
    assert detectors.tls_quic(tls(spark, [(0, {"sni": None})])).count() == 0
    even = detectors.tls_quic(tls(spark, [(k * 5, {"size": 120}) for k in range(6)])).first()
    assert even.fixed_size and even.sizes == 5 and even.score == 0.75
    assert detectors.tls_quic(tls(spark, [(k * 5, {"size": 120 + k}) for k in range(6)])).count() == 0


def test_novel_fingerprints(spark):
    day = 86_400
    base = spark.createDataFrame([("ja3", "aa", T0)], "kind string, fingerprint string, last_us long")
    seen = lambda *days: [r.t_us for r in detectors.novelty(tls(spark, [(d * day, {"ja3": "AA"}) for d in days]), TlsConfig(), base).where("novel").collect()]
    assert seen(6) == [] and seen(6, 14) == [T0 + 14 * day * 1_000_000]
    learning = tls(spark, [(0, {"ja3": "x"}), (3599, {"ja3": "y"}), (3600, {"ja3": "z"})])
    assert [r.ja3 for r in detectors.novelty(learning).where("novel").collect()] == ["z"]


def reflect_loop(rows, cfg):
    """One event at a time over (t_us, src, dst, sport, dport, direction), in order; a second is judged when it has ended."""
    asked, buckets, alerts, last = {}, defaultdict(dict), [], {}
    for t, src, dst, sport, dport, way in rows:
        if way != "inbound":
            asked[src, dst, dport] = t
            continue
        b = buckets[dst, sport].setdefault(t // 1_000_000, [0, {}])
        b[0] += 1
        told = asked.get((dst, src, sport))
        b[1].setdefault(src, told is not None and t - told <= cfg.memory_s * 1e6)
    for key, seconds in buckets.items():
        for s in sorted(seconds):
            window = {k: b for k, b in seconds.items() if s - cfg.window_s < k <= s}
            amps = defaultdict(bool)
            for _, m in window.values():
                for ip, told in m.items():
                    amps[ip] = amps[ip] or told
            pps = sum(b[0] for b in window.values()) / max(1, s - min(window) + 1)
            if len(amps) >= cfg.min_fan_in and sum(not v for v in amps.values()) / len(amps) >= cfg.min_unsolicited and pps >= cfg.min_pps and s - last.get(key, -1e9) >= cfg.cooldown_s:
                last[key] = s
                alerts.append((*key, s, len(amps)))
    return sorted(alerts)


def test_reflection_against_a_loop(spark):
    rng = random.Random(6)
    cfg = ReflectionConfig(min_fan_in=4, min_unsolicited=0.6, min_pps=3.0, cooldown_s=20.0, memory_s=3.0)
    rows, t = [], T0
    for k in range(1500):
        t += rng.choice([0, 1000, 300_000, 900_000])
        amp, victim = f"93.184.216.{rng.randrange(9)}", f"10.10.0.{rng.randrange(2)}"
        rows.append((t, victim, amp, 40_000, 123, "outbound") if rng.random() < 0.2 else (t, amp, victim, 123, 40_000, "inbound"))
    df = spark.createDataFrame([(k, t, s, d, sp, dp, "UDP", 1, 60, w) for k, (t, s, d, sp, dp, w) in enumerate(rows)], EVENT)
    got = sorted((r.dst_ip, r.amplifier_port, r.event_seq, r.fan_in) for r in detectors.reflection(df, cfg).collect())
    assert got == reflect_loop(rows, cfg) and len(got) > 3


def test_reflection_burst_alerts_once(spark):
    r = detectors.reflection(attack("reflection", spark, T0, 18_000)).collect()
    assert [(x.fan_in, x.unsolicited_share, x.threat_class) for x in r] == [(80, 1.0, "udp_reflection")]


def test_slowloris(spark):
    flows = lambda d, b: spark.createDataFrame([("10.10.0.8", 80 if k else None, T0, d, b, 2) for k in range(8)], "dst_ip string, dst_port int, w_us long, duration_s double, bytes long, packets long")
    assert detectors.slowloris(flows(2.0, 350)).count() == 0 and detectors.slowloris(flows(18.5, 5000)).count() == 0
    r = detectors.slowloris(flows(18.5, 350)).first()
    assert (r.concurrency, r.duration_p95, r.threat_class, r.score) == (8, 18.5, "slowloris", 1.0)
    assert detectors.slowloris(flows(18.5, 350), SlowlorisConfig(min_flows=9)).count() == 0


def windows(spark, rates, **more):
    return spark.createDataFrame([(T0 + k * 1_000_000, float(r), int(r), more.get("syn", 0), more.get("ack", 0), more.get("udp", 0), more.get("share", 0.1), more.get("resolver", 0)) for k, r in enumerate(rates)], "w_us long, pps double, packets long, syn long, ack long, udp long, top_flow_share double, resolver_packets long")


def test_flood_hysteresis_baseline_and_suppression(spark):
    rates = [10, 11, 9, 10, 12, 10] + [6000, 6000, 6000] + [10]
    v = flood.verdicts(windows(spark, rates)).orderBy("w_us").collect()
    assert [r.run for r in v] == [0] * 6 + [1, 2, 3, 0] and [r.alert for r in v] == [False] * 7 + [True, True, False]
    assert v[6].median_pps == 10.0 and v[6].z > 6 and v[9].median_pps == 10.0
    flat = flood.verdicts(windows(spark, [1] * 6 + [6000] * 2)).orderBy("w_us").collect()
    assert flat[-1].z == 5999.0
    assert not flood.verdicts(windows(spark, rates, resolver=9000)).where("alert").count()
    assert not flood.verdicts(windows(spark, rates, share=0.9)).where("alert").count()
    kinds = lambda **k: {r.threat_class for r in flood.verdicts(windows(spark, rates, **k)).where("alert").collect()}
    assert kinds(syn=9) == {"syn_flood"} and kinds(udp=5000) == {"udp_flood"} and kinds() == {"volumetric_flood"}
    low = flood.verdicts(windows(spark, rates, udp=5000), DdosConfig(hysteresis=3)).where("alert").count()
    assert low == 1


def test_window_of_a_flood_and_double_counted_syn(spark):
    f = attack("flood", spark, T0, 6000).withColumn("tcp_flags_str", F.lit("S"))
    w = aggregates.windows(f, 1.0).first()
    assert (w.event_count, w.syn, w.top_dst_ip, w.unique_src, w.tcp) == (6000, 12_000, "10.10.0.5", 6000, 6000)
    w2 = aggregates.windows(f.withColumn("tcp_flags_str", F.lit("SA")).withColumn("packets", F.lit(None).cast("long")), 1.0).first()
    assert (w2.syn, w2.ack, w2.packets, w2.pps) == (6000, 6000, 6000, 6000.0)


def test_flow_table_sides_and_states(spark):
    rows = [(0, {}), (1, {"src_ip": "203.0.113.9", "dst_ip": "10.10.0.5", "src_port": 443, "dst_port": 50_000, "bytes": 500}), (302, {}), (303, {})]
    f = events(spark, rows).withColumns({"flow_id": F.lit("f"), "tcp_flags": F.when(F.col("event_seq") == 3, 5).otherwise(16)})
    r = aggregates.flow_table(f).orderBy("first_us").collect()
    assert [(x.events, x.fwd_packets, x.rev_bytes, x.state) for x in r] == [(2, 1, 500, "ACTIVE"), (2, 2, 0, "RESET")]
    r = aggregates.flow_table(events(spark, [(k * 200, {}) for k in range(40)]).withColumns({"flow_id": F.lit("f"), "tcp_flags": F.lit(None).cast("int")})).collect()
    assert len(r) == 3 and all(x.duration_s < 3600 for x in r)


def test_sweeps_equal_a_run_for_each_setting(spark):
    e = attack("scan", spark, T0, 120).unionByName(attack("sweep", spark, T0, 90, "10.10.0.77").withColumn("event_seq", F.col("event_seq") + 300)).unionByName(attack("scan", spark, T0 + 60_000_000, 70).withColumn("event_seq", F.col("event_seq") + 600))
    grid = [(10, 20), (50, 100), (80, 60), (1000, 1000)]
    got = {(r.hosts, r.ports, r.src_ip, r.t_us, r.event_seq, round(r.score, 9)) for r in evaluation.scan_sweep(e, grid).collect()}
    want = {(h, p, r.src_ip, r.t_us, r.event_seq, round(r.score, 9)) for h, p in grid for r in detectors.scan(e, ScanConfig(min_hosts=h, min_ports=p)).collect()}
    assert got == want and len({x[:2] for x in got}) == 3
    jitter = attack("beacon", spark, T0, 60).withColumn("t_us", F.col("t_us") + F.pmod(F.col("event_seq") * 7919, F.lit(23)) * F.col("event_seq") * 10_000)
    limits = [0.01, 0.05, 0.15, 0.4]
    got = {(r.max_cv, r.src_ip, r.t_us, round(r.iat_cv, 9)) for r in evaluation.c2_sweep(jitter, limits).collect()}
    want = {(c, r.src_ip, r.t_us, round(r.iat_cv, 9)) for c in limits for r in detectors.c2(jitter, C2Config(max_cv=c)).collect()}
    assert got == want and got


def test_samples_do_not_depend_on_partitions(spark):
    e = attack("scan", spark, T0, 300)
    runs = [sorted((r.w_us, r.n, tuple(x.event_seq for x in r.samples)) for r in aggregates.window_samples(e.repartition(n), 1.0, ["src_ip"], most=5).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and all(r[1] <= 5 == len(set(r[2])) or r[1] == len(r[2]) for r in runs[0])


def test_generated_names_against_a_loop(spark):
    r = random.Random(5)
    names = ["www.google.com", "mail.example.org", *["".join(r.choices("bcdfghjklmnpqrstvwxz0123456789", k=16)) + ".info" for _ in range(20)]]
    rows = []
    for host in range(12):
        for _ in range([3, 60, 100, 101, 400, 600][host % 6]):
            odd = r.random() < host / 14
            rows.append((f"10.10.1.{host}", T0 + r.randrange(10**9), len(rows), names[2 + r.randrange(20)] if odd else names[r.randrange(2)], "A", r.random() < 0.05 + host / 30))
    e = spark.createDataFrame(rows, "src_ip string, t_us long, event_seq long, qname string, qtype string, nxdomain boolean")
    score = {x.qname: x.s for x in e.select("qname", detectors.domains.rule_score(F.col("qname")).alias("s")).distinct().collect()}
    late = 0
    for cfg in (DgaConfig(high=0.5, low=0.1, nx_rate=0.3), DgaConfig(high=0.8, low=0.05, nx_rate=0.9), DgaConfig(high=2.0, low=0.0, nx_rate=1.0), DgaConfig(min_queries=101, high=0.1)):
        want = set()
        for host in {x[0] for x in rows}:
            total = nx = 0
            for k, x in enumerate(sorted((x for x in rows if x[0] == host), key=lambda x: x[1:3]), 1):
                total += score[x[3]] if k <= cfg.history else 0
                nx += x[5]
                n = min(k, cfg.history)
                if n >= cfg.min_queries and (total / n >= cfg.high or total / n >= cfg.low and nx / n >= cfg.nx_rate):
                    want.add((host, x[2], n, round(total / n, 6), round(nx / n, 6)))
                    late += k > cfg.history
                    break
        got = {(x.src_ip, x.event_seq, x.query_count, round(x.avg_score, 6), round(x.nxdomain_rate, 6)) for x in detectors.dga(e, cfg).collect()}
        assert got == want
    assert late >= 3


def test_a_long_stretch_of_firings(spark):
    stamps = [0, *range(2, 4000), *range(5000, 5003)]
    df = spark.createDataFrame([("a", s) for s in stamps] + [("b", 7)], "k string, at long")
    want, last = [], None
    for s in stamps:
        if last is None or s - last >= 3:
            want, last = [*want, s], s
    got = detectors.cooled(df, ["k"], "at", 3.0).orderBy("k", "at").collect()
    assert [r.at for r in got if r.k == "a"] == want and len(want) > 1000 and got[-1].at == 7


def test_generated_names_are_scored_once(spark):
    plan = detectors.dga(dns(spark, [(k, "x7f3k9q2zp.com", "A", True) for k in range(9)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS score1") == 1 and "Union" not in plan
