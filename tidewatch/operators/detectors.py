"""The keyed detectors. Each takes events and gives one row per alert: the event at which its condition first held in a session, with the measured values, score, score_type, severity and threat_class.

State is kept per key by windows over sorted keyed rows, so it spreads over the cluster; the caps of a single process on tracked keys have no counterpart, and results agree below them. Histories that change results (64 stamps, first 100 queries, 32 sizes) are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BAD_JA3, AddressPlan, C2Config, DgaConfig, DnsConfig, ExfilConfig, ReflectionConfig, ScanConfig, SlowlorisConfig, TlsConfig
from ..functions import domains, features
from . import filters
from .enrich import directional_bytes
from .sessions import ORDER, along, first_crossing, running_distinct, sessions

C = F.col
FLEET_SLICE_US = 3_600_000_000
#: Stamps that cooled() folds at a time.
BLOCK = 256


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def named(df: DataFrame, detector: str, score_type: str) -> DataFrame:
    return df.withColumns({"detector": F.lit(detector), "score_type": F.lit(score_type)})


def scan(events: DataFrame, cfg: ScanConfig = ScanConfig(), plan: AddressPlan = AddressPlan()) -> DataFrame:
    """Sources that reach min_hosts hosts or min_ports ports. Samples are the ten smallest of the crossing row."""
    s = running_distinct(sessions(filters.scan_input(events, plan), ["src_ip"], cfg.gap_s), ["src_ip"], ["dst_ip", "dst_port"])
    w = along(["src_ip"])
    s = s.withColumns({"packets_sent": F.sum(F.coalesce(C("packets"), F.lit(1))).over(w), "first_us": F.min("t_us").over(w), "_first": F.min(F.struct(*ORDER)).over(w)})
    ports, hosts = C("n_dst_port") >= cfg.min_ports, C("n_dst_ip") >= cfg.min_hosts
    hit = first_crossing(s, ["src_ip"], ports | hosts)
    # Samples are gathered for the alerts' sessions alone, not along every session.
    seen = s.select("src_ip", "session", C("t_us").alias("u_t"), C("event_seq").alias("u_seq"), C("dst_ip").alias("u_ip"), C("dst_port").alias("u_port"))
    upto = (C("u_t") < C("t_us")) | (C("u_t") == C("t_us")) & (C("u_seq") <= C("event_seq"))
    own = ["src_ip", "session"]
    smallest = lambda c: F.slice(F.sort_array(F.collect_set(c)), 1, cfg.samples)
    samples = hit.select(*own, *ORDER).join(seen, own).where(upto).groupBy(*own).agg(smallest("u_ip").alias("sample_targets"), smallest("u_port").alias("sample_ports"))
    out = hit.join(samples, own)
    pattern = F.when(ports & hosts, "hybrid").when(ports, "vertical").otherwise("horizontal")
    out = out.select(
        "src_ip", *ORDER, "first_us", C("n_dst_ip").alias("unique_dst_count"), C("n_dst_port").alias("unique_port_count"), pattern.alias("scan_pattern"), "packets_sent", ((C("t_us") - C("first_us")) / 1e6).alias("duration_s"), "sample_targets", "sample_ports",
        F.when(ports & hosts, "network_scan").when(ports, "port_scan").otherwise("host_sweep").alias("threat_class"), F.greatest(C("n_dst_ip") / cfg.min_hosts, C("n_dst_port") / cfg.min_ports).alias("score"),
        F.when((C("n_dst_ip") >= 2 * cfg.min_hosts) | (C("n_dst_port") >= 2 * cfg.min_ports), "HIGH").otherwise("MEDIUM").alias("severity"),
    )
    return named(out, "scan", "anomaly_score")


def fleet_size(events: DataFrame, key: list[str]) -> DataFrame:
    """events with fleet, the number of distinct sources that a destination has had so far, over all time. First sights are counted by slices of time, so that a service in use by everyone is split; the sights of a slice are met by its events in one sorted pass."""
    slice_of = F.floor(C("t_us") / FLEET_SLICE_US)
    sights = first_sights(events, key).select(*key, "at.*").withColumns({"_slice": slice_of, "_new": F.lit(1)})
    both = events.withColumns({"_slice": slice_of, "_new": F.lit(0)}).unionByName(sights, allowMissingColumns=True).withColumn("_event", C("_new") == 0)
    own = Window.partitionBy(*key, "_slice").orderBy(*ORDER).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sights.groupBy(*key, "_slice").agg(F.sum("_new").alias("_n"))
    starts = events.select(*key, slice_of.alias("_slice")).distinct().join(starts, [*key, "_slice"], "left").select(*key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counted = both.withColumn("_so_far", F.sum("_new").over(own)).where("_event")
    return counted.join(starts, [*key, "_slice"]).withColumn("fleet", C("_before") + C("_so_far")).select(*events.columns, "fleet")


def first_sights(events: DataFrame, key: list[str]) -> DataFrame:
    """key, src_ip and at (t_us, event_seq), one row for each source that a destination has had; combined before the shuffle."""
    return events.where(C("src_ip").isNotNull()).groupBy(*key, "src_ip").agg(F.min(F.struct(*ORDER)).alias("at"))


def shared_from(events: DataFrame, key: list[str], hosts: int) -> DataFrame:
    """key and since: the event at which a destination has its `hosts`-th source; no row for one that never has so many. Only so many first sights of each destination are shuffled from a task."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy("at"))
    return first_sights(events, key).withColumn("_n", n).where(C("_n") <= hosts).groupBy(*key).agg(F.max("at").alias("since"), F.count(F.lit(1)).alias("_n")).where(C("_n") == hosts).drop("_n")


def c2_measures(events: DataFrame, cfg: C2Config) -> tuple[DataFrame, DataFrame]:
    """The events of conversations with what is measured along each session, and those of them at which a beacon is possible, whatever its variation."""
    keys = list(cfg.key)
    e = filters.c2_input(events, cfg)
    s = sessions(e, keys, cfg.gap_s)
    iat = (C("t_us") - F.lag("t_us").over(Window.partitionBy(*keys, "session").orderBy(*ORDER))) / 1e6
    s = s.withColumn("iat", F.when(iat > cfg.min_iat_s, iat))
    w, recent = along(keys), along(keys, cfg.history - 2)
    s = s.withColumns({
        "n": F.least(F.count(F.lit(1)).over(w), F.lit(cfg.history)), "valid": F.count("iat").over(recent), "iat_mean": F.avg("iat").over(recent), "iat_std": F.coalesce(F.stddev_samp("iat").over(recent), F.lit(0.0)), "first_us": F.min("t_us").over(w), "rn": F.row_number().over(Window.partitionBy(*keys, "session").orderBy(*ORDER)),
    })
    candidates = s.where((C("n") >= cfg.min_events) & (C("valid") >= cfg.min_valid) & (C("iat_mean") >= cfg.min_mean_s))
    if cfg.fleet_hosts:
        service = [k for k in keys if k != "src_ip"]
        candidates = candidates.join(shared_from(e, service, cfg.fleet_hosts), service, "left").where(C("since").isNull() | (F.struct(*ORDER) < C("since")))
    return s, candidates


def c2(events: DataFrame, cfg: C2Config = C2Config()) -> DataFrame:
    """Conversations with regular gaps: at least min_events among the last 64 stamps, a mean of 50 ms or more and a sample coefficient of variation up to max_cv. A destination that several hosts share is a service."""
    keys, cv = list(cfg.key), C("iat_std") / C("iat_mean")
    s, candidates = c2_measures(events, cfg)
    hit = first_crossing(candidates, keys, cv <= cfg.max_cv)
    # The gaps are gathered for the alerts alone, not for every event.
    own = [*keys, "session"]
    near = s.select(*own, C("rn").alias("u_rn"), "iat").where("iat is not null").join(hit.select(*own, "rn"), own).where((C("u_rn") <= C("rn")) & (C("u_rn") > C("rn") - (cfg.history - 1)))
    gaps = near.groupBy(*own).agg(F.transform(F.sort_array(F.collect_list(F.struct("u_rn", "iat"))), lambda x: x["iat"]).alias("gaps"))
    out = hit.drop("iat").join(gaps, own).select(
        *keys, *ORDER, "first_us", C("n").alias("event_count"), "iat_mean", "iat_std", cv.alias("iat_cv"), features.quantile_of(C("gaps"), 0.5).alias("iat_median"), features.mad_of(C("gaps")).alias("iat_mad"), ((C("t_us") - C("first_us")) / 1e6).alias("duration_s"),
        F.slice("gaps", 1, 10).alias("sample_iats"), F.lit("c2_beacon").alias("threat_class"), clamp(1 - 0.5 * cv / cfg.max_cv).alias("score"), F.when(cv < 0.08, "CRITICAL").otherwise("HIGH").alias("severity"),
    )
    return named(out, "c2", "anomaly_score")


def dga(dns: DataFrame, cfg: DgaConfig = DgaConfig(), model: DataFrame | None = None, mode: str = "off", threshold: float = 0.5) -> DataFrame:
    """Sources whose first 100 queries score high, or rather high with many failures; once for each source. The failure count goes on past the hundred, so the rate can pass 1. With mode `on`, a model's mean probability (qname, p) decides; with `shadow` it is reported.

    Past the hundredth query only the failure count moves, so a source that has not been reported by then can be at one event alone: the failure that makes the rate. Thus of a source's history its first hundred queries and so many of its first failures leave a task, however many it has."""
    e = filters.dns_input(dns)
    by = Window.partitionBy("src_ip").orderBy(*ORDER)
    s = e.withColumn("rn", F.row_number().over(by)).where(C("rn") <= cfg.history).withColumns({"session": F.lit(0), "_core": domains.core_label(C("qname"))})
    if model is not None and mode != "off":
        s = s.join(model.select("qname", "p"), "qname", "left").withColumn("p", F.when(domains.is_allowlisted(C("qname")), 0.0).otherwise(C("p")))
    else:
        s = s.withColumn("p", F.lit(None).cast("double"))
    w = along(["src_ip"])
    s = s.withColumn("score1", domains.rule_score(C("qname"), C("_core"))).withColumns({
        "avg_score": F.avg("score1").over(w), "nx": F.sum(F.coalesce(C("nxdomain"), F.lit(False)).cast("int")).over(w), "first_us": F.min("t_us").over(w), "model_mean": F.avg("p").over(w), "model_n": F.count("p").over(w),
    })
    s = s.select("src_ip", "session", *ORDER, C("rn").alias("n"), "avg_score", "nx", "first_us", "model_mean", "model_n")
    enough = failures_for(cfg.nx_rate, cfg.history)
    failures = e.where(C("nxdomain")).withColumn("_nx", F.row_number().over(by)).where(C("_nx") == enough).select("src_ip", *[C(c).alias(f"_{c}") for c in ORDER])
    # The later failure is a second row of the hundredth query, made in the same pass: names are scored once.
    own = F.struct(*ORDER, C("nx").cast("long").alias("nx"))
    later = F.struct(*[C(f"_{c}").alias(c) for c in ORDER], F.lit(enough).cast("long").alias("nx"))
    late = (C("n") == cfg.history) & (F.struct("_t_us", "_event_seq") > F.struct(*ORDER))
    s = s.join(failures, "src_ip", "left").withColumn("_at", F.explode(F.when(late, F.array(own, later)).otherwise(F.array(own))))
    s = s.select("src_ip", "session", "_at.*", "n", "avg_score", "first_us", "model_mean", "model_n")
    rate = C("nx") / C("n")
    rules = (C("avg_score") >= cfg.high) | (C("avg_score") >= cfg.low) & (rate >= cfg.nx_rate)
    decides = (C("model_n") == C("n")) if mode == "on" else F.lit(False)
    hit = first_crossing(s, ["src_ip"], (C("n") >= cfg.min_queries) & F.when(decides, C("model_mean") >= threshold).otherwise(rules))
    score = F.when(decides, C("model_mean")).otherwise(C("avg_score"))
    out = hit.select("src_ip", *ORDER, "first_us", C("n").alias("query_count"), "avg_score", rate.alias("nxdomain_rate"), "model_mean", F.lit("dga_domain").alias("threat_class"), score.alias("score"), F.when(score >= 0.9, "HIGH").otherwise("MEDIUM").alias("severity"), F.when(decides, "model_probability").otherwise("rule_score").alias("score_type"))
    return out.withColumn("detector", F.lit("dga"))


def failures_for(rate: float, queries: int) -> int:
    """The least number of failures, 1 or more, whose share of `queries` is the rate."""
    n = max(int(rate * queries) - 1, 1)
    while n / queries < rate:
        n += 1
    return n


def dns_tunnel(dns: DataFrame, cfg: DnsConfig = DnsConfig()) -> DataFrame:
    """Source and registered domain with long names of high entropy, or many of some length, or a share of TXT or NULL queries. Length and entropy are means of the first 100 queries."""
    keys = list(cfg.key)
    e = filters.dns_input(dns)
    if "registered_domain" not in e.columns:
        e = e.withColumn("registered_domain", domains.registered_domain(C("qname")))
    s = sessions(e, keys, cfg.gap_s)
    rn = F.row_number().over(Window.partitionBy(*keys, "session").orderBy(*ORDER))
    s = s.withColumns({"rn": rn, "len": F.length("qname"), "h": features.entropy_of(C("qname"))})
    w, kept = along(keys), C("rn") <= cfg.history
    share = lambda t: F.sum((F.upper("qtype") == t).cast("int")).over(w) / F.count(F.nullif("qtype", F.lit(""))).over(w)
    s = s.withColumns({
        "avg_length": F.avg(F.when(kept, C("len"))).over(w), "avg_entropy": F.avg(F.when(kept, C("h"))).over(w), "first_us": F.min("t_us").over(w), **{f"{t.lower()}_share": F.coalesce(share(t), F.lit(0.0)) for t in ("TXT", "NULL", "CNAME")},
    })
    qps = C("rn") / F.greatest((C("t_us") - C("first_us")) / 1e6, F.lit(0.001))
    long = (C("avg_length") >= cfg.length) & (C("avg_entropy") >= cfg.entropy)
    many = (qps >= cfg.qps) & (C("avg_length") >= cfg.qps_length)
    odd = ((C("txt_share") > cfg.txt) | (C("null_share") > cfg.null)) & (C("avg_length") >= cfg.share_length)
    hit = first_crossing(s, keys, (C("rn") >= cfg.min_queries) & (long | many | odd))
    score = clamp(0.5 * C("avg_length") / cfg.length + 0.5 * C("avg_entropy") / cfg.entropy)
    high = (C("txt_share") > 0.3) | (C("null_share") > 0.2) | (C("avg_length") > 70)
    out = hit.select(*dict.fromkeys([*keys, "registered_domain"]), *ORDER, "first_us", C("rn").alias("query_count"), "avg_length", "avg_entropy", qps.alias("qps"), "txt_share", "null_share", "cname_share", F.lit("dns_tunnel").alias("threat_class"), score.alias("score"), F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"))
    return named(out, "dns", "anomaly_score")


def exfil(events: DataFrame, cfg: ExfilConfig = ExfilConfig()) -> DataFrame:
    """Internal host and external peer with much more sent than received, or more sent than a baseline's median by min_z robust deviations."""
    e = filters.exfil_input(events)
    if "flow_summary" not in e.columns:
        e = e.withColumn("flow_summary", F.lit(None).cast("struct<bytes_toserver: long, bytes_toclient: long, pkts_toserver: long, pkts_toclient: long>"))
    inbound = F.coalesce(C("direction") == "inbound", F.lit(False))
    e = e.withColumns(directional_bytes()).withColumns({"internal": F.when(inbound, C("dst_ip")).otherwise(C("src_ip")), "external": F.when(inbound, C("src_ip")).otherwise(C("dst_ip"))})
    keys = ["internal", "external"]
    s = sessions(e, keys, cfg.gap_s)
    w = along(keys)
    s = s.withColumns({**{n: F.sum(c).over(w) for n, c in (("outbound_bytes", "out_b"), ("inbound_bytes", "in_b"), ("outbound_packets", "out_p"), ("inbound_packets", "in_p"))}, "first_us": F.min("t_us").over(w)})
    ratio = C("outbound_bytes") / F.greatest("inbound_bytes", F.lit(1))
    z = F.lit(None).cast("double")
    if cfg.median_bytes is not None and cfg.mad_bytes:
        z = F.round((C("outbound_bytes") - cfg.median_bytes) / (1.4826 * cfg.mad_bytes), 2)
    by_z = F.coalesce(z >= cfg.min_z, F.lit(False))
    hit = first_crossing(s, keys, ((C("out_b") > 0) | (C("out_p") > 0)) & ((ratio >= cfg.min_ratio) & (C("outbound_bytes") >= cfg.min_bytes) | by_z))
    duration = F.greatest((C("t_us") - C("first_us")) / 1e6, F.lit(0.001))
    score = F.when(by_z, z).otherwise(clamp(ratio / cfg.min_ratio * 0.4 + C("outbound_bytes") / (2.0 * cfg.min_bytes) * 0.6))
    out = hit.select(
        C("internal").alias("src_ip"), C("external").alias("dst_ip"), *ORDER, "first_us", "outbound_bytes", "inbound_bytes", "outbound_packets", "inbound_packets", ratio.alias("outbound_ratio"), z.alias("robust_z"), duration.alias("duration_s"),
        F.when(duration >= cfg.sustained_s, "sustained").otherwise("burst").alias("burst_or_sustained"), F.lit("data_exfil").alias("threat_class"), score.alias("score"), F.when(C("outbound_bytes") >= 4 * cfg.min_bytes, "CRITICAL").otherwise("HIGH").alias("severity"), F.when(by_z, "robust_z").otherwise("anomaly_score").alias("score_type"),
    )
    return out.withColumn("detector", F.lit("exfil"))


def first_sightings(events: DataFrame, kind: str, novelty_s: float, baseline: DataFrame | None = None) -> DataFrame:
    """fingerprint, t_us, event_seq of the events that show a fingerprint of this kind which no one has shown within novelty_s before, in the stream or in the baseline (kind, fingerprint, last_us).

    Slices of time are no longer than novelty_s, so within a slice only a fingerprint's first event can be one. A popular fingerprint is combined by slice before the shuffle and is a row a slice after it, and no window goes over its events."""
    slice_us = max(min(int(novelty_s * 1_000_000), FLEET_SLICE_US), 1)
    shown = events.select(F.nullif(F.lower(kind), F.lit("")).alias("fingerprint"), *ORDER).where("fingerprint is not null")
    slices = shown.groupBy("fingerprint", F.floor(C("t_us") / slice_us).alias("_slice")).agg(F.min(F.struct(*ORDER)).alias("_at"), F.max("t_us").alias("_last"))
    before = F.lag("_last").over(Window.partitionBy("fingerprint").orderBy("_slice"))
    slices = slices.withColumn("_before", before)
    if baseline is not None:
        known = baseline.where(C("kind") == kind).groupBy("fingerprint").agg(F.max("last_us").alias("_known"))
        slices = slices.join(known, "fingerprint", "left").withColumn("_before", F.greatest("_before", "_known"))
    new = C("_before").isNull() | (C("_at.t_us") - C("_before") > int(novelty_s * 1_000_000))
    return slices.where(new).select("fingerprint", "_at.*")


def novelty(events: DataFrame, cfg: TlsConfig = TlsConfig(), baseline: DataFrame | None = None) -> DataFrame:
    """events with novel: a JA3 or JA4 that no one on the network has shown within novelty_s. Without a baseline (kind, fingerprint, last_us) the first warm_up_s only learn."""
    e, flags = events, []
    for kind in ("ja3", "ja4"):
        new = first_sightings(events, kind, cfg.novelty_s, baseline).withColumnRenamed("fingerprint", f"_{kind}").withColumn(f"_{kind}_new", F.lit(True))
        e = e.withColumn(f"_{kind}", F.nullif(F.lower(kind), F.lit(""))).join(new, [f"_{kind}", *ORDER], "left")
        flags.append(F.coalesce(C(f"_{kind}_new"), F.lit(False)))
    active = F.lit(True)
    if baseline is None:
        first = events.where(C("ja3").isNotNull() | C("ja4").isNotNull()).agg(F.min("t_us").alias("_start"))
        e = e.join(F.broadcast(first), how="cross")  # one row
        active = C("t_us") - C("_start") >= int(cfg.warm_up_s * 1_000_000)
    return e.withColumn("novel", active & (flags[0] | flags[1])).select(*events.columns, "novel")


def tls_quic(events: DataFrame, cfg: TlsConfig = TlsConfig(), baseline: DataFrame | None = None) -> DataFrame:
    """Encrypted sessions with a known-bad JA3, no server name off the usual ports, equal small packets at even gaps, or a novel fingerprint. Columns ja3, ja4, sni and pkt_size are null where there is none; JA3 and the name are the session's first."""
    keys = list(cfg.key)
    e = novelty(filters.tls_input(events, cfg), cfg, baseline)
    s = sessions(e, keys, cfg.gap_s)
    by = Window.partitionBy(*keys, "session").orderBy(*ORDER)
    w = along(keys)
    s = s.withColumn("rn", F.row_number().over(by))
    sized = F.count("pkt_size").over(w)
    iat = F.when(C("rn") <= cfg.samples, (C("t_us") - F.lag("t_us").over(by)) / 1e6)
    s = s.withColumns({"iat": F.when(iat > 0.001, iat), "sizes": sized})
    size = F.when(C("sizes") <= cfg.samples, C("pkt_size"))
    s = s.withColumns({
        "s_ja3": F.first("ja3", ignorenulls=True).over(w), "s_sni": F.first(F.nullif("sni", F.lit("")), ignorenulls=True).over(w), "low": F.min(size).over(w), "high": F.max(size).over(w), "n_sizes": F.count(size).over(w),
        "iat_mean": F.avg("iat").over(w), "iat_std": F.coalesce(F.stddev_samp("iat").over(w), F.lit(0.0)), "s_novel": F.max(F.coalesce("novel", F.lit(False))).over(w), "first_us": F.min("t_us").over(w),
    })
    cv = F.coalesce(C("iat_std") / C("iat_mean"), F.lit(0.0))
    bad = F.coalesce(F.lower("s_ja3").isin(*BAD_JA3), F.lit(False))
    nameless = C("s_sni").isNull() & ~C("dst_port").isin(*cfg.usual_ports)
    even = (C("n_sizes") >= cfg.min_sizes) & (C("low") == C("high")) & (C("low") > 0) & (C("low") < cfg.max_size) & (cv < cfg.max_cv)
    even = F.coalesce(even, F.lit(False))
    hit = first_crossing(s, keys, bad | nameless | even | C("s_novel"))
    out = hit.select(
        *keys, *ORDER, "first_us", C("s_ja3").alias("ja3"), C("s_sni").alias("sni"), C("n_sizes").alias("sizes"), cv.alias("iat_cv"), bad.alias("bad_ja3"), nameless.alias("no_sni"), even.alias("fixed_size"), C("s_novel").alias("novel"),
        F.lit("suspicious_encrypted_session").alias("threat_class"), F.when(bad, 0.9).when(nameless | even, 0.75).otherwise(0.6).alias("score"), F.when(bad, "HIGH").otherwise("MEDIUM").alias("severity"),
    )
    return named(out, "tls_quic", "anomaly_score")


def solicited(responses: DataFrame, requests: DataFrame, memory_s: float) -> DataFrame:
    """responses with solicited: did the victim ask this amplifier and port within memory_s before. An as-of join as one sorted pass over both sides, not a range join."""
    r = responses.select("*", F.struct(C("dst_ip").alias("host"), C("src_ip").alias("amp"), C("src_port").alias("port")).alias("_k"), F.lit(None).cast("long").alias("_asked"))
    q = requests.select(F.struct(C("src_ip").alias("host"), C("dst_ip").alias("amp"), C("dst_port").alias("port")).alias("_k"), C("t_us"), C("event_seq"), C("t_us").alias("_asked"))
    both = r.unionByName(q, allowMissingColumns=True)
    last = F.last("_asked", ignorenulls=True).over(Window.partitionBy("_k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_last", last).where("_asked is null")
    return both.withColumn("solicited", F.coalesce(C("t_us") - C("_last") <= int(memory_s * 1_000_000), F.lit(False))).select(*responses.columns, "solicited")


def reflection_buckets(events: DataFrame, cfg: ReflectionConfig, plan: AddressPlan, second_us: int = 1_000_000) -> DataFrame:
    """victim, port, second, packets, bytes and amplifiers, a map of source to whether it was asked at its first sighting in the second."""
    r = solicited(filters.reflection_responses(events, plan), filters.reflection_requests(events, plan), cfg.memory_s)
    own = ["victim", "port", "second"]
    r = r.select(C("dst_ip").alias("victim"), C("src_port").alias("port"), F.floor(C("t_us") / second_us).alias("second"), C("src_ip").alias("amp"), F.coalesce("packets", F.lit(1)).alias("p"), F.coalesce("bytes", F.lit(0)).alias("b"), "solicited", *ORDER)
    a = r.groupBy(*own, "amp").agg(F.sum("p").alias("p"), F.sum("b").alias("b"), F.min_by("solicited", F.struct(*ORDER)).alias("solicited"))
    return a


def reflection(events: DataFrame, cfg: ReflectionConfig = ReflectionConfig(), plan: AddressPlan = AddressPlan(), second_us: int = 1_000_000) -> DataFrame:
    """Victims that many unasked amplifiers answer at a high rate within window_s seconds, judged at the end of each second that has answers, with a cooldown for each victim and port."""
    a = reflection_buckets(events, cfg, plan, second_us)
    own = ["victim", "port", "second"]
    seconds = a.groupBy(*own).agg(F.sum("p").alias("p"), F.sum("b").alias("b"))
    back = Window.partitionBy("victim", "port").orderBy("second").rangeBetween(-(cfg.window_s - 1), 0)
    seconds = seconds.withColumns({"packets": F.sum("p").over(back), "bytes": F.sum("b").over(back), "first_second": F.min("second").over(back)})
    # Each second's amplifiers serve the windows that end in it or up to window_s - 1 seconds later: window_s rows each, whatever the rate.
    served = a.select("victim", "port", "amp", "solicited", F.explode(F.sequence(C("second"), C("second") + cfg.window_s - 1)).alias("second"))
    fan = served.groupBy(*own, "amp").agg(F.max("solicited").alias("solicited")).groupBy(*own).agg(F.count(F.lit(1)).alias("fan_in"), F.avg((~C("solicited")).cast("int")).alias("unsolicited_share"))
    s = seconds.join(fan, own).withColumn("span", F.greatest(C("second") - C("first_second") + 1, F.lit(1)))
    s = s.withColumns({"pps": C("packets") / C("span"), "bps": C("bytes") * 8 / C("span")})
    hot = s.where((C("fan_in") >= cfg.min_fan_in) & (C("unsolicited_share") >= cfg.min_unsolicited) & ((C("pps") >= cfg.min_pps) | (C("bps") >= cfg.min_bps)))
    fired = cooled(hot, ["victim", "port"], "second", cfg.cooldown_s)
    ratio = F.greatest(C("pps") / cfg.min_pps, C("bps") / cfg.min_bps)
    out = fired.select(
        C("victim").alias("dst_ip"), C("port").alias("amplifier_port"), (C("second") * second_us).alias("t_us"), C("second").alias("event_seq"), (C("first_second") * second_us).alias("first_us"), "fan_in", "unsolicited_share", "pps", "bps", "packets", "bytes",
        F.lit("udp_reflection").alias("threat_class"), (0.5 + 0.5 * clamp((ratio - 1) / 4)).alias("score"), F.when((C("pps") >= 5 * cfg.min_pps) | (C("bps") >= 5 * cfg.min_bps), "CRITICAL").otherwise("HIGH").alias("severity"),
    )
    return named(out, "reflection", "anomaly_score")


def cooled(df: DataFrame, keys: list[str], at: str, cooldown: float) -> DataFrame:
    """Rows that fire: a key's first, then each first one at least `cooldown` after the last that fired. A stamp that long after its predecessor always fires, so the recurrence is a fold over each stretch of closer stamps, one long each. It is folded by blocks, as a list that grows is copied at each firing."""
    by = Window.partitionBy(*keys).orderBy(at)
    stamps = df.select(*keys, at).distinct().withColumn("_new", F.coalesce((C(at) - F.lag(at).over(by) >= cooldown).cast("int"), F.lit(0)))
    stamps = stamps.withColumn("_stretch", F.sum("_new").over(by)).groupBy(*keys, "_stretch").agg(F.sort_array(F.collect_list(at)).alias("_s"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / BLOCK).cast("int")), lambda k: F.slice("_s", k * BLOCK + 1, F.lit(BLOCK)))
    none = F.lit(None).cast("long").alias("last")

    def step(acc: Column, x: Column) -> Column:
        return F.when(acc["last"].isNull() | (x - acc["last"] >= cooldown), F.struct(x.alias("last"), F.concat(acc["fired"], F.array(x)).alias("fired"))).otherwise(acc)

    def block(acc: Column, stamps: Column) -> Column:
        start = F.struct(acc["last"].alias("last"), F.array().cast("array<long>").alias("fired"))
        return F.aggregate(stamps, start, step, lambda a: F.struct(a["last"].alias("last"), F.concat(acc["blocks"], F.array(a["fired"])).alias("blocks")))

    folded = F.aggregate(blocks, F.struct(none, F.array().cast("array<array<long>>").alias("blocks")), block, lambda a: F.flatten(a["blocks"]))
    return df.join(stamps.select(*keys, F.explode(folded).alias(at)), [*keys, at])


def reflection_rule(windows: DataFrame, plan: AddressPlan = AddressPlan(), min_fan_in: int = 10, min_pps: float = 5_000.0) -> DataFrame:
    """The stateless window rule: outcome ALERT or QUIET, or NOT_OBSERVABLE where an input is missing."""
    missing = C("port").isNull() | C("fan_in").isNull() | C("pps").isNull()
    hit = C("port").isin(*plan.amplifier_ports) & (C("fan_in") >= min_fan_in) & (C("pps") >= min_pps)
    return windows.withColumn("outcome", F.when(missing, "NOT_OBSERVABLE").when(hit, "ALERT").otherwise("QUIET"))


def slowloris(flows: DataFrame, cfg: SlowlorisConfig = SlowlorisConfig()) -> DataFrame:
    """From flow summaries (w_us, end of their window; dst_ip, dst_port, duration_s, bytes, packets): target and window with many long, small, slow flows in the last memory_s. A missing port is 80."""
    f = flows.where(C("dst_ip").isNotNull()).withColumn("dst_port", F.coalesce(F.nullif("dst_port", F.lit(0)), F.lit(80)))
    own, memory = ["dst_ip", "dst_port", "w_us"], int(cfg.memory_s * 1_000_000)
    back = Window.partitionBy("dst_ip", "dst_port").orderBy("w_us").rangeBetween(-memory, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    # One row for each window and duration, then one for each window: the target under attack is combined before the shuffle.
    by_duration = f.groupBy(*own, zero("duration_s").cast("double").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(zero("bytes")).alias("b"), F.sum(zero("packets")).alias("p"))
    s = by_duration.groupBy(*own).agg(F.sum("n").alias("n"), F.sum(F.when(C("d") < cfg.min_p95_s, C("n")).otherwise(0)).alias("short"), F.sum("b").alias("b"), F.sum("p").alias("p"))
    s = s.select(*own, *[F.sum(x).over(back).alias(y) for x, y in (("n", "concurrency"), ("short", "short"), ("b", "b"), ("p", "p"))])
    s = s.withColumns({"rank": F.ceil(F.lit(0.95) * C("concurrency")), "bytes_per_connection": C("b") / C("concurrency"), "pps": C("p") / F.lit(cfg.window_s)}).drop("b", "p")
    # The percentile reaches the threshold if fewer flows than its rank are below; it is worked out for the alerts alone.
    hit = s.where((C("concurrency") >= cfg.min_flows) & (C("short") < C("rank")) & (C("bytes_per_connection") <= cfg.max_bytes) & (C("pps") <= cfg.max_pps)).drop("short")
    part = F.floor(C("w_us") / memory)
    served = by_duration.select("dst_ip", "dst_port", C("w_us").alias("u_us"), "d", "n", F.explode(F.array(part, part + 1)).alias("_part"))
    near = hit.select(*own, "rank", part.alias("_part")).join(served, ["dst_ip", "dst_port", "_part"]).where(C("u_us").between(C("w_us") - memory, C("w_us")))
    near = near.groupBy(*own, "rank", "d").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy(*own).orderBy("d")))
    hit = hit.drop("rank").join(near.where(C("upto") >= C("rank")).groupBy(*own).agg(F.min("d").alias("duration_p95")), own)
    out = hit.withColumns({"score": clamp(0.5 * C("concurrency") / cfg.min_flows + 0.5 * C("duration_p95") / cfg.min_p95_s), "severity": F.lit("HIGH"), "threat_class": F.lit("slowloris"), "t_us": C("w_us"), "event_seq": C("w_us"), "first_us": C("w_us")})
    return named(out, "ddos", "anomaly_score")
