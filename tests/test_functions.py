import hashlib
import ipaddress
import json
import math

import pytest
from pyspark.sql import functions as F

from tidewatch.config import AddressPlan
from tidewatch.functions import alerts, domains, features, network, scalars


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_entropy_and_quantiles(spark):
    v = F.array(*map(F.lit, (0.0, 1.0, 3.0)))
    gaps = F.array(F.lit(1.0), F.lit(2.0))
    r = one(spark, features.entropy_of(F.lit("aaaa")), features.entropy_of(F.lit("ab")), features.entropy_of(F.lit("")), features.entropy_of(F.lit("xzkjqwyfp7931")), features.quantile_of(gaps, 0.5), features.quantile_of(gaps, 0.95), features.mad_of(v))
    assert list(r) == [0.0, 1.0, 0.0, pytest.approx(3.70044, abs=1e-5), 1.5, pytest.approx(1.95), 1.0]


def test_robust_z_on_flat_baselines(spark):
    f, g = features.robust_z_feature, features.robust_z_rate
    c = lambda *x: [F.lit(v).cast("double") for v in x]
    r = one(spark, f(*c(2, 1, 0)), f(*c(0, 1, 0)), f(*c(1, 1, 0)), f(*c(2, None, None)), g(*c(6000, 1, 0)), g(*c(1, 1, 0)))
    assert list(r) == [math.inf, -math.inf, 0.0, 0.0, 5999.0, 0.0]


def test_flags_protocols_and_times(spark):
    r = one(spark, scalars.tcp_flag_letters(F.lit(0)), scalars.tcp_flag_letters(F.lit(0xFF)), scalars.tcp_flag_letters(F.lit(None).cast("int")), scalars.protocol_name(F.lit(58)), scalars.protocol_name(F.lit("udp")), scalars.protocol_name(F.lit("")), scalars.protocol_name(F.lit(99)), scalars.iso8601(F.lit(1_773_280_005_000_000)))
    assert list(r) == ["-", "FSRPAUEC", None, "ICMPv6", "UDP", None, "99", "2026-03-12T01:46:45.000000+00:00"]
    with pytest.raises(ValueError):
        scalars.display_us(F.lit(1), 0, 0, 0.0)


def test_identifiers(spark):
    key = scalars.canonical([(F.lit("Volumetric DDoS / flooding"), False), (F.lit("10.0.0.5"), False), (F.lit(80), True)])
    odd = scalars.canonical([(F.lit('é"\\'), False), (F.lit(None).cast("string"), False), (F.lit(None).cast("int"), True)])
    r = one(spark, scalars.identifier(key), odd, scalars.identifier(F.lit("10.0.0.5")))
    assert r[0] == "76a0e06761163ee9"
    assert json.loads(r[1]) == ['é"\\', "NOT_OBSERVABLE", "NOT_OBSERVABLE"] and "é" in r[1]
    assert r[2] == hashlib.sha256(b"10.0.0.5").hexdigest()[:16]


def test_flow_id_is_the_same_both_ways_and_orders_ports_as_text(spark):
    c = lambda *x: [F.lit(v) for v in x]
    a = scalars.flow_id(*c("10.0.0.1", "10.0.0.1", 9, 10, 6))
    b = scalars.flow_id(*c("10.0.0.1", "10.0.0.1", 10, 9, "tcp"))
    none = scalars.flow_id(F.lit("x"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(1), F.lit(None).cast("string"))
    r = one(spark, a, b, none)
    assert r[0] == r[1] == hashlib.sha256(b'["10.0.0.1",10,"10.0.0.1",9,"TCP"]').hexdigest()[:16]
    assert r[2] == hashlib.sha256(b'["NOT_OBSERVABLE",1,"x","NOT_OBSERVABLE","NOT_OBSERVABLE"]').hexdigest()[:16]


def test_membership_and_bogons(spark):
    plan = AddressPlan(monitored=("10.10.0.0/16", "2001:db8::/32"), lab=("172.20.0.0/14",))
    ips = ["10.10.3.4", "10.100.3.4", "2001:db8::9", "2001:db9::9", "bad", None, "172.22.1.1", "203.0.113.7", "8.8.8.8", "127.0.0.1", "192.0.0.8", "10.10.0.256"]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", network.member(F.col("ip"), plan.monitored).alias("m"), network.is_bogon(F.col("ip"), plan).alias("b"), network.direction(F.lit("10.10.1.1"), F.col("ip"), plan).alias("d")).collect()
    got = {r.ip: (r.m, r.b, r.d) for r in rows}
    assert [got[i][0] for i in ips] == [True, False, True, False, None, None, False, False, False, False, False, None]
    declared = [ipaddress.ip_network(p) for p in plan.declared]
    for i in ips:
        try:
            a = ipaddress.ip_address(i)
        except ValueError:
            assert not got[i][1] and got[i][2] is None
            continue
        if a.version == 4:
            assert got[i][1] == ((a.is_private or a.is_reserved or a.is_multicast or a.is_loopback or a.is_unspecified) and not any(a in n for n in declared if n.version == 4))
    assert got["2001:db8::9"][2] == "internal" and got["8.8.8.8"][2] == "outbound"


def test_domains(spark):
    q = [("www.sub.example.com.", "example", "example.com", 4), ("host.bad.zz", "host", "bad.zz", 3), ("single", "single", "single", 1), ("A.CO", "a", "a.co", 2)]
    rows = spark.createDataFrame(q, "q string, core string, reg string, n int").select("*", domains.core_label(F.col("q")).alias("c"), domains.two_labels(F.col("q")).alias("r"), domains.label_count(F.col("q")).alias("k"), domains.registered_domain(F.col("q")).alias("d")).collect()
    for r in rows:
        assert (r.c, r.r, r.k) == (r.core, r.reg, r.n)
    assert {r.q: r.d for r in rows}["single"] == "NOT_OBSERVABLE"
    s = one(spark, domains.rule_score(F.lit("www.google.com")), domains.rule_score(F.lit("abc.com")), domains.rule_score(F.lit("xzkjqwyfp7931.com")), domains.registered_domain_dataset(F.lit("a.b.co.in")), domains.ngram_anomaly(F.lit("the")), domains.ngram_anomaly(F.lit("x")))
    assert s[0] == 0.0 and s[1] == 0.0 and s[2] > 0.8 and s[3] == "b.co.in" and s[4] == 0.0 and s[5] == 0.0


def test_feature_vector_is_frozen(spark):
    r = one(spark, features.feature_vector({"packet_size_first_n": F.array(*map(F.lit, (60, 120, 240))), "length": F.lit(3)}))
    assert len(r[0]) == 20 and r[0][0] == 3.0 and r[0][12] == 140.0


def test_severity_and_confidence(spark):
    d = lambda x: F.lit(x).cast("double")
    r = one(spark, *[alerts.severity_of(d(x), F.lit("anomaly_score")) for x in (None, 0.9, 0.75, 0.5, 0.25, 0.1)], *[alerts.severity_of(d(x), F.lit("robust_z")) for x in (12, 8, 5, 3, 1)])
    assert list(r) == ["MEDIUM", "CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
    c = one(spark, alerts.confidence_of(d(6), F.lit("robust_z"), F.lit(6.0), d(None), d(None)), alerts.confidence_of(d(math.inf), F.lit("robust_z"), F.lit(6.0), d(None), d(None)), alerts.confidence_of(d(0.7), F.lit("model_probability"), F.lit(6.0), d(1), d(0)), alerts.escalate(F.lit("HIGH"), F.lit("LOW")))
    assert tuple(c[0]) == (0.6321, "uncalibrated") and tuple(c[1]) == (0.0, "uncalibrated") and tuple(c[2]) == (0.7, "platt_dga") and c[3] == "HIGH"
