"""Labels, name lists and baselines from files that Spark can read, and synthetic volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Attack labels from a JSON list: attack_id, letter, key_ips, t_start, t_end (microseconds). A letter that isn't a to f, or an end before its start, is an error."""
    raw = spark.read.schema("attack_id string, ps_letter string, key_ips array<string>, t_start double, t_end double").option("multiLine", True).json(path)
    wrong = ~C("ps_letter").isin(*"abcdef") | C("ps_letter").isNull() | (C("t_end") < C("t_start"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("bad label "), F.coalesce("attack_id", F.lit("?"))))).otherwise(C("ps_letter"))
    us = lambda c: F.round(C(c) * 1_000_000).cast("long").alias(c)
    return raw.select("attack_id", checked.alias("letter"), "key_ips", us("t_start"), us("t_end"))


def names(spark: SparkSession, path: str, top: int) -> DataFrame:
    """The first `top` different names of a list: the last field of each line, lower case, without the final dot; lines with # and names without a dot are passed over."""
    raw = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    name = F.rtrim(F.lower(F.trim(F.element_at(F.split("value", ","), -1))), F.lit("."))
    n = raw.where(~F.trim("value").startswith("#")).select("line", name.alias("name")).where(C("name").contains("."))
    return n.groupBy("name").agg(F.min("line").alias("line")).orderBy("line").limit(top)


def fingerprint_baseline(spark: SparkSession, path: str) -> DataFrame:
    """kind, fingerprint, last_us from a JSON object of two maps of fingerprint to seconds."""
    raw = spark.read.schema("ja3 map<string,double>, ja4 map<string,double>").option("multiLine", True).json(path)
    from functools import reduce

    parts = [raw.select(F.lit(k).alias("kind"), F.explode(k).alias("fingerprint", "s")) for k in ("ja3", "ja4")]
    return reduce(DataFrame.unionByName, parts).select("kind", F.lower("fingerprint").alias("fingerprint"), F.round(C("s") * 1_000_000).cast("long").alias("last_us"))


def synthetic_flows(spark: SparkSession, n: int, hosts: int = 250, externals: int = 1000, start_us: int = 1_773_280_000_000_000, rate: int = 25_000, seed: int = 1) -> DataFrame:
    """n benign flow events at `rate` a second, made from row numbers and hashes in parallel: the same for the same seed, at any partitioning."""
    h = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m))
    out = h(1, 3) > 0
    host, ext = F.concat(F.lit("10.10.1."), h(2, hosts) + 1), F.concat(F.lit("93.184."), h(3, externals) % 250, F.lit("."), h(4, 250) + 1)
    port = F.element_at(F.array(*map(F.lit, (443, 80, 53, 8443, 123))), (h(5, 5) + 1).cast("int"))
    high = (h(6, 60_000) + 1024).cast("int")
    udp = port.isin(53, 123)
    return spark.range(n).select(
        C("id").alias("event_seq"), (F.lit(start_us) + C("id") * (1_000_000 // rate)).alias("t_us"), F.when(out, host).otherwise(ext).alias("src_ip"), F.when(out, ext).otherwise(host).alias("dst_ip"), F.when(out, high).otherwise(port).alias("src_port"), F.when(out, port).otherwise(high).alias("dst_port"),
        F.when(udp, "UDP").otherwise("TCP").alias("protocol"), F.when(~udp, F.element_at(F.array(*map(F.lit, (2, 18, 16, 24, 17))), (h(7, 5) + 1).cast("int"))).alias("tcp_flags"), (h(8, 20) + 1).alias("packets"), (h(9, 100_000) + 60).alias("bytes"), F.when(out, "outbound").otherwise("inbound").alias("direction"),
    )


def attack(kind: str, spark: SparkSession, start_us: int, n: int, source: str = "10.10.0.66") -> DataFrame:
    """n events of a labelled attack: scan, sweep, beacon, exfil, flood or reflection."""
    i = C("id")
    at, port, dst, src, sport, proto, size, step, way = i * 0, F.lit(443), F.lit("203.0.113.9"), F.lit(source), F.lit(50_000), F.lit("TCP"), F.lit(60), 10_000, "outbound"
    if kind == "scan":
        port = 1 + i
    elif kind == "sweep":
        dst = F.concat(F.lit("10.10.7."), i % 250 + 1)
    elif kind == "beacon":
        step = 10_000_000
    elif kind == "exfil":
        size = F.lit(200_000)
    elif kind == "flood":
        src, dst, step, way = F.concat(F.lit("93.184."), i % 200, F.lit("."), F.floor(i / 200) % 250 + 1), F.lit("10.10.0.5"), 150, "inbound"
    elif kind == "reflection":
        src, dst, sport, port, proto, step, way = F.concat(F.lit("93.184.216."), i % 80 + 1), F.lit("10.10.0.9"), F.lit(123), F.lit(40_000), F.lit("UDP"), 160, "inbound"
    else:
        raise ValueError(kind)
    t = F.lit(start_us) + i * step + at
    return spark.range(n).select(
        i.alias("event_seq"), t.alias("t_us"), src.alias("src_ip"), dst.alias("dst_ip"), sport.cast("int").alias("src_port"), port.cast("int").alias("dst_port"), proto.alias("protocol"), F.when(proto == "TCP", 2).alias("tcp_flags"), F.lit(1).cast("long").alias("packets"), size.cast("long").alias("bytes"), F.lit(way).alias("direction"),
    )


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """detector, a, b from a JSON file of each detector's logistic parameters, for joins.with_confidence; detectors without both are left out."""
    d = spark.read.schema("detectors map<string,struct<a: double, b: double>>").option("multiLine", True).json(path)
    return d.select(F.explode("detectors").alias("detector", "p")).select("detector", "p.a", "p.b").where("a is not null and b is not null")
