import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import chain, lifecycle
from tidewatch.plans import replay
from tidewatch.plans.catalog import QUERIES
from tidewatch.schema import ALERT
from tidewatch.sources.tables import attack, synthetic_flows

T0 = 1_773_280_000_000_000


def test_attacks_become_signed_incidents(spark):
    parts = [("scan", 200), ("beacon", 12), ("exfil", 10), ("flood", 20_000), ("reflection", 18_000)]
    e = [attack(kind, spark, T0 + k * 400_000_000, n, f"10.10.0.{60 + k}").withColumn("event_seq", F.col("event_seq") + k * 100_000) for k, (kind, n) in enumerate(parts)]
    e = reduce(DataFrame.unionByName, e)
    found = replay.alerts(e).cache()
    kinds = {(r.detector, r.threat_class) for r in found.collect()}
    assert {("scan", "port_scan"), ("c2", "c2_beacon"), ("exfil", "data_exfil"), ("reflection", "udp_reflection"), ("ddos", "syn_flood")} <= kinds
    assert all(len(r.incident_id) == 16 and 0 <= r.confidence <= 1 and r.calibrated_on == "uncalibrated" for r in found.collect())
    ledger = replay.signed(found).cache()
    assert ledger.count() == found.count()
    assert chain.verified(ledger.withColumn("index", F.col("seq") - 1)).first().valid
    i = lifecycle.incidents(ledger)
    assert i.count() == found.select("incident_id").distinct().count()


def test_quiet_traffic_raises_no_scan_beacon_or_flood(spark):
    r = replay.alerts(synthetic_flows(spark, 20_000, rate=20)).groupBy("detector").count().collect()
    assert {x.detector for x in r} <= {"exfil", "c2"}


def test_alerts_follow_the_contract(spark):
    found = replay.alerts(attack("scan", spark, T0, 200, "10.10.0.60"))
    r = replay.reported(found)
    assert [(f.name, f.dataType) for f in r.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], ALERT).schema]
    one = r.where("detector = 'scan'").first()
    assert (one.schema_version, one.flow_ref_type, one.status, one.flow_id) == ("1.3", "entity", "NEW", hashlib.sha256(b"10.10.0.60").hexdigest()[:16])
    assert json.loads(one.evidence)["unique_port_count"] >= 100
    told = json.loads(one.evidence)["interpretation"]
    assert told.endswith("ports were tried") and "None" not in told


def test_evidence_has_the_names_of_the_contract(spark):
    flow = attack("flood", spark, T0, 20_000).unionByName(attack("reflection", spark, T0 + 400_000_000, 18_000).withColumn("event_seq", F.col("event_seq") + 100_000))
    slow = spark.createDataFrame([("10.10.0.9", 80, T0, 400.0, 300, 4)] * 20, "dst_ip string, dst_port int, w_us long, duration_s double, bytes long, packets long")
    found = replay.alerts(flow, flows=slow).collect()
    by = {r.threat_class: json.loads(r.evidence_json) for r in found}
    assert by["slowloris"]["half_open_concurrency"] == 20 and by["slowloris"]["connection_duration_p95"] == 400.0 and by["slowloris"]["interpretation"] == "20 slow connections are held open on 10.10.0.9"
    assert {"packet_rate_pps", "source_entropy", "syn_count", "target_ip", "top_flow_packet_share", "interpretation"} <= by["syn_flood"].keys()
    assert {"fan_in", "bit_rate_bps", "mean_packet_bytes", "unsolicited_share"} <= by["udp_reflection"].keys() and by["udp_reflection"]["target_ip"] is not None


def test_the_replay_reads_its_views_and_alerts_as_written_tables(spark):
    """The detectors' plans are run once: what is keyed, scored and signed is read from the scratch folder, not from the events."""
    files = QUERIES["replay_alerts"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/alerts-" in f for f in files)
