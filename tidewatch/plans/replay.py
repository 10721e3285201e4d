"""The main query end to end: events through all detectors to alerts, and alerts to scored, signed incidents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..config import Settings
from ..functions import alerts as fn
from ..functions import scalars
from ..operators import aggregates, chain, detectors, flood, lifecycle

C = F.col
KEYS = {"src_ip": "string", "dst_ip": "string", "dst_port": "int", "amplifier_port": "int", "registered_domain": "string", "ja3": "string"}
CORE = ["detector", "threat_class", "score", "score_type", "severity", "t_us", "event_seq", "first_us"]


def as_alerts(found: DataFrame, detector: str) -> DataFrame:
    """A detector's rows in the common form: its measured values become the evidence, as JSON under the contract's names."""
    keys = [C(k).cast(t).alias(k) if k in found.columns else F.lit(None).cast(t).alias(k) for k, t in KEYS.items()]
    count = F.coalesce(*[C(c).cast("long") for c in ("event_count", "packets_sent", "query_count", "concurrency", "packets") if c in found.columns], F.lit(1))
    status = C("status") if "status" in found.columns else F.lit("NEW")
    return found.select(*CORE, *keys, status.alias("status"), count.alias("event_count"), F.to_json(fn.evidence_of(detector, found.columns)).alias("evidence_json"))


def alerts(events: DataFrame, dns: DataFrame | None = None, tls: DataFrame | None = None, settings: Settings = Settings(), windows_s: float | None = None, second_us: int = 1_000_000, flows: DataFrame | None = None) -> DataFrame:
    """Alerts of all detectors, scored, with their dedup keys and identifiers; of slow connections too, if there are flow summaries. events is read by five detectors, so cache or write it if its plan is costly. The detectors run at the call: what they find is written to the scratch folder."""
    width = windows_s or settings.window.width_s
    if "tcp_flags_str" not in events.columns:
        events = events.withColumn("tcp_flags_str", scalars.tcp_flag_letters(C("tcp_flags")))
    found = {
        "scan": detectors.scan(events, settings.scan, settings.plan), "c2": detectors.c2(events, settings.c2), "exfil": detectors.exfil(events, settings.exfil), "reflection": detectors.reflection(events, settings.reflection, settings.plan, second_us),
        "ddos": flood.alerts(aggregates.windows(events, width, settings.plan), settings.ddos),
    }
    if dns is not None:
        found |= {"dga": detectors.dga(dns, settings.dga), "dns": detectors.dns_tunnel(dns, settings.dns)}
    if tls is not None:
        found["tls_quic"] = detectors.tls_quic(tls, settings.tls)
    every = [as_alerts(rows, detector) for detector, rows in found.items()]
    if flows is not None:
        every.append(as_alerts(detectors.slowloris(flows, settings.slowloris), "ddos"))
    # Written here: the keys and scores would else be worked out inside each detector's plan, with its evidence anew at each mention.
    every = lifecycle.keyed(scratch.written(reduce(DataFrame.unionByName, every), "alerts"))
    null = F.lit(None)
    return fn.scored(every.withColumns({"confidence": null.cast("double"), "calibrated_on": null.cast("string")}), settings.ddos.min_z)


def reported(all_alerts: DataFrame) -> DataFrame:
    """The alerts as rows of the contract, schema.ALERT."""
    return lifecycle.contract(all_alerts.withColumn("last_us", C("t_us")))


def signed(all_alerts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The ledger: every alert as an update of its incident, in order, chained."""
    a = all_alerts.withColumns({"evidence": F.from_json("evidence_json", "map<string,string>"), "last_us": C("t_us")})

    def hashed(found: DataFrame) -> DataFrame:
        u = lifecycle.updates(found, settings.lifecycle).withColumn("last_observed", scalars.iso8601(C("last_observed_us")))
        u = u.withColumn("payload_hash", chain.struct_hash(["incident_id", "dedup_key", "detector", "status", "severity", "score", "event_count", "last_observed", "evidence_json"]))
        return u.withColumn("order", F.struct("t_us", "event_seq", "detector", "incident_id"))

    # The chain has each alert's own evidence, so it needs no merged one.
    sealed = chain.sealed(hashed(a.drop("evidence")).select("order", "incident_id", "last_observed", "payload_hash"))
    return hashed(a).join(sealed, ["incident_id", "last_observed", "payload_hash"])
