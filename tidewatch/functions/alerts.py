"""Severity, confidence, dedup keys and the contract's repairs, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CALIBRATED_ON, CAPABILITY_BASELINE, CAPABILITY_FIELDS, DEDUP_KEYS, DIRECTIONS, ENTITY_DETECTORS, INPUT_MODES, KEY_PART_DETECTORS, NOT_OBSERVABLE, SCORE_TYPES, SEVERITIES
from .scalars import any_of, canonical, identifier, part, rounded, sigmoid


def severity_of(score: Column, score_type: Column) -> Column:
    """MEDIUM without a score."""

    def steps(*least: float) -> Column:
        return reduce(lambda c, x: c.when(score >= x[0], x[1]), zip(least[1:], SEVERITIES[3:0:-1], strict=True), F.when(score >= least[0], SEVERITIES[4])).otherwise(SEVERITIES[0])

    return F.when(score.isNull(), "MEDIUM").when(score_type == "robust_z", steps(12.0, 8.0, 5.0, 3.0)).otherwise(steps(0.9, 0.75, 0.5, 0.25))


def severity_rank(severity: Column) -> Column:
    """0 for an unknown one, like INFO."""
    return F.greatest(F.array_position(any_of(SEVERITIES), severity) - 1, F.lit(0)).cast("int")


def severity_name(rank: Column) -> Column:
    return F.element_at(any_of(SEVERITIES), rank + 1)


def escalate(now: Column, new: Column) -> Column:
    return F.when(severity_rank(new) > severity_rank(now), new).otherwise(now)


def normalized_score(score: Column, score_type: Column, z_reference: Column) -> Column:
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    return F.when(~finite, 0.0).when(score_type == "robust_z", F.greatest(score, F.lit(0.0)) / z_reference).otherwise(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)))


def confidence_of(score: Column, score_type: Column, z_reference: Column, a: Column, b: Column) -> Column:
    """struct(confidence, calibrated_on). a and b are the detector's logistic parameters, null without a calibration."""
    x = normalized_score(score, score_type, z_reference)
    plain = F.when(score_type == "robust_z", 1 - F.exp(-x)).otherwise(F.least(x, F.lit(1.0)))
    fitted = sigmoid(F.greatest(F.least(a * x + b, F.lit(60.0)), F.lit(-60.0)))
    model = (score_type == "model_probability") & score.isNotNull()
    told = lambda value, source: F.struct(F.round(value, 4).alias("confidence"), F.lit(source).alias("calibrated_on"))
    return F.when(model, told(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), "platt_dga")).when(a.isNotNull() & b.isNotNull(), told(fitted, "synthetic_replay")).otherwise(told(plain, "uncalibrated"))


def scored(df, z_reference: float = 6.0):
    """The contract's repairs of score_type, confidence, calibrated_on, calibrated and severity."""
    kind = F.when(F.col("score_type").isin(*SCORE_TYPES), F.col("score_type")).otherwise("anomaly_score")
    df = df.withColumn("score_type", kind)
    good = F.coalesce(F.col("confidence").between(0, 1) & F.col("calibrated_on").isin(*CALIBRATED_ON), F.lit(False))
    null = F.lit(None).cast("double")
    new = confidence_of(F.col("score"), F.col("score_type"), F.lit(z_reference), null, null)
    df = df.withColumn("_c", F.when(good, F.struct("confidence", "calibrated_on")).otherwise(new))
    df = df.withColumns({"confidence": F.col("_c.confidence"), "calibrated_on": F.col("_c.calibrated_on")}).drop("_c")
    severity = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise(severity_of(F.col("score"), F.col("score_type")))
    return df.withColumns({"calibrated": F.col("calibrated_on") != "uncalibrated", "severity": severity})


NUMBERS = {"dst_port", "amplifier_port", "src_port"}


def dedup_key(detector: Column, ps_class: Column, parts: dict[str, Column]) -> Column:
    """The canonical key of a detector's class and parts; an unknown detector has the flood key."""
    missing = F.lit(None).cast("string")
    one = lambda names: canonical([(ps_class, False), *[(parts.get(n, missing), n in NUMBERS) for n in names]])
    return reduce(lambda c, x: c.when(detector == x[0], one(x[1])), DEDUP_KEYS.items(), F.when(F.lit(False), F.lit(None))).otherwise(one(DEDUP_KEYS["ddos"]))


def flow_reference(detector: Column, key: Column, parts: dict[str, Column]) -> dict[str, Column]:
    """flow_id and flow_ref_type of an alert: the host as it is, or the identifier's list of key parts, or the key."""
    missing = F.lit(None).cast("string")
    of_parts = reduce(lambda c, d: c.when(detector == d, canonical([(parts.get(n, missing), n in NUMBERS) for n in DEDUP_KEYS[d]])), KEY_PART_DETECTORS, F.when(F.lit(False), F.lit(None)))
    entity = F.coalesce(detector.isin(*ENTITY_DETECTORS), F.lit(False))
    text = F.when(entity, part(parts.get("src_ip", missing))).otherwise(F.coalesce(of_parts, key))
    return {"flow_id": identifier(text), "flow_ref_type": F.when(entity, "entity").otherwise("aggregate")}


# The names of the contract's evidence by detector, each with the measured column and the decimal places that it is told with.
EVIDENCE = {
    "ddos": {
        "packet_rate_pps": ("pps", 2), "byte_rate_bps": ("bps", 2), "unique_source_count": ("unique_src", None), "source_entropy": ("src_entropy", 4), "syn_count": ("syn", None), "ack_count": ("ack", None), "syn_ack_ratio": ("syn_ack_ratio", 2), "target_ip": ("dst_ip", None), "target_port": ("dst_port", None),
        "top_flow_packet_share": ("top_flow_share", 3), "half_open_concurrency": ("concurrency", None), "connection_duration_p95": ("duration_p95", 2), "bytes_per_connection": ("bytes_per_connection", 2),
    },
    "reflection": {"target_ip": ("dst_ip", None), "amplifier_port": ("amplifier_port", None), "fan_in": ("fan_in", None), "packet_rate_pps": ("pps", 1), "bit_rate_bps": ("bps", 1), "unsolicited_share": ("unsolicited_share", 3)},
    "scan": {"unique_dst_count": ("unique_dst_count", None), "unique_port_count": ("unique_port_count", None), "scan_pattern": ("scan_pattern", None), "packets_sent": ("packets_sent", None), "duration_s": ("duration_s", 2), "sample_targets": ("sample_targets", None), "sample_ports": ("sample_ports", None)},
    "c2": {"event_count": ("event_count", None), "iat_mean": ("iat_mean", 3), "iat_median": ("iat_median", 3), "iat_std": ("iat_std", 3), "iat_cv": ("iat_cv", 4), "iat_mad": ("iat_mad", 3), "duration_s": ("duration_s", 2), "sample_iats": ("sample_iats", None)},
    "dga": {"query_count": ("query_count", None), "avg_score": ("avg_score", 3), "nxdomain_rate": ("nxdomain_rate", 3), "mean_probability": ("model_mean", 4)},
    "dns": {
        "qtype_txt_ratio": ("txt_share", 3), "qtype_null_ratio": ("null_share", 3), "qtype_cname_ratio": ("cname_share", 3), "query_count": ("query_count", None), "avg_length": ("avg_length", 2), "avg_entropy": ("avg_entropy", 3), "qps": ("qps", 2), "registered_domain": ("registered_domain", None),
    },
    "tls_quic": {"ja3": ("ja3", None), "ja4": ("ja4", None), "sni": ("sni", None), "iat_cv": ("iat_cv", 4), "target_ip": ("dst_ip", None), "target_port": ("dst_port", None)},
    "exfil": {
        "outbound_bytes": ("outbound_bytes", None), "inbound_bytes": ("inbound_bytes", None), "outbound_ratio": ("outbound_ratio", 2), "robust_z": ("robust_z", None), "outbound_packets": ("outbound_packets", None), "inbound_packets": ("inbound_packets", None), "duration_s": ("duration_s", 2),
        "source": ("src_ip", None), "destination": ("dst_ip", None), "burst_or_sustained": ("burst_or_sustained", None),
    },
}
#: One sentence an alert, from the contract's evidence names.
INTERPRETATIONS = {
    "ddos": "Flood of %s packets a second on %s", "slowloris": "%s slow connections are held open on %s", "reflection": "%s amplifiers answer at port %s", "scan": "%s hosts and %s ports were tried", "c2": "%s contacts at even gaps, variation %s", "dga": "%s names asked, mean score %s", "dns": "%s queries of mean length %s",
    "tls_quic": "Odd handshake metadata or packet shape toward %s, port %s; no payload was read", "exfil": "%s bytes out, %s times what came in; contents are not looked at",
}
TOLD = {
    "ddos": ("packet_rate_pps", "target_ip"), "slowloris": ("half_open_concurrency", "target_ip"), "reflection": ("fan_in", "amplifier_port"), "scan": ("unique_dst_count", "unique_port_count"), "c2": ("event_count", "iat_cv"), "dga": ("query_count", "avg_score"), "dns": ("query_count", "avg_length"),
    "tls_quic": ("target_ip", "target_port"), "exfil": ("outbound_bytes", "outbound_ratio"),
}


def evidence_of(detector: str, columns: list[str]) -> Column:
    """The struct of a detector's evidence under the contract's names, of what it has measured; null where a row has no value."""
    held = {name: F.col(c) if digits is None else rounded(F.col(c), digits) for name, (c, digits) in EVIDENCE[detector].items() if c in columns}
    if detector == "reflection":
        held["mean_packet_bytes"] = rounded(F.try_divide("bytes", "packets"), 1)
    if detector == "c2":
        held["repeated_destination"] = F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    if detector == "exfil":
        held["direction"] = F.lit("outbound")
    if detector == "dns":
        held["qtype_distribution"] = F.struct(*[held[f"qtype_{k}_ratio"].alias(k.upper()) for k in ("txt", "null", "cname")])
    if detector == "tls_quic":
        held["novel_fingerprint"] = F.col("novel")
    kind = "slowloris" if "concurrency" in columns else detector
    said = F.format_string(INTERPRETATIONS[kind], *[F.coalesce(held[n].cast("string"), F.lit("an unknown")) for n in TOLD[kind]])
    return F.struct(said.alias("interpretation"), *[c.alias(n) for n, c in held.items()])


def alert_ips(json: Column) -> Column:
    """Distinct IPv4 addresses in a text but the two public resolvers, in order of first sight."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(json, F.lit(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), F.lit(0))), any_of(["1.1.1.1", "8.8.8.8"]))


def capability_baseline(mode: Column) -> Column:
    """struct of the 14 fields' states that an input mode starts with."""
    fields = []
    for f in CAPABILITY_FIELDS:
        state = reduce(lambda c, x, f=f: c.when(mode == x[0], x[1][f]), CAPABILITY_BASELINE.items(), F.when(F.lit(False), F.lit(None)))
        fields.append(state.otherwise(NOT_OBSERVABLE).alias(f))
    return F.struct(*fields)


def degraded(state: Column) -> Column:
    """DEGRADED, unless it wasn't observable at all."""
    return F.when(state == NOT_OBSERVABLE, state).otherwise("DEGRADED")


def event_errors(df_columns: set[str] | None = None) -> Column:
    """Names of the contract's rules that an event breaks."""
    rules = {
        "time": F.col("t_us").isNull(), "input_mode": F.coalesce(~F.col("input_mode").isin(*INPUT_MODES), F.lit(True)), "direction": F.col("direction").isNotNull() & ~F.col("direction").isin(*DIRECTIONS),
        "src_port": ~F.col("src_port").between(0, 65_535), "dst_port": ~F.col("dst_port").between(0, 65_535), "packets": F.col("packets") < 0, "bytes": F.col("bytes") < 0,
        "ip_version": ~F.col("ip_version").isin(4, 6), "flow_id": ~F.col("flow_id").rlike("^[0-9a-f]{16}$"),
    }
    chosen = {k: v for k, v in rules.items() if df_columns is None or {"time": "t_us"}.get(k, k) in df_columns}
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in chosen.items()]))


def matches_filters(severity: str | None, ps_class: str | None, status: str | None, text: str | None) -> Column:
    """The list view's filters; an empty one passes all rows."""
    out = F.lit(True)
    for name, want in (("severity", severity), ("ps_class", ps_class), ("status", status)):
        if want:
            out = out & (F.col(name) == want)
    if text:
        fields = ("incident_id", "ps_class", "threat_class", "detector", "flow_id", "dedup_key", "evidence")
        out = out & reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(f)).contains(text.lower()), F.lit(False)) for f in fields])
    return out


def score_text(score: Column, score_type: Column) -> Column:
    """N/A, >99 for large z, else one decimal for z and two for the others."""
    z = F.when(score > 99, ">99").otherwise(F.format_string("%.1f", score))
    return F.when(score.isNull(), "N/A").when(score_type == "robust_z", z).otherwise(F.format_string("%.2f", score))


def confidence_text(confidence: Column, calibrated: Column) -> Column:
    """A percentage only if it is calibrated."""
    return F.when(confidence.isNull(), "N/A").when(calibrated, F.concat(F.round(confidence * 100).cast("int").cast("string"), F.lit("%"))).otherwise(F.format_string("%.2f", confidence))


def reconciled(shown: Column, total: Column, cap: int) -> Column:
    """Does what is shown agree with what the store holds."""
    return F.when(shown.isNull() | total.isNull(), "unknown").when(shown == total, "match").when((shown == cap) & (total > cap), "capped").otherwise("mismatch")
