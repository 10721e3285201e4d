"""The event and alert rows."""

from __future__ import annotations

from .config import CAPABILITY_FIELDS

_CAPABILITY = "struct<" + ", ".join(f"{c}: string" for c in CAPABILITY_FIELDS) + ">"

#: One normalized event. event_seq is the order of arrival and breaks ties of t_us (microseconds, UTC). What an input didn't carry is null, never zero.
EVENT = f"""
event_seq long, ts timestamp, t_us long, display_ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, ip_version int,
tcp_flags int, tcp_flags_str string, packets long, bytes long, direction string, flow_id string, flow_ref_type string,
flow_summary struct<src_ip: string, dst_ip: string, src_port: int, dst_port: int, duration_s: double, packets: long, bytes: long, fwd_packets: long, rev_packets: long, fwd_bytes: long, rev_bytes: long, state: string, bytes_toserver: long, bytes_toclient: long, pkts_toserver: long, pkts_toclient: long>,
dns struct<qname: string, qtype: string, rcode: string, nxdomain: boolean, response_seen: boolean, registered_domain: string>,
tls struct<sni: string, ja3: string, ja3s: string, ja4: string, version: string>, quic struct<version: string, ja3: string, ja4: string>,
shape struct<packet_size_first_n: array<int>, direction_first_n: array<string>, iat_median: double, iat_p95: double, iat_cv: double, upstream_packet_ratio: double, downstream_packet_ratio: double>,
input_mode string, capture_source string,
sensor_loss struct<kernel_drops: long, ring_drops: long, sensor_drop_pct: double, estimator: string, is_lower_bound: boolean>,
exporter struct<exporter_id: string, template_id: int, observation_time: double, sampling_rate: long, sampled: boolean>,
capability {_CAPABILITY}
"""

#: One alert; evidence is JSON. An incident is the same row with seq and the chain's hashes.
ALERT = """
schema_version string, event_seq long, t_us long, detector string, ps_class string, threat_class string, incident_id string, dedup_key string, flow_id string, flow_ref_type string,
score double, score_type string, confidence double, calibrated_on string, calibrated boolean, severity string, status string,
first_us long, last_us long, event_count long, evidence string
"""

# The frozen order of the feature vector.
FEATURE_ORDER = (
    "length", "entropy", "digit_ratio", "vowel_ratio", "label_count", "lm_bigram", "lm_trigram", "nxdomain_rate", "qtype_txt_ratio", "qtype_null_ratio",
    "qtype_cname_ratio", "qtype_entropy", "packet_size_first_n", "packet_size_mean", "packet_size_p95", "iat_median", "iat_p95", "iat_cv", "upstream_packet_ratio", "downstream_packet_ratio",
)
