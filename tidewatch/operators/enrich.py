"""Columns that are derived from an event alone, and capability that a stream of events shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AddressPlan
from ..functions import alerts, network, scalars

C = F.col


def normalised(df: DataFrame, plan: AddressPlan = AddressPlan()) -> DataFrame:
    """Protocol name, flag letters, direction and the conversation's id from the raw columns."""
    p = scalars.protocol_name(C("protocol"))
    return df.withColumns({
        "protocol": p, "tcp_flags_str": scalars.tcp_flag_letters(C("tcp_flags")), "direction": network.direction(C("src_ip"), C("dst_ip"), plan),
        "flow_id": scalars.flow_id(C("src_ip"), C("dst_ip"), C("src_port"), C("dst_port"), C("protocol")), "flow_ref_type": F.lit("flow_5tuple"),
    })


def directional_bytes() -> dict[str, Column]:
    """out_b, in_b, out_p, in_p as the internal host sees them. A two-way record has both sides, swapped when its client is external; anything else has its own bytes on one side. A missing packet count is one packet."""
    inbound = F.coalesce(C("direction") == "inbound", F.lit(False))
    two_way = C("flow_summary.bytes_toserver").isNotNull() | C("flow_summary.bytes_toclient").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")

    def one(to_server: str, to_client: str, own: Column, out: bool) -> Column:
        a, b = zero(C(f"flow_summary.{to_server}")), zero(C(f"flow_summary.{to_client}"))
        first, second = (a, b) if out else (b, a)
        return F.when(two_way, F.when(inbound, second).otherwise(first)).when(inbound if out else ~inbound, F.lit(0).cast("long")).otherwise(own)

    bytes_, packets = zero(C("bytes")), F.coalesce(C("packets"), F.lit(1)).cast("long")
    return {"out_b": one("bytes_toserver", "bytes_toclient", bytes_, True), "in_b": one("bytes_toserver", "bytes_toclient", bytes_, False), "out_p": one("pkts_toserver", "pkts_toclient", packets, True), "in_p": one("pkts_toserver", "pkts_toclient", packets, False)}


def raised_capability(events: DataFrame, mode: str) -> DataFrame:
    """One row of the 14 fields: an input mode's baseline, raised where an event carries the field. Never lowered."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    text = lambda c: C(c).isNotNull() & (C(c) != "")
    seen = {
        "dns_names": text("dns.qname"), "dns_responses": C("dns.rcode").isNotNull() | C("dns.nxdomain").isNotNull(), "tls_handshake": C("tls").isNotNull(), "quic_metadata": C("quic").isNotNull(),
        "ja3": text("tls.ja3") | text("quic.ja3"), "ja3s": text("tls.ja3s"), "ja4": text("tls.ja4") | text("quic.ja4"),
    }
    shown = events.agg(*[some(c).alias(n) for n, c in seen.items()]).select(*[C(n).alias(f"seen_{n}") for n in seen], alerts.capability_baseline(F.lit(mode)).alias("c"))
    fields = [F.when(C(f"seen_{n}"), "OBSERVABLE").otherwise(C(f"c.{n}")).alias(n) if n in seen else C(f"c.{n}").alias(n) for n in shown.schema["c"].dataType.names]
    return shown.select(*fields)
