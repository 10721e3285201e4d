"""What each detector looks at. Null directions are told apart on purpose: they pass for beaconing, count as outbound for exfiltration and as inbound for reflection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AddressPlan, C2Config, TlsConfig

C = F.col


def _not(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def scan_input(df: DataFrame, plan: AddressPlan = AddressPlan()) -> DataFrame:
    """Without service replies and without declared resolvers' own queries."""
    service = (C("src_port") < 1024) | C("src_port").isin(*plan.amplifier_ports)
    reply = C("src_port").isNotNull() & C("dst_port").isNotNull() & service & (C("dst_port") >= 1024) & (C("src_port") != C("dst_port"))
    resolver = C("src_ip").isin(*plan.resolvers) & (C("dst_port") == 53)
    return df.where(C("src_ip").isNotNull() & _not(reply) & _not(resolver))


def c2_input(df: DataFrame, cfg: C2Config = C2Config()) -> DataFrame:
    exempt = reduce(lambda a, b: a | b, [(C("protocol") == p) & (C("dst_port") == n) for p, n in cfg.exempt], F.lit(False))
    whole = C("src_ip").isNotNull() & C("dst_ip").isNotNull() & C("dst_port").isNotNull()
    return df.where(whole & _not(exempt) & _not(C("bytes") >= cfg.max_bytes) & _not(C("direction") == "inbound"))


def dns_input(df: DataFrame) -> DataFrame:
    return df.where(C("qname").isNotNull() & (C("qname") != "") & C("src_ip").isNotNull())


def exfil_input(df: DataFrame) -> DataFrame:
    return df.where(C("src_ip").isNotNull() & C("dst_ip").isNotNull() & (C("direction").isNull() | C("direction").isin("outbound", "external", "inbound")))


def _udp(df: DataFrame) -> DataFrame:
    return df.where((F.upper("protocol") == "UDP") & C("src_ip").isNotNull() & C("dst_ip").isNotNull())


def reflection_responses(df: DataFrame, plan: AddressPlan = AddressPlan()) -> DataFrame:
    out = _udp(df).where((C("direction").isNull() | (C("direction") == "inbound")) & C("src_port").isin(*plan.amplifier_ports))
    if "flow_summary" in df.columns:  # a two-way record whose client is the victim was asked for
        two_way = C("flow_summary.bytes_toserver").isNotNull() | C("flow_summary.bytes_toclient").isNotNull()
        out = out.where(_not(two_way & C("dst_port").isin(*plan.amplifier_ports)))
    return out


def reflection_requests(df: DataFrame, plan: AddressPlan = AddressPlan()) -> DataFrame:
    return _udp(df).where(C("direction").isNotNull() & (C("direction") != "inbound") & C("dst_port").isin(*plan.amplifier_ports))


def tls_input(df: DataFrame, cfg: TlsConfig = TlsConfig()) -> DataFrame:
    """Without replies of services that carry no handshake; with a handshake or a usual port."""
    shown = reduce(lambda a, b: a | b, [C(n).isNotNull() for n in ("ja3", "ja4", "sni") if n in df.columns], F.lit(False))
    reply = (C("src_port") < 1024) & (C("dst_port") >= 1024) & ~shown
    return df.where(C("src_ip").isNotNull() & C("dst_ip").isNotNull() & C("dst_port").isNotNull() & _not(reply) & (shown | C("dst_port").isin(*cfg.ports)))
