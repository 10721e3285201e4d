"""Address membership as predicates on literals: a plan has few prefixes, so no join is needed."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import GLOBAL_V4, RESERVED_V4, AddressPlan


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(_IPV4)


def ipv4_number(ip: Column) -> Column:
    """The address as a long; null if it is no dotted IPv4 address."""
    return F.when(is_ipv4(ip), F.aggregate(F.split(ip, "[.]"), F.expr("0L"), lambda s, o: s * 256 + o.cast("long")))


@F.pandas_udf(StringType())
def ipv6_hex(ip: pd.Series) -> pd.Series:
    """32 hex digits of an IPv6 address: its texts have too many forms for an expression."""

    def one(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        return f"{int(a):032x}" if a.version == 6 else None

    return ip.map(one, na_action="ignore")


def span(prefix: str) -> tuple[int, int, int]:
    """(version, first, last) of a prefix."""
    n = ipaddress.ip_network(prefix, strict=False)
    return n.version, int(n.network_address), int(n.broadcast_address)


def inside_v4(ip: Column, prefixes) -> Column:
    """Is a readable IPv4 address in any of the prefixes. Whole-octet prefixes are tests of the text's start, which keep the plan small; others are ranges of its number."""
    tests = []
    for p in prefixes:
        n = ipaddress.ip_network(p, strict=False)
        if n.version == 4 and n.prefixlen % 8 == 0 and n.prefixlen:
            octets = str(n.network_address).split(".")[: n.prefixlen // 8]
            tests.append(ip.startswith(".".join(octets) + ".") if len(octets) < 4 else ip == ".".join(octets))
        elif n.version == 4:
            tests.append(ipv4_number(ip).between(int(n.network_address), int(n.broadcast_address)))
    return reduce(or_, tests, F.lit(False))


def member(ip: Column, prefixes) -> Column:
    """Is an address in any of the prefixes; null if it is missing or unreadable."""
    v6 = [(a, b) for v, a, b in map(span, prefixes) if v == 6]
    out = F.when(is_ipv4(ip), inside_v4(ip, prefixes))
    if not v6:
        return out.when(ip.contains(":"), F.lit(False))
    h = ipv6_hex(F.when(ip.contains(":"), ip))
    return out.when(h.isNotNull(), reduce(or_, [h.between(f"{a:032x}", f"{b:032x}") for a, b in v6]))


def direction(src: Column, dst: Column, plan: AddressPlan) -> Column:
    """By the monitored prefixes alone; null unless both addresses can be read."""
    if all(v == 4 for v, _, _ in map(span, plan.monitored)):
        s, d = inside_v4(src, plan.monitored), inside_v4(dst, plan.monitored)
        readable = src.rlike(f"{_IPV4}|:") & dst.rlike(f"{_IPV4}|:")
    else:
        s, d = member(src, plan.monitored), member(dst, plan.monitored)
        readable = s.isNotNull() & d.isNotNull()
    return F.when(readable, F.when(s & d, "internal").when(s, "outbound").when(d, "inbound").otherwise("external"))


def is_external(ip: Column, plan: AddressPlan) -> Column:
    """Readable and in no declared prefix."""
    return F.coalesce(~member(ip, plan.declared), F.lit(False))


def is_bogon(ip: Column, plan: AddressPlan) -> Column:
    """Reserved source space, unless the plan declares it."""
    reserved = is_ipv4(ip) & inside_v4(ip, [f"{a}/{k}" for a, k in RESERVED_V4]) & ~ip.isin(*GLOBAL_V4)
    if plan.exclude_declared_lab or plan.external_only:
        reserved = reserved & is_external(ip, plan)
    return F.coalesce(reserved, F.lit(False))


def is_amplifier_port(port: Column, plan: AddressPlan) -> Column:
    return F.coalesce(port.isin(*plan.amplifier_ports), F.lit(False))


def ipv6_bucket(ip: Column, bits: int) -> Column:
    """The prefix of an IPv6 address, as its first bits / 4 hex digits; null for IPv4."""
    return F.concat(F.substring(ipv6_hex(F.when(ip.contains(":"), ip)), 1, bits // 4), F.lit(f"/{bits}"))
