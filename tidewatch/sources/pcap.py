"""Classic packet captures. A small helper cuts files into records, which can only be done from the front; everything after that is expressions over the records' bytes, so packets of one large file are spread over the cluster."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import AddressPlan
from ..operators.enrich import normalised

C = F.col
MAX_RECORD = 16 << 20
# Magic numbers as stored, with byte order and fractions of a second.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
PCAPNG = b"\x0a\x0d\x0d\x0a"
# Link types.
ETHERNET, NULL, RAW, SLL, IPV4, IPV6 = 1, 0, 101, 113, 228, 229
RECORD = "path string, linktype int, index long, t_us long, caplen long, wirelen long, data binary, fault string"


def records(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of RECORD. What can't be read is a row with a fault: a bad header or a broken record ends the file, a record longer than its packet is passed over."""
    order = MAGICS.get(content[:4])
    if order is None or len(content) < 24:
        yield path, None, None, None, None, None, None, "pcapng" if content[:4] == PCAPNG else "header"
        return
    end, fraction = order
    linktype = struct.unpack_from(end + "I", content, 20)[0] & 0x0FFFFFFF
    at, index, head = 24, 0, struct.Struct(end + "IIII")
    while at < len(content):
        if at + 16 > len(content):
            yield path, linktype, None, None, None, None, None, "record_header"
            return
        seconds, part, caplen, wirelen = head.unpack_from(content, at)
        at += 16
        if caplen > MAX_RECORD or at + caplen > len(content):
            yield path, linktype, None, None, None, None, None, "record"
            return
        data = content[at : at + caplen]
        at += caplen
        fault = "length" if caplen > wirelen else None
        yield path, linktype, None if fault else index, seconds * 1_000_000 + part * 1_000_000 // fraction, caplen, wirelen, data, fault
        index += fault is None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all captures at a path that Spark can read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0), b.column(1), strict=True):
                held: list[tuple] = []
                for r in records(p.as_py(), content.as_py()):
                    held.append(r)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, RECORD)


def first_timestamp(recs: DataFrame) -> DataFrame:
    """path and the time of its first record, in the file's order."""
    return recs.where("fault is null").groupBy("path").agg(F.min_by("t_us", "index").alias("t_us"))


def number(at: Column | int, n: int, data: Column | None = None) -> Column:
    """A big-endian number of n bytes at a place; null past the end."""
    data = C("data") if data is None else data
    at = at if isinstance(at, Column) else F.lit(at)
    piece = F.substr(data, at + 1, F.lit(n))
    return F.when(F.length(piece) == n, F.conv(F.hex(piece), 16, 10).cast("long"))


@F.pandas_udf(StringType())
def ipv6_text(h: pd.Series) -> pd.Series:
    return h.map(lambda x: str(ipaddress.IPv6Address(bytes.fromhex(x))) if len(x) == 32 else None, na_action="ignore")


def _ipv4_text(at: Column) -> Column:
    return F.concat_ws(".", *[number(at + k, 1) for k in range(4)])


# VLAN tags; IPv6 headers before the transport header, and those of them counted in 4 bytes.
VLAN = [0x8100, 0x88A8, 0x9100]
EXTENSIONS, FRAGMENT, AUTHENTICATION, NO_NEXT = [0, 43, 44, 51, 60, 135], 44, 51, 59


def headers(recs: DataFrame) -> DataFrame:
    """recs with ip_version, src_ip, dst_ip, protocol, src_port, dst_port, tcp_flags, fragmented, transport_truncated, vlans and reason, why a packet can't be read (null if it can).

    Only bytes of headers are looked at. Later fragments have no ports, ICMP has none, and a cut transport header is flagged, not guessed.
    """
    link = C("linktype")
    low = F.least(number(0, 4), number(3, 1) * 16_777_216 + number(2, 1) * 65_536 + number(1, 1) * 256 + number(0, 1))
    ether = F.when(link == ETHERNET, number(12, 2)).when(link == SLL, number(14, 2)).when(link == NULL, F.when(low == 2, 0x0800).when(low.isin(10, 23, 24, 28, 30), 0x86DD))
    start = F.when(link == ETHERNET, 14).when(link == SLL, 16).when(link == NULL, 4).when(link.isin(RAW, IPV4, IPV6), 0)
    df = recs.withColumn("_l", F.struct(start.cast("long").alias("at"), ether.cast("long").alias("type"), F.lit(0).alias("vlans")))

    def untag(s: Column, _: Column) -> Column:
        tagged = s["type"].isin(*VLAN)
        return F.when(tagged, F.struct((s["at"] + 4).alias("at"), number(s["at"] + 2, 2).alias("type"), (s["vlans"] + 1).alias("vlans"))).otherwise(s)

    df = df.withColumn("_l", F.aggregate(F.sequence(F.lit(1), F.lit(5)), C("_l"), untag)).withColumns({"_at": C("_l.at"), "_type": C("_l.type"), "vlans": C("_l.vlans")})
    raw = F.when(link == IPV4, 4).when(link == IPV6, 6).when(link == RAW, F.floor(number(C("_at"), 1) / 16))
    df = df.withColumn("ip_version", F.coalesce(raw, F.when(C("_type") == 0x0800, 4).when(C("_type") == 0x86DD, 6)).cast("int"))
    ihl = number(C("_at"), 1) % 16 * 4
    size = F.length("data")
    bad = (
        F.when(start.isNull(), "linktype").when(size < start, "link").when(C("vlans") > 4, "vlan_nesting").when(~link.isin(RAW, IPV4, IPV6) & C("_type").isNull(), "link").when(C("ip_version").isNull(), "not_ip")
        .when(~C("ip_version").isin(4, 6), "ip_version").when((C("ip_version") == 4) & (size < C("_at") + 20), "ipv4").when((C("ip_version") == 6) & (size < C("_at") + 40), "ipv6").when((C("ip_version") == 4) & (ihl < 20), "ihl")
    )
    df = df.withColumns({"reason": F.coalesce("fault", bad), "_ihl": ihl})
    good, v4 = C("reason").isNull(), C("ip_version") == 4

    def skip(s: Column, _: Column) -> Column:
        more = s["next"].isin(*EXTENSIONS) & s["open"]
        units = number(s["at"] + 1, 1)
        length = F.when(s["next"] == FRAGMENT, 8).when(s["next"] == AUTHENTICATION, (units + 2) * 4).otherwise((units + 1) * 8)
        return F.when(more & units.isNotNull(), F.struct((s["at"] + length).alias("at"), number(s["at"], 1).alias("next"), s["open"].alias("open"))).otherwise(F.struct(s["at"].alias("at"), s["next"].alias("next"), F.lit(False).alias("open")))

    v6 = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.struct((C("_at") + 40).alias("at"), number(C("_at") + 6, 1).alias("next"), F.lit(True).alias("open")), skip)
    df = df.withColumn("_v6", F.when(good & ~v4, v6))
    proto = F.when(v4, number(C("_at") + 9, 1)).when(C("_v6.next") != NO_NEXT, C("_v6.next"))
    bits = number(C("_at") + 6, 2)
    df = df.withColumns({
        "protocol": F.when(good, proto), "_t": F.when(v4, C("_at") + C("_ihl")).otherwise(C("_v6.at")), "fragmented": F.when(good & v4, bits % 16_384 > 0).when(good, False), "_later": F.coalesce(v4 & (bits % 8192 > 0), F.lit(False)),
        "src_ip": F.when(good & v4, _ipv4_text(C("_at") + 12)).when(good, ipv6_text(F.when(~v4, F.hex(F.substr("data", C("_at") + 9, F.lit(16)))))), "dst_ip": F.when(good & v4, _ipv4_text(C("_at") + 16)).when(good, ipv6_text(F.when(~v4, F.hex(F.substr("data", C("_at") + 25, F.lit(16)))))),
    })
    need = F.when(C("protocol") == 6, 20).when(C("protocol") == 17, 8)
    cut = F.coalesce(~C("_later") & (size < C("_t") + need), F.lit(False))
    ported = good & ~C("_later") & ~cut & need.isNotNull()
    df = df.withColumns({"transport_truncated": cut, "src_port": F.when(ported, number(C("_t"), 2)).cast("int"), "dst_port": F.when(ported, number(C("_t") + 2, 2)).cast("int"), "tcp_flags": F.when(ported & (C("protocol") == 6), number(C("_t") + 13, 1)).cast("int")})
    return df.drop("_l", "_at", "_type", "_ihl", "_v6", "_t", "_later")


def events(spark: SparkSession, path: str, plan: AddressPlan = AddressPlan()) -> DataFrame:
    """Normalized events of all readable packets, one for each, in the file's order."""
    return events_of(read_records(spark, path), plan)


def events_of(recs: DataFrame, plan: AddressPlan = AddressPlan()) -> DataFrame:
    """The same of records that have been read, whole or by ranges (capture.read_captures)."""
    h = headers(recs).where("reason is null")
    e = h.select(C("index").alias("event_seq"), "t_us", "src_ip", "dst_ip", "src_port", "dst_port", C("protocol").cast("string").alias("protocol"), "ip_version", "tcp_flags", F.lit(1).cast("long").alias("packets"), C("wirelen").alias("bytes"), F.lit("pcap_replay").alias("input_mode"), C("path").alias("capture_source"), "fragmented", "transport_truncated")
    return normalised(e, plan)


def reasons(heads: DataFrame) -> DataFrame:
    """path, reason, n of records that were not read, or that were (reason null)."""
    return heads.groupBy("path", "reason").agg(F.count(F.lit(1)).alias("n"))
