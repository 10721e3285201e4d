"""NetFlow v9 and IPFIX files. A small helper cuts datagrams into template and data sets; which template a data set has is an as-of join, and records are decoded by expressions."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AddressPlan
from ..operators.enrich import normalised
from ..operators.joins import latest_template
from .capture import Bytes
from .pcap import ipv6_text, number

C = F.col
# Field types.
BYTES, PACKETS, PROTOCOL, FLAGS, SRC_PORT, SRC4, DST_PORT, DST4, LAST, SRC6, DST6, SAMPLING, VERSION = 1, 2, 4, 6, 7, 8, 11, 12, 21, 27, 28, 34, 60
END_SECONDS, END_MILLIS, PACKET_SAMPLING = 151, 153, 305
MAX_FIELDS, VARIABLE = 256, 0xFFFF
SET = "path string, exporter string, domain long, event_seq long, mode string, export_s long, uptime_ms long, set_id int, fields array<struct<type: int, len: int>>, body binary, fault string"


def templates(body: bytes) -> Iterator[tuple[int, list[dict]] | None]:
    """(template id, fields) of a template set; None for what is malformed, which ends the set. Vendors' fields keep their length and have type 0."""
    at = 0
    while at + 4 <= len(body):
        own, count = struct.unpack_from("!HH", body, at)
        at += 4
        fields = []
        if not 0 < count <= MAX_FIELDS:
            yield None
            return
        for _ in range(count):
            if at + 4 > len(body):
                yield None
                return
            kind, size = struct.unpack_from("!HH", body, at)
            at += 4 + 4 * (kind >> 15)
            if at > len(body):
                yield None
                return
            fields.append({"type": 0 if kind >> 15 else kind, "len": size})
        yield own, fields


def sets(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of SET of a file that is held whole."""
    return sets_in(path, Bytes(io.BytesIO(content), len(content)))


def sets_in(path: str, window: Bytes) -> Iterator[tuple]:
    """Rows of SET of a file that is read by blocks. A v9 datagram has no length and takes the rest of the file; an IPFIX message has its own."""
    at, seq, end = 0, 0, window.size
    while at + 2 <= end:
        version = struct.unpack("!H", window.at(at, 2))[0]
        size = {9: 20, 10: 16}.get(version)
        if size is None or at + size > end:
            yield path, path, None, seq, None, None, None, None, None, None, "datagram"
            return
        if version == 9:
            _, _, uptime, export, _, domain = struct.unpack("!HHIIII", window.at(at, 20))
            limit, mode = end, "netflow_v9"
        else:
            _, length, export, _, domain = struct.unpack("!HHIII", window.at(at, 16))
            limit, mode, uptime = at + length, "ipfix", None
            if length < size or limit > end:
                yield path, path, None, seq, None, None, None, None, None, None, "datagram"
                return
        row = lambda set_id, fields, body, fault=None: (path, path, domain, seq, mode, export, uptime, set_id, fields, body, fault)  # noqa: B023, E731
        at += size
        while at + 4 <= limit:
            set_id, length = struct.unpack("!HH", window.at(at, 4))
            if length < 4 or at + length > limit:
                yield row(set_id, None, None, "set")
                break
            body = window.at(at + 4, length - 4)
            if set_id in (0, 2):
                for t in templates(body):
                    yield row(t[0], t[1], None) if t else row(set_id, None, None, "template")
                    seq += 1
            elif set_id in (1, 3):
                yield row(set_id, None, None, "options")
            else:
                yield row(set_id, None, body if set_id >= 256 else None, None if set_id >= 256 else "set_id")
            seq += 1
            at += length
        at = limit


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """Sets of all files at a path that Spark can read; each file is one exporter."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    field = pa.list_(pa.struct([("type", pa.int32()), ("len", pa.int32())]))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), field, pa.binary(), pa.string()]
    names = ["path", "exporter", "domain", "event_seq", "mode", "export_s", "uptime_ms", "set_id", "fields", "body", "fault"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0), b.column(1), strict=True):
                if rows := list(sets(p.as_py(), content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, SET)


def decoded(all_sets: DataFrame, idle_s: float = 1800.0) -> DataFrame:
    """Data sets with their template and records: one row per record with v, a map of field type to bytes. A set before its template, or with one that has expired or a field of variable length, has one row with a fault."""
    s = all_sets.withColumns({"template_id": C("set_id"), "t_us": C("export_s") * 1_000_000})
    known = s.where("fields is not null").withColumn("version", F.struct("event_seq", "fields"))
    data = s.where("body is not null").drop("fields", "fault")
    j = latest_template(data, known.select("exporter", "domain", "template_id", "t_us", "event_seq", "version"), idle_s).withColumn("fields", C("version.fields"))
    return unpacked(j).drop("version", "t_us")


def unpacked(j: DataFrame) -> DataFrame:
    """The records of data sets (fields, body and others), one row each, with fault and v."""
    size = F.aggregate("fields", F.lit(0), lambda a, f: a + f["len"])
    fault = F.when(C("fields").isNull(), "no_template").when(F.exists("fields", lambda f: f["len"] == VARIABLE) | (size == 0), "template_length")
    j = j.withColumns({"fault": fault, "_size": size})
    count = F.floor(F.length("body") / C("_size")).cast("int")
    places = F.when(C("fault").isNull() & (count > 0), F.sequence(F.lit(0), count - 1)).when(C("fault").isNotNull(), F.array(F.lit(0)))
    r = j.withColumn("record", F.explode(places))
    ends = F.transform("fields", lambda f, k: F.aggregate(F.slice("fields", F.lit(1), k), F.lit(0), lambda a, g: a + g["len"]))
    own = F.transform(F.arrays_zip(C("fields"), ends.alias("at")), lambda f: F.struct(f["fields"]["type"].alias("type"), F.substr("body", C("record") * C("_size") + f["at"] + 1, f["fields"]["len"]).alias("raw")))
    # The last of equal types stands.
    latest = F.aggregate(F.filter(own, lambda f: f["type"] > 0), F.create_map().cast("map<int,binary>"), lambda m, f: F.map_concat(F.map_filter(m, lambda k, _: k != f["type"]), F.create_map(f["type"], f["raw"])))
    return r.withColumn("v", F.when(C("fault").isNull(), latest)).drop("body", "_size")


def value(kind: int) -> Column:
    raw = F.try_element_at("v", F.lit(kind))
    return F.when(raw.isNotNull() & (F.length(raw) <= 8), F.conv(F.hex(raw), 16, 10).cast("long"))


def events(spark: SparkSession, path: str, plan: AddressPlan = AddressPlan()) -> DataFrame:
    """Normalized events of all records that have an address. Time: the flow's end in seconds, in milliseconds, its uptime rebased on the export, or the export."""
    d = decoded(read_sets(spark, path)).where("fault is null")
    length = lambda kind: F.coalesce(F.length(F.try_element_at("v", F.lit(kind))), F.lit(0))
    d = d.where((length(SRC4) == 4) | (length(DST4) == 4) | (length(SRC6) == 16) | (length(DST6) == 16))
    v4 = lambda kind: F.when(F.length(F.try_element_at("v", F.lit(kind))) == 4, F.concat_ws(".", *[number(k, 1, F.try_element_at("v", F.lit(kind))) for k in range(4)]))
    v6 = lambda kind: ipv6_text(F.when(F.length(F.try_element_at("v", F.lit(kind))) == 16, F.hex(F.try_element_at("v", F.lit(kind)))))
    rebased = F.when(C("uptime_ms") > 0, C("export_s") * 1_000_000 - (C("uptime_ms") - value(LAST)) * 1000)
    t = F.coalesce(value(END_SECONDS) * 1_000_000, value(END_MILLIS) * 1000, rebased, C("export_s") * 1_000_000)
    sampling = F.coalesce(F.nullif(value(SAMPLING), F.lit(0)), F.nullif(value(PACKET_SAMPLING), F.lit(0)))
    is6 = F.coalesce(F.try_element_at("v", F.lit(SRC6)), F.try_element_at("v", F.lit(DST6))).isNotNull()
    e = d.select(
        (C("event_seq") * 65_536 + C("record")).alias("event_seq"), t.alias("t_us"), F.coalesce(v4(SRC4), v6(SRC6)).alias("src_ip"), F.coalesce(v4(DST4), v6(DST6)).alias("dst_ip"), value(SRC_PORT).cast("int").alias("src_port"), value(DST_PORT).cast("int").alias("dst_port"),
        value(PROTOCOL).cast("string").alias("protocol"), F.when(value(VERSION).isin(4, 6), value(VERSION)).when(is6, 6).otherwise(4).cast("int").alias("ip_version"), F.nullif(value(FLAGS), F.lit(0)).cast("int").alias("tcp_flags"), value(PACKETS).alias("packets"), value(BYTES).alias("bytes"),
        C("mode").alias("input_mode"), C("path").alias("capture_source"), F.struct(C("exporter").alias("exporter_id"), C("template_id").cast("int").alias("template_id"), (C("export_s") * 1.0).alias("observation_time"), sampling.alias("sampling_rate"), F.coalesce(sampling > 1, F.lit(False)).alias("sampled")).alias("exporter"),
    )
    return normalised(e, plan)
