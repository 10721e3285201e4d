"""Packet captures of any size as a Spark data source, format "pcap": one task for each byte range of a file.

A record says how long it is but not where it begins, so a range finds its first record by trial: a place from which RUN headers in a row are possible (their fractions of a second, lengths and times fit the file), or all up to the file's end. That is a guess, so ranges are first only walked through: each tells where it began and where the first record of the next range has to begin. A range that began elsewhere is walked again from there, until every range begins exactly where the one before it ends. Only then are records read, from these places; the number of a record in its file is the sum of the ranges before. Walking makes no rows, and the ranges' table (a row per range) is all that passes the driver.

Reading the same file in one range or in many gives the same rows, those of `pcap.records`: what can't be read is a row with a fault, a bad header or a broken record ends the file.

Writing: every task writes one file of its rows (t_us, data), with linktype, under a hidden folder; the driver moves the files to their place when all tasks have ended.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .pcap import MAGICS, MAX_RECORD, PCAPNG, RECORD

RANGE_BYTES = 256 << 20
RUN = 16
BLOCK = 4 << 20
BATCH_BYTES = 8 << 20
#: Record times within a file differ by less than this; only a first guess depends on it.
SPAN_S = 400 * 86_400
BOUNDS = "path string, low long, high long, start long, end long, n long"


def listed(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """The file system and (path, size) of a capture, or of all below a folder but hidden ones."""
    store, base = fs.FileSystem.from_uri(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return store, [(info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(base) :].strip("/").split("/"))
    return store, sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))


class Bytes:
    """A window on a file: at(k, n) gives bytes k to k + n, and reads on by blocks."""

    def __init__(self, file, size: int):
        self.file, self.size, self.low, self.held = file, size, 0, b""

    def at(self, k: int, n: int) -> bytes:
        if k < self.low or k + n > self.low + len(self.held):
            self.file.seek(k)
            self.low, self.held = k, self.file.read(max(n, min(BLOCK, self.size - k)))
        return self.held[k - self.low : k - self.low + n]


class Capture:
    """The records of one file."""

    def __init__(self, path: str, file, size: int):
        self.path, self.size, self.bytes = path, size, Bytes(file, size)
        top = self.bytes.at(0, 24)
        order = MAGICS.get(top[:4])
        self.fault = None if order and len(top) == 24 else "pcapng" if top[:4] == PCAPNG else "header"
        if not self.fault:
            self.head, self.fraction = struct.Struct(order[0] + "IIII"), order[1]
            self.linktype = struct.unpack_from(order[0] + "I", top, 20)[0] & 0x0FFFFFFF
            self.began = self.head.unpack(self.bytes.at(24, 16))[0] if size >= 40 else 0

    def possible(self, at: int) -> int | None:
        """Where the next record begins, if a record can begin here."""
        if at + 16 > self.size:
            return None
        seconds, part, caplen, wirelen = self.head.unpack(self.bytes.at(at, 16))
        if part >= self.fraction or caplen > MAX_RECORD or wirelen > MAX_RECORD or at + 16 + caplen > self.size or abs(seconds - self.began) > SPAN_S:
            return None
        return at + 16 + caplen

    def first(self, low: int, high: int) -> int | None:
        """The first place of a range from which RUN records in a row, or all to the file's end, are possible."""
        for k in range(low, min(high, self.size)):
            at: int | None = k
            for _ in range(RUN):
                at = self.possible(at)
                if at is None or at == self.size:
                    break
            if at is not None:
                return k
        return None

    def records(self, start: int, high: int) -> Iterator[tuple]:
        """(place, t_us, caplen, wirelen, fault) of records that begin before `high`; a record_header or record fault is the last."""
        at = start
        while at < min(high, self.size):
            if at + 16 > self.size:
                yield at, None, None, None, "record_header"
                return
            seconds, part, caplen, wirelen = self.head.unpack(self.bytes.at(at, 16))
            if caplen > MAX_RECORD or at + 16 + caplen > self.size:
                yield at, None, None, None, "record"
                return
            yield at, seconds * 1_000_000 + part * 1_000_000 // self.fraction, caplen, wirelen, "length" if caplen > wirelen else None
            at += 16 + caplen


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int
    start: int | None
    index: int = 0


def cut(files: list[tuple[str, int]], range_bytes: int) -> list[Range]:
    """Ranges of all files; a file's first begins behind its header."""
    return [Range(p, low, min(low + range_bytes, size), 24 if low == 0 else None) for p, size in files for low in range(0, max(size, 1), range_bytes)]


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bounds = options["path"], str(options.get("bounds", "false")).lower() == "true"
        self.range_bytes, self.plan = int(options.get("range_bytes", RANGE_BYTES)), options.get("plan")

    def partitions(self) -> list[Range]:
        if self.plan:
            return [Range(*r) for r in json.loads(self.plan)]
        return cut(listed(self.path)[1], self.range_bytes)

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Range):
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as file:
            c = Capture(partition.path, file, file.size())
            yield from self.walk(c, partition) if self.bounds else self.rows(c, partition)

    def walk(self, c: Capture, r: Range) -> Iterator[pa.RecordBatch]:
        """One row of BOUNDS. start is null if no record begins in the range; end is null behind the file's last record or its first fault."""
        start = r.start if r.start is not None or c.fault else c.first(r.low, r.high)
        n, end = 0, None
        if start is not None and not c.fault:
            end = start
            for at, _, caplen, _, fault in c.records(start, r.high):
                n += fault is None
                end = at + 16 + caplen if caplen is not None else None
            if end is not None and end >= c.size:
                end = None
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((r.path, r.low, r.high, start, end, n), [pa.string(), *[pa.int64()] * 5])], [f.split()[0] for f in BOUNDS.split(", ")])

    def rows(self, c: Capture, r: Range) -> Iterator[pa.RecordBatch]:
        """Rows of RECORD."""
        names, kinds = [f.split()[0] for f in RECORD.split(", ")], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        batch = lambda held: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), kinds)], names)
        if c.fault:
            yield batch([(r.path, None, None, None, None, None, None, c.fault)])
            return
        held, size, index = [], 0, r.index
        for at, t_us, caplen, wirelen, fault in c.records(r.start, r.high):
            if caplen is None:
                held.append((r.path, c.linktype, None, None, None, None, None, fault))
                break
            held.append((r.path, c.linktype, None if fault else index, t_us, caplen, wirelen, c.bytes.at(at + 16, caplen), fault))
            index, size = index + (fault is None), size + 100 + caplen
            if size >= BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class FileWriter(DataSourceArrowWriter):
    """Writes one file for each task that has rows: `top`, then what `piece` makes of each row's `columns`."""

    columns: list[str]
    suffix: str
    top = b""

    def __init__(self, options: dict):
        self.path, self.run = options["path"], uuid.uuid4().hex

    def piece(self, *row) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = fs.FileSystem.from_uri(self.path)
        task = TaskContext.get()
        name, out = f"{self.run}-{task.partitionId():06d}-{task.taskAttemptId()}.{self.suffix}", None
        for b in iterator:
            for row in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in self.columns]):
                if out is None:
                    store.create_dir(f"{base}/.{self.run}", recursive=True)
                    out = store.open_output_stream(f"{base}/.{self.run}/{name}", compression=None)
                    out.write(self.top)
                out.write(self.piece(*row))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.name:
                store.move(f"{base}/.{self.run}/{m.name}", f"{base}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{base}/.{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/.{self.run}")


class CaptureWriter(FileWriter):
    """Takes rows (t_us long, data binary)."""

    columns, suffix = ["t_us", "data"], "pcap"

    def __init__(self, options: dict):
        super().__init__(options)
        self.top = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, MAX_RECORD, int(options.get("linktype", 1)))

    def piece(self, t_us: int, data: bytes) -> bytes:
        return struct.pack("<IIII", *divmod(t_us, 1_000_000), len(data), len(data)) + data


class CaptureSource(DataSource):
    """Options: range_bytes; bounds (rows of BOUNDS in place of records); plan (the ranges as JSON, from `planned`); linktype, of writing."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return BOUNDS if str(self.options.get("bounds", "false")).lower() == "true" else RECORD

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options)


def planned(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[Range]:
    """The ranges in which records begin, each with its true first record and how many good ones are before it."""
    source = spark.read.format("pcap").options(path=path, bounds="true", range_bytes=str(range_bytes))
    walked = {(r.path, r.low): r for r in source.load().collect()}
    while True:
        out, again, due = [], [], {}
        last: tuple = (None, 0)
        for path_low in sorted(walked):
            r = walked[path_low]
            end, n = (24, 0) if r.path != last[0] else due[r.path]
            last = (r.path, 0)
            # The end of the range before is where this one begins, if that is in it at all.
            if end is None or (end >= r.high and r.low > 0):
                due[r.path] = (end, n)
                continue
            if r.start is not None and r.start != end or r.start is None and r.end is None and r.low > 0:
                again.append([r.path, r.low, r.high, end, 0])
                due[r.path] = (None, n)  # the ranges behind it are judged when it has been walked again
                continue
            out.append(Range(r.path, r.low, r.high, end, n))
            due[r.path] = (r.end, n + r.n)
        if not again:
            return out
        more = spark.read.format("pcap").options(path=path, bounds="true", plan=json.dumps(again)).load()
        walked |= {(r.path, r.low): r for r in more.collect()}


def read_captures(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of all captures at a path, a file or a folder, by byte ranges."""
    spark.dataSource.register(CaptureSource)
    plan = json.dumps([[r.path, r.low, r.high, r.start, r.index] for r in planned(spark, path, range_bytes)])
    return spark.read.format("pcap").options(path=path, plan=plan).load()


def write_captures(packets: DataFrame, path: str, linktype: int = 1) -> None:
    """Write rows (t_us, data) as captures, one for each task that has rows, in the order of its rows."""
    packets.sparkSession.dataSource.register(CaptureSource)
    packets.select("t_us", "data").write.format("pcap").options(path=path, linktype=str(linktype)).mode("append").save()
