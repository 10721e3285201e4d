r"""Web archives as a Spark data source: `write` makes one gzip member per record, `read` goes through each archive in sequence.

    archive(pages, path)          writes a response record per page, or a revisit record where another page has the same payload
    records(spark, path)          reads archives back, one row per record
    resolved(records)             the rows of pages, each revisit checked against the response that it refers to

Writing: pages with equal payloads are grouped by SHA-256 (counts and largest ids alone are shuffled, combined before the shuffle; the payloads stay where they were read as long as the groups with copies are few enough to be broadcast, and else meet them in a join that the adaptive skew join splits). Every task streams its rows into archives of its own, of up to `roll_bytes` each, under a hidden folder; the driver moves them to their place when all tasks have ended, so a task that is lost or runs twice leaves nothing behind.

Reading: one task an archive, a megabyte at a time. A member is decompressed incrementally, its header is read up to the empty line, exactly Content-Length bytes are taken as the block, and both digests are worked out on the way. What follows a damaged member is found by the next member's first bytes, so damage costs one record. Memory: the payload of one record and a batch of about 8 MB.

Defined results: a null html is an empty payload. Of pages with equal payloads of at least `least_bytes` bytes, those with the largest id are responses (all of them, if rows repeat that id) and the others revisits; a page without an id is a response unless another page has its payload and an id. A record's id is made of the page's id, of any type, as text; line breaks and other control characters in a URL are percent-encoded, and a null URL has no field. An empty table gives no archive, and a folder without archives no rows. Other columns aren't looked at. A record that can't be read has its `fault` set: gzip (damaged member), header, length (the block is too short or long), or digest (the payload or block isn't what the record says).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import checked_broadcast, settle

# Names that the archive format gives.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http; msgtype=response"
MAGIC = b"\x1f\x8b\x08"

#: Up to so many groups of pages with equal payloads (a hash and an id each) are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 500_000
CHUNK = 1 << 16
BUFFER = 1 << 20
HEADER_MOST = 1 << 20
BATCH_BYTES = 8 << 20

RECORD = "archive string, offset long, length long, record_type string, record_id string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, digest_ok boolean, payload binary, fault string"


def sha1_base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: str | None) -> str:
    return "<urn:page-none>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def header_value(text: str) -> str:
    return "".join(quote(c) if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A record before it is compressed."""
    head = {"WARC-Type": kind, **fields, "WARC-Block-Digest": "sha1:" + sha1_base32(hashlib.sha1(block).digest()), "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """The response record of a page, or, with the id of the page that it repeats, its revisit record: the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Record-ID": record_id(page_id), "WARC-Date": date, "WARC-Target-URI": header_value(url) if url is not None else None, "Content-Type": HTTP_RESPONSE, "WARC-Payload-Digest": "sha1:" + sha1_base32(hashlib.sha1(payload).digest())}
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", fields | {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": record_id(refers_to)}, http)


def gzipped(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# ---------------------------------------------------------------- reading


class Members:
    """The members of a gzip file, decompressed step by step; `take` and `until` stay within the current member."""

    def __init__(self, file):
        self.file, self.raw, self.at = file, b"", 0

    def _fill(self, n: int = 1) -> bool:
        while len(self.raw) < n and (more := self.file.read(CHUNK)):
            self.raw += more
        return len(self.raw) >= n

    def next(self) -> bool:
        """Go to the next member, if there is one; bytes before its first are passed over."""
        while self._fill(len(MAGIC)):
            k = self.raw.find(MAGIC)
            if k >= 0:
                self._drop(k)
                self.z, self.out, self.start = zlib.decompressobj(31), b"", self.at
                return True
            self._drop(len(self.raw) - len(MAGIC) + 1)
            if not self._fill(len(MAGIC)):
                break
        return False

    def _drop(self, n: int) -> None:
        self.raw, self.at = self.raw[n:], self.at + n

    def more(self) -> bytes:
        """Some more bytes of the member; none at its end. zlib.error if it is damaged or cut off."""
        while not self.z.eof:
            if not self._fill():
                raise zlib.error("cut off")
            got = self.z.decompress(self.raw, CHUNK)
            rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self._drop(len(self.raw) - len(rest))
            if got:
                return got
        return b""

    def until(self, mark: bytes, most: int) -> bytes | None:
        """What stands before the mark, which is passed over; None if it isn't there within `most` bytes."""
        while (k := self.out.find(mark)) < 0:
            if len(self.out) > most or not (got := self.more()):
                return None
            self.out += got
        head, self.out = self.out[:k], self.out[k + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces, or fewer at the member's end."""
        while n > 0 and (self.out or (got := self.more())):
            piece, self.out = (self.out[:n], self.out[n:]) if self.out else (got[:n], got[n:])
            n -= len(piece)
            yield piece

    def skip(self) -> None:
        """Go back to just behind the first bytes of a damaged member, as far as they are still held, to look for the next."""
        if self.at == self.start:
            self._drop(1)


def fields_of(head: bytes) -> dict[str, str]:
    """Names in lower case and values of header lines; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            out[last := name.strip().lower()] = value.strip()
    return out


def read_record(m: Members, keep: bool) -> tuple:
    """The current member as a row of RECORD without its archive. HTTP headers are taken off the block; a revisit's payload length is the one that its HTTP header names."""
    head: dict[str, str] = {}
    digests, n_payload, pieces, named, fault, ok = (hashlib.sha1(), hashlib.sha1()), 0, [], None, None, None
    try:
        top = m.until(b"\r\n\r\n", HEADER_MOST)
        if top is None or not top.startswith(b"WARC/"):
            fault = "header"
        else:
            head = fields_of(top)
            size = int(head["content-length"]) if head.get("content-length", "").isascii() and head.get("content-length", "").isdigit() else -1
            fault = "header" if size < 0 else None
            http, waiting, seen = head.get("content-type", "").lower().startswith("application/http"), b"", 0
            for piece in m.take(size) if size > 0 else ():
                seen += len(piece)
                digests[0].update(piece)
                if http:
                    waiting += piece
                    k = waiting.find(b"\r\n\r\n")
                    if k < 0 and len(waiting) <= HEADER_MOST:
                        continue
                    cut = k + 4 if k >= 0 else 0
                    length = fields_of(waiting[:cut]).get("content-length", "")
                    named = int(length) if length.isascii() and length.isdigit() else None
                    piece, http = waiting[cut:], False
                digests[1].update(piece)
                n_payload += len(piece)
                if keep:
                    pieces.append(piece)
            end = m.until(b"\r\n\r\n", 4)
            if fault is None and (seen != size or end != b"" or m.out or m.more()):
                fault = "length"
        while m.more():  # what is left of the member
            pass
    except zlib.error:
        fault = "gzip"
        m.skip()
    kind, declared = head.get("warc-type"), head.get("warc-payload-digest")
    if fault is None:
        block = head.get("warc-block-digest")
        right = [f"sha1:{sha1_base32(d.digest())}" for d in digests]
        checks = [block == right[0]] if block else []
        if declared and kind != "revisit":
            checks.append(declared == right[1])
        ok = all(checks) if checks else None
        fault = "digest" if ok is False else None
    revisit = kind == "revisit"
    size = (named if revisit else n_payload) if fault is None else None
    payload = b"".join(pieces) if keep and fault is None and not revisit else None
    return (m.start, m.at - m.start, kind, head.get("warc-record-id"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), declared.removeprefix("sha1:") if declared else None, size, ok, payload, fault)


@dataclass
class Archive(InputPartition):
    path: str


def archives(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The file system and the archives below a folder, without hidden ones, in order of their names."""
    store, base = fs.FileSystem.from_uri(path)
    found = [f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)) if f.type == fs.FileType.File]
    hidden = lambda p: any(x[:1] in "._" for x in p[len(base) :].strip("/").split("/"))
    return store, sorted(p for p in found if p.endswith(".warc.gz") and not hidden(p))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.keep = options["path"], str(options.get("payload", "true")).lower() == "true"

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in archives(self.path)[1]]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not getattr(partition, "path", None):
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.bool_(), pa.binary(), pa.string()]
        names = [f.split()[0] for f in RECORD.split(", ")]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        rows, held = [], 0
        with store.open_input_stream(partition.path, compression=None, buffer_size=BUFFER) as file:
            m = Members(file)
            while m.next():
                row = (partition.path, *read_record(m, self.keep))
                rows.append(row)
                held += 500 + len(row[11] or b"")
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


# ---------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Takes rows (page_id string, url string, payload binary, refers_to string)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level, self.roll, self.date = int(options.get("level", 6)), int(options.get("roll_bytes", 1 << 30)), options.get("date", "1970-01-01T00:00:00Z")
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = fs.FileSystem.from_uri(self.path)
        task = TaskContext.get()
        store.create_dir(f"{base}/.{self.run}", recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for b in iterator:
                columns = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "refers_to")]
                for k in range(b.num_rows):
                    page_id, url, payload, refers_to = (c[k].as_py() for c in columns)
                    if out is None:
                        name = f"{self.run}-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc.gz"
                        names.append(name)
                        out = store.open_output_stream(f"{base}/.{self.run}/{name}", compression=None)
                        info = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": self.date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                        out.write(gzipped(info, self.level))
                        size = 0
                    data = gzipped(page_record(page_id, url, payload, refers_to, self.date), self.level)
                    out.write(data)
                    size += len(data)
                    if size >= self.roll:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        old = archives(self.path)[1] if self.overwrite else []
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{base}/.{self.run}/{name}", f"{base}/{name}")
        for p in old:
            store.delete_file(p)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{base}/.{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/.{self.run}")


class WarcSource(DataSource):
    """format("warc"). Options of reading: payload (false leaves the payloads out). Of writing: level, roll_bytes, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


# ---------------------------------------------------------------- the operator


def tagged(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, payload, refers_to: the id of the page whose payload the row repeats, else null."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("h"))
    large = F.octet_length("html") >= least_bytes
    groups = rows.where(large).groupBy("h").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1 and best is not null").select("h", "best")
    groups = checked_broadcast(settle(groups), BROADCAST_GROUPS)
    out = rows.join(groups, "h", "left")
    repeats = F.col("best").isNotNull() & large & ~F.col("page_id").eqNullSafe(F.col("best"))
    return out.select(F.col("page_id").cast("string").alias("page_id"), "url", F.encode("html", "UTF-8").alias("payload"), F.when(repeats, F.col("best")).cast("string").alias("refers_to"))


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, mode: str = "append", **options) -> None:
    """Write the pages as archives into a folder that all executors share. options: level (of compression), roll_bytes (archive size at which the next begins), date (of all records)."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    tagged(pages, id_col, url_col, html_col, least_bytes).write.format("warc").options(path=path, **options).mode(mode).save()


def records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records below a folder: rows of RECORD. Without payloads they are still read and their digests verified."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(path=path, payload=str(payload).lower()).load()


def resolved(found: DataFrame) -> DataFrame:
    """page_id string, payload_bytes, payload_digest, record_type, refers_to string, verified: of every response and revisit. verified: the record is whole and its digests are right, and a revisit's response is there, verified, with the digest and length that the revisit names."""
    page = F.udf(lambda r: unquote(r.removeprefix("<urn:page:").removesuffix(">")) if r and r.startswith("<urn:page:") else None, "string", useArrow=True)
    own = settle(found.where("record_type in ('response', 'revisit') or fault is not null").select("record_type", "record_id", "refers_to", "payload_bytes", "payload_digest", (F.col("fault").isNull() & F.coalesce("digest_ok", F.lit(False))).alias("whole")))
    wanted = own.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    named = own.where("record_type = 'response' and whole").select("record_id", F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")).join(wanted, "record_id", "left_semi")
    named = checked_broadcast(settle(named.dropDuplicates(["record_id"]).withColumnRenamed("record_id", "to")), BROADCAST_GROUPS)
    out = own.join(named, F.col("refers_to") == F.col("to"), "left")
    revisit = F.col("record_type") == "revisit"
    there = F.coalesce((F.col("d") == F.col("payload_digest")) & (F.col("n") == F.col("payload_bytes")), F.lit(False))
    return out.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(revisit, page("refers_to")).alias("refers_to"), F.coalesce(F.col("whole") & (~revisit | there), F.lit(False)).alias("verified"))
