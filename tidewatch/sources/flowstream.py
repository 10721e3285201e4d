"""Flow-record files as a Spark data source, format "flowrec", in batch and as a stream, and the templates of a stream's exporters as keyed state.

A file is read by blocks in one task; many files are many tasks. A stream's offset is the number of files, in order of their paths, that it has had: files are added with names that sort behind those before, and none is taken away while a stream reads. An exporter is a file, or with exporter = folder all files of a folder, in order. event_seq counts on through the files of a source.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..config import WindowConfig
from ..streaming.inorder import Waiting, shard_of
from ..streaming.windows import timed_by_all
from .capture import Bytes, FileWriter, listed
from .flowrec import SET, sets_in, unpacked

C = F.col
FIELDS = "array<struct<type: int, len: int>>"
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20


@dataclass
class File(InputPartition):
    path: str
    number: int


def rows_of(source: str, part: File, by_folder: bool) -> Iterator[pa.RecordBatch]:
    """A file's rows of SET."""
    store, _ = fs.FileSystem.from_uri(source)
    field = pa.list_(pa.struct([("type", pa.int32()), ("len", pa.int32())]))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), field, pa.binary(), pa.string()]
    names = ["path", "exporter", "domain", "event_seq", "mode", "export_s", "uptime_ms", "set_id", "fields", "body", "fault"]
    exporter = part.path.rsplit("/", 2)[-2] if by_folder else part.path
    batch = lambda held: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), kinds)], names)
    held, size = [], 0
    with store.open_input_file(part.path) as file:
        for row in sets_in(part.path, Bytes(file, file.size())):
            held.append((row[0], exporter, row[2], part.number << 32 | row[3], *row[4:]))
            size += 100 + len(row[9] or b"")
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
    if held:
        yield batch(held)


class FlowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.by_folder = options["path"], options.get("exporter") == "folder"

    def partitions(self) -> list[File]:
        return [File(p, k) for k, (p, _) in enumerate(listed(self.path)[1])]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, File):
            yield from rows_of(self.path, partition, self.by_folder)


class FlowStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.by_folder = options["path"], options.get("exporter") == "folder"
        self.most, self.had = int(options.get("files_per_batch", 0)), 0

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        n = len(listed(self.path)[1])
        return {"files": min(n, self.had + self.most) if self.most else n}

    def partitions(self, start: dict, end: dict) -> list[File]:
        self.had = end["files"]
        return [File(p, k) for k, (p, _) in enumerate(listed(self.path)[1][: end["files"]]) if k >= start["files"]]

    def commit(self, end: dict) -> None:
        self.had = max(self.had, end["files"])

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.path, partition, self.by_folder)


class MessageWriter(FileWriter):
    """Takes rows (message binary): datagrams as they are sent."""

    columns, suffix = ["message"], "flow"

    def piece(self, message: bytes) -> bytes:
        return message


class FlowSource(DataSource):
    """Options: exporter (folder: all files of a folder are one); files_per_batch, of a stream (0: all that are there; a trigger of availableNow reads what its first batch offers, so leave it at 0 there)."""

    @classmethod
    def name(cls) -> str:
        return "flowrec"

    def schema(self) -> str:
        return SET

    def reader(self, schema: StructType) -> FlowReader:
        return FlowReader(self.options)

    def streamReader(self, schema: StructType) -> FlowStreamReader:
        return FlowStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MessageWriter:
        return MessageWriter(self.options)


def read_stream(spark: SparkSession, path: str, by_folder: bool = True, files_per_batch: int = 0) -> DataFrame:
    spark.dataSource.register(FlowSource)
    return spark.readStream.format("flowrec").options(path=path, exporter="folder" if by_folder else "file", files_per_batch=str(files_per_batch)).load()


def write_messages(messages: DataFrame, path: str) -> None:
    """Write rows (message) as files, one for each task that has rows, in the order of its rows."""
    messages.sparkSession.dataSource.register(FlowSource)
    messages.select("message").write.format("flowrec").options(path=path).mode("append").save()


class TemplateProcessor(Waiting):
    """Per exporter, domain, set and part of its data sets: the templates that a row can still need. The latest of those that the watermark has passed goes when the watermark is idle_s past it, unless it is registered anew. Rows are given their template by chunks, so an exporter's records are never in memory together."""

    fields = "t_us long, event_seq long, path string, mode string, uptime_ms long, fields string, body binary"
    out = ["exporter", "domain", "set_id", "t_us", "event_seq", "path", "mode", "uptime_ms", "fields", "body"]

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.templates = handle.getListState("templates", "t_us long, event_seq long, fields string")

    def taken(self, rows: pa.Table) -> tuple[pa.Table, int | None]:
        own = pc.is_valid(rows["fields"])
        told = [tuple(r.values()) for r in rows.filter(own).select(["t_us", "event_seq", "fields"]).to_pylist()]
        if told:
            self.templates.appendList(told)
        return rows.filter(pc.invert(own)), min(((t + self.idle_us) // 1000 + 1 for t, _, _ in told), default=None)

    def woken(self, key: tuple, due: Iterator[pa.Table], now_us: int) -> Iterator[pd.DataFrame]:
        known = sorted(self.templates.get()) if self.templates.exists() else []
        at, seqs = np.array([t for t, _, _ in known], dtype=np.int64), [seq for _, seq, _ in known]
        fields = np.array([None, *[f for _, _, f in known]], dtype=object)
        for rows in due:
            t, seq = rows["t_us"].to_numpy(), rows["event_seq"].to_numpy()
            # How many templates are before each row, in order of time and then of number.
            low, high = np.searchsorted(at, t, "left"), np.searchsorted(at, t, "right")
            for k in np.flatnonzero(low < high):
                low[k] = bisect_left(seqs, seq[k], low[k], high[k])
            place = np.where((low > 0) & (t - np.concatenate(([0], at))[low] <= self.idle_us), low, 0)
            out = rows.to_pandas().assign(fields=fields[place], exporter=key[0], domain=key[1], set_id=key[2])
            yield out[self.out]
        passed = int(np.searchsorted(at, now_us, "right"))
        kept = known[max(passed - 1, 0) :]
        if passed and now_us - kept[0][0] > self.idle_us:
            kept = kept[1:]
        self.over = (kept[0][0] + self.idle_us) // 1000 + 1 if kept else None
        if kept:
            self.templates.put(kept)
        else:
            self.templates.clear()

    def idle(self) -> int | None:
        return self.over


def decoded(sets: DataFrame, idle_s: float = 1800.0, window: WindowConfig = WindowConfig(), parts: int = 32) -> DataFrame:
    """The rows of flowrec.decoded for a stream of sets: records of data sets that the watermark, which follows the export times, has passed. Each set has the latest template registered before it, in order of export time and of the files, at most idle_s old. An exporter's data sets are dealt over `parts` keys, each of which gets its templates too."""
    s = sets.where("fault is null").withColumn("t_us", C("export_s") * 1_000_000)
    s = timed_by_all(s.select("exporter", "domain", "set_id", "t_us", "event_seq", "path", "mode", F.coalesce("uptime_ms", F.lit(-1)).alias("uptime_ms"), F.to_json("fields").alias("fields"), "body"), window)
    s = s.withColumn("part", F.explode(F.when(C("fields").isNotNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(shard_of("event_seq", shards=parts)))))
    kinds = "exporter string, domain long, set_id int, t_us long, event_seq long, path string, mode string, uptime_ms long, fields string, body binary"
    j = s.groupBy("exporter", "domain", "set_id", "part").transformWithStateInPandas(TemplateProcessor(int(idle_s * 1_000_000)), kinds, "append", "eventTime")
    j = j.withColumns({"template_id": C("set_id"), "export_s": F.floor(C("t_us") / 1_000_000), "uptime_ms": F.nullif("uptime_ms", F.lit(-1)), "fields": F.from_json("fields", FIELDS)})
    return unpacked(j).drop("t_us")
