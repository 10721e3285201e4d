"""Byte-level BPE over whole texts, by overlapping chunks, and decoding.

1. Texts up to CHUNK code points are one chunk. A longer text is cut into chunks that overlap, so that many tasks share it.
2. Each chunk is pre-tokenised on its own. Its first pieces can be wrong, as it may begin inside one. No piece holds a white-space character after another character, so where the one follows the other every pre-tokenisation has a boundary: the splits of neighbouring chunks agree from the first such boundary in their overlap on.
3. Neighbours are stitched there. A chunk without such a boundary (a run without white space that is longer than the overlap) is left to the chunk before it.
4. The stretches between stitches, which are whole pieces, are encoded, and a text's ids are put together in order.

Ids are held as unsigned 32-bit numbers in little-endian order. Decoding joins the bytes of the ids.

Defined results: a null or empty text has no ids. No text has special tokens: their strings are ordinary text. Rows that share an id are each returned, long ones too. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, slices, tidied, whole

#: Code points of a chunk without its overlap, and of the overlap with the next.
CHUNK, OVERLAP = 32_768, 512


class Vocabulary:
    """Ranks of a tiktoken file and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.digits_of = [str(k).encode() for k in range(len(self.bytes_of))]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each Python worker. Every worker has the tokenizer's files at this path, as it has the library."""
    return Vocabulary(path, pattern)


def breaks(piece: regex.Pattern, text: str) -> list[int]:
    """Where a piece that begins with plain white space follows one that doesn't end with white space of any kind."""
    return [a for m in piece.finditer(text) if (a := m.start()) and text[a] in " \n\t\r" and not text[a - 1].isspace()]


def stitches(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """key, start and end (code points, end exclusive) of the stretches of long texts, from rows (key, t)."""
    chunks = docs.select("key", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / chunk).cast("int"))).alias("k"), "t")
    chunks = chunks.select("key", "k", F.length("t").alias("n"), F.expr(f"substring(t, k * {chunk} + 1, {chunk + overlap})").alias("part"))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = vocabulary(path, pattern).piece
        for b in slices(batches):
            heads, tails = [], []
            for k, part in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                at = breaks(piece, part)
                heads.append([k * chunk + a for a in at if a < overlap] if k else [0])
                tails.append([k * chunk + a for a in at if a >= chunk])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["key", "k", "n", "head", "tail"])

    spread = chunks.repartition("key", "k")
    ends = spread.mapInArrow(run, "key long, k int, n int, head array<int>, tail array<int>")
    by_text = Window.partitionBy("key").orderBy("k")
    meet = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(by_text), "head")))
    starts = ends.withColumn("start", meet).where("start is not null")
    return starts.select("key", "start", F.coalesce(F.lead("start").over(by_text), "n").alias("end"))


def encoder(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the last column, a text, becomes its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in slices(batches):
            last = b.num_columns - 1
            ids = [v.encode(t).tobytes() for t in b.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(ids, pa.binary())], [*b.schema.names[:last], "ids"])

    return run


def reader(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: from doc_id and ids, or the parts of the ids, to the columns of read_back()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in slices(batches):
            n, ids_sha, text_sha, size = [], [], [], []
            for parts in b.column(1).to_pylist():
                of_ids, of_text, tokens, count = hashlib.sha256(), hashlib.sha256(), 0, 0
                for part in [parts] if isinstance(parts, bytes) else parts:
                    ids = np.frombuffer(part, dtype="<u4").tolist()
                    if ids:
                        of_ids.update(b" " * bool(tokens) + b" ".join(map(v.digits_of.__getitem__, ids)))
                        text = b"".join(map(v.bytes_of.__getitem__, ids))
                        of_text.update(text)
                        tokens, count = tokens + len(ids), count + len(text)
                n.append(tokens)
                ids_sha.append(of_ids.hexdigest())
                text_sha.append(of_text.hexdigest())
                size.append(count)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(size, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return run


def read_columns(rows: DataFrame) -> str:
    return f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def short_texts(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("t")).where(F.length("t") <= chunk)


def encode_long(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, chunk: int, overlap: int) -> DataFrame:
    """encode()'s rows of the texts of more than one chunk."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("t"))
    # A long text's row has a key of its own, so that rows that share an id stay apart; written, it is the same in every use.
    long = settle(rows.where(F.length("t") > chunk).withColumn("key", F.monotonically_increasing_id()))
    spans = stitches(long.select("key", "t"), path, pattern, chunk, overlap)
    spans = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    pieces = long.join(spans, "key").select("key", F.explode("spans").alias("s"), "t").select("key", F.col("s.start").alias("start"), F.expr("substring(t, s.start + 1, s.end - s.start)").alias("t"))
    coded = pieces.repartition("key", "start").mapInArrow(tidied(encoder(path, pattern)), "key long, start int, ids binary")
    whole_ids = coded.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("c")).select("key", F.col("c.ids").alias("parts"))
    return long.select("key", "doc_id").join(whole_ids, "key").select("doc_id", "parts")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and parts: the text's ids in order, as an array of binaries."""
    short = short_texts(docs, id_col, text_col, chunk)
    short = short.mapInArrow(tidied(encoder(path, pattern)), f"doc_id {dict(short.dtypes)['doc_id']}, ids binary").select("doc_id", F.array("ids").alias("parts"))
    return short.unionByName(encode_long(docs, path, pattern, id_col, text_col, chunk, overlap))


def read_back(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """From encode()'s rows: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes."""
    return coded.select("doc_id", "parts").mapInArrow(tidied(reader(path, pattern)), read_columns(coded))


def encode_and_read_back(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The rows of read_back(encode(docs)). A task's short texts are encoded and their ids decoded by one Python worker, one slice after the other: two steps in a row would keep two workers a task, and an executor keeps those for all later stages."""
    encoded, read = encoder(path, pattern), reader(path, pattern)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read(encoded(batches))

    short = short_texts(docs, id_col, text_col, chunk)
    long = encode_long(docs, path, pattern, id_col, text_col, chunk, overlap)
    return short.mapInArrow(run, read_columns(short)).unionByName(read_back(long, path, pattern))
