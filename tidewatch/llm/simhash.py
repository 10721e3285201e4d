"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming radius through BK-trees over shards.

1. Fingerprints: a bit is 1 if it is set in over half of the XXH64 hashes of a text's word shingles.
2. Shards: two fingerprints at most r bits apart agree in one of r + 1 blocks of bits at least, so every distinct fingerprint goes to r + 1 shards, one for each block, keyed by the block's value. Nothing is lost. A shard with over SHARD_ROWS fingerprints is split again by the blocks of its other bits, and what is still large is dealt out as pairs of parts, so that a task never holds more than two parts.
3. Each task builds the BK-trees of its shards (a child hangs on its parent by their integer distance) and follows, for each fingerprint, only the edges within the radius. Trees grow with the corpus, so they are sent to tasks by shuffle, not by broadcast. Found links leave a task as one edge per fingerprint, to the smallest fingerprint of its linked part: never as all pairs of a group.
4. Connected components of these edges by large-star and small-star rounds, each written to the shared folder.

Defined results: a null, empty or all-white text has no words and fingerprint zero, and is linked like any other. A text with fewer words than a shingle has one shingle, all its words. Ties at exactly half give bit 0. Rows that share an id are each returned. A null id links like any other and never is the smallest, unless a component has no id. An empty table gives an empty result. Other columns are not looked at. near_groups() orders its components by whole-number ids and fails on others; near_copies() and keep_one() take ids of any kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bktree
from .common import BROADCAST_IDS, checked_broadcast, discard, numbered, order_key, settle, slices, tidied, whole, words

SEED = 42
#: Of near_copies(): words of a shingle, the least Jaccard similarity, and the radius that fingerprints of such texts lie within.
WIDTH, LEAST_ALIKE, RADIUS = 5, 0.8, 24
#: Bands of two least shingle hashes, one of which texts that alike share but for one pair in 27,000, and bytes of a sketch.
BANDS, SKETCH = 10, 256
#: Fingerprints that one shard, or one part of a split shard, may hold, and bytes of shingle sets.
SHARD_ROWS, SHARD_BYTES = 4096, 1 << 24


def shingle_hashes(tokens: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every shingle of `width` words joined by a space, repeats included; one shingle of all words if there are fewer."""
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    if len(tokens) <= width:
        starts, ends = [0], [len(joined)]
    else:
        starts = np.concatenate(([0], ends[: len(tokens) - width] + 1)).tolist()
        ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]), dtype=">u8").astype(np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint; 0 for no hashes."""
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id and code, the fingerprint as a signed long."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            codes = np.array([simhash(shingle_hashes(words(t), width)) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, code long")


def blocks(total: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of `parts` blocks over `total` bits."""
    cuts = [total * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _block_value(code: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << bits) - 1))


def pigeonhole_shards(codes: DataFrame, radius: int) -> DataFrame:
    """shard, node, code: every code once for each of radius + 1 blocks; the codes of large shards once more for each block of their other bits."""
    cuts = blocks(64, radius + 1)
    first = codes.select("node", "code", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _block_value(F.col("code"), a, n).alias("v")) for k, (a, n) in enumerate(cuts)])).alias("s"))
    first = first.select("node", "code", F.col("s.k").alias("k"), F.col("s.v").alias("v"))
    large = settle(first.groupBy("k", "v").count().where(F.col("count") > SHARD_ROWS).select("k", "v", F.lit(True).alias("large")))
    first = first.join(large, ["k", "v"], "left")
    small = first.where("large is null").select(F.concat_ws(":", "k", "v").alias("shard"), "node", "code")
    again = []
    for k, (a, n) in enumerate(cuts):
        # The bits outside block k, closed up, so that they are cut into even blocks again.
        rest = F.shiftrightunsigned(F.col("code"), a + n) if a + n < 64 else F.lit(0).cast("long")
        rest = F.shiftleft(rest, a).bitwiseOR(_block_value(F.col("code"), 0, a) if a else F.lit(0).cast("long"))
        again.append(F.when(F.col("k") == k, F.array(*[F.concat_ws(":", "k", "v", F.lit(j), _block_value(rest, x, m)) for j, (x, m) in enumerate(blocks(64 - n, radius + 1))])))
    split = first.where("large").select(F.explode(F.coalesce(*again)).alias("shard"), "node", "code")
    return small.unionByName(split)


def linked_edges(shards: DataFrame, radius: int, least_alike: float | None = None) -> DataFrame:
    """Edges (a, b) of nodes from rows (shard, node, code) or, with least_alike, (shard, node, code, sketch, hashes, size): for every node with a link inside a shard one edge to the first node of its linked part. Links need a distance of at most `radius` and, if asked for, that Jaccard similarity of the hashes."""
    extra = ["sketch", "hashes"] if least_alike is not None else []
    parts = F.count(F.lit(1)) / SHARD_ROWS
    if extra:
        parts = F.greatest(parts, F.sum("size") / SHARD_BYTES)  # few long texts are as much as many short ones
    large = settle(shards.groupBy("shard").agg(F.ceil(parts).cast("int").alias("parts")).where("parts > 1"))
    rows = shards.select("shard", "node", "code", *extra).join(large, "shard", "left")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = F.transform(others, lambda o: F.concat_ws("|", "shard", F.least(part, o), F.greatest(part, o)))
    # As text on both sides: a shard can be a number, and a pair's name is none.
    keyed = rows.select(F.explode(F.when(F.col("parts").isNull(), F.array(F.col("shard").cast("string"))).otherwise(pairs)).alias("shard"), "node", "code", *extra)
    keyed = keyed.select(F.xxhash64("shard").alias("shard"), "node", "code", *extra)
    keyed = keyed.repartition("shard").sortWithinPartitions("shard", "node")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Hashes are long: small slices, so that few rows are copied at a time, and sets that stay in Arrow's memory.
        for b in whole_groups(slices(batches, 256), 2048, SHARD_BYTES) if extra else whole_groups(batches):
            group, node, code = (b.column(k).to_numpy() for k in range(3))
            sketch = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint8).reshape(len(node), -1) if extra else None
            sets = [v.as_buffer() for v in b.column(4)] if extra else None
            a, to = bktree.linked(group, code.view(np.uint64), radius, sketch, sets, least_alike or 0.0)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[to])], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 65_536, size: int = 1 << 62) -> Iterator[pa.RecordBatch]:
    """Batches of about `rows` rows or `size` bytes that end where the first column's value changes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if (sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size) and held[0].column(0)[0] != b.column(0)[b.num_rows - 1]:
            one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = one.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            yield one.slice(0, cut)
            # Copied, so that what went out can be freed.
            held = pa.Table.from_batches([one.slice(cut).take(pa.array(np.arange(one.num_rows - cut)))]).to_batches()
            del one, key
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of every node's connected component, for nodes that have edges."""
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = edge_sum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a node points to the node's smallest neighbour (or itself).
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        large = settle(large)
        down = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        new = settle(small.where("a <> b").distinct())
        seen, was = edge_sum(new), seen
        for old in (edges, least, large, down):
            discard(old)
        edges = new
        if seen == was:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def edge_sum(edges: DataFrame) -> tuple[int, int | None]:
    """A number and a hash of a set of edges, the same for the same set."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id that is reachable)."""
    prints = settle(fingerprints(docs, id_col, text_col, width))
    codes = settle(prints.groupBy("code").agg(F.min("doc_id").alias("least_id")))
    edges = linked_edges(pigeonhole_shards(codes.select(F.col("code").alias("node"), "code"), radius), radius)
    roots = components(edges)  # of codes
    named = codes.join(roots.withColumnRenamed("node", "code"), "code", "left").select("code", "least_id", F.coalesce("root", "code").alias("root"))
    named = settle(named)
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_code = settle(named.join(least, "root").select("code", "component_id"))
    return prints.join(by_code, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, least_alike: float = LEAST_ALIKE) -> DataFrame:
    """doc_id and root, the smallest id of its component, of every text with near copies (but for the one with that id) of a Jaccard similarity of its shingles of least_alike or more. Rows without an id are not looked at.

    Fingerprints of such texts differ in up to some 18 bits, too many for blocks of bits to shard by. Here a text's shards are bands of its least shingle hashes; the BK-trees in the shards find the fingerprints within the radius, a sketch of the least hash in each of SKETCH ranges rules out clear misses, and the distinct shingle hashes of both texts decide. Only texts that share a band with another are sent, with these bands. Texts without words have no shards.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(order_key(F.col(id_col)).alias("node"), whole(text_col).alias("t"))
    return linked_texts(rows, width, radius, least_alike).select(F.col("node").alias("doc_id"), "root")


def linked_texts(rows: DataFrame, width: int, radius: int, least_alike: float) -> DataFrame:
    """node and root, the smallest node of its component, of the other nodes of near copies, from rows (node, t)."""
    odd = np.random.default_rng(SEED).integers(0, 2**63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @tidied
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, bands = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.unique(shingle_hashes(words(text), width))
                if not len(h):
                    continue
                ids.append(doc)
                least = [int((h * k).min()) for k in odd]
                bands.append([xxhash.xxh64_intdigest(f"{k} {least[2 * k]} {least[2 * k + 1]}") - (1 << 63) for k in range(BANDS)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["node", "bands"])

    @tidied
    def detailed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            codes, sketches, sets = [], [], []
            for text in b.column(1).to_pylist():
                h = shingle_hashes(words(text), width)
                codes.append(simhash(h))
                h = np.unique(h)
                place, at = np.unique((h >> np.uint64(56)).astype(np.int64), return_index=True)
                sketch = np.zeros(SKETCH, dtype=np.uint8)
                sketch[place] = h[at] % np.uint64(255) + np.uint64(1)
                sketches.append(sketch.tobytes())
                sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(codes, dtype=np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(sets, pa.binary())], ["node", "bands", "code", "sketch", "hashes"])

    places = settle(rows.mapInArrow(banded, "node long, bands array<long>").select("node", F.explode("bands").alias("shard")))
    met = places.groupBy("shard").count().where("count > 1").select("shard")
    shared = settle(places.join(met, "shard", "left_semi").groupBy("node").agg(F.collect_set("shard").alias("bands")))
    found = rows.where(F.length("t") > 0).join(checked_broadcast(shared, BROADCAST_IDS // 8), "node").select("node", "t", "bands")
    prints = settle(found.mapInArrow(detailed, "node long, bands array<long>, code long, sketch binary, hashes binary").withColumn("size", F.octet_length("hashes")))
    edges = linked_edges(prints.select(F.explode("bands").alias("shard"), "node", "code", "sketch", "hashes", "size"), radius, least_alike)
    return components(edges)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of every group of near copies: the one with the smallest id, the first of several with it, one without an id only where all are. Rows, not ids, are dropped."""
    rows, row_id, text = numbered(docs, id_col, text_col)
    linked = settle(linked_texts(rows.select(F.col("row").alias("node"), whole(text).alias("t")), WIDTH, RADIUS, LEAST_ALIKE))
    members = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    members = settle(rows.select(F.col("row").alias("node"), row_id.alias("id")).join(members, "node"))
    kept = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("k")).select(F.col("k.node").alias("node"))
    gone = settle(members.join(kept, "node", "left_anti").select(F.col("node").alias("row")))
    return rows.join(checked_broadcast(gone, BROADCAST_IDS), "row", "left_anti").drop("row").toDF(*docs.columns)
