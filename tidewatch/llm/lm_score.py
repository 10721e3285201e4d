r"""LM scoring with a log-frequency Bloom filter that holds quantised n-gram counts.

Tokens are words [^\x20\x09-\x0D]+ with A-Z lower-cased, then one end token for each text. The training texts are those whose crc32(id as text) mod 7 is not 2.

1. Exact unigram counts: every block of texts counts its own tokens, then a grouped sum.
2. Base score, exact: words with over a 65536th of all training tokens (fewer than 65536 words, whatever the corpus) are broadcast with their counts. A block's other words go, with the places of their texts, to the shard of their hash, meet the shard's counts there, and come back as sums for each text of the block.
3. The model: unigrams and bigrams of the training texts are counted by their 48-bit hashes in shards. A count c reaches the levels 1 to 1 + floor(log2 c); each level of a shard has a Bloom filter of BITS_PER_ENTRY bits for each n-gram that reaches it.
4. The filters of all shards are broadcast to the workers if they have max_filter_bytes or less, which is known before. Beyond that they stay where they are: a block sends each of its n-grams once to the filter of its shard and gets the levels back, and the scores are the same. The n-gram's level is the last of repeated membership probes that succeeds, and stands for the middle of its counts. Probabilities are p(w) = (c(w) + 1) / (N + V + 1) and p(w|h) = (c(hw) + SMOOTH p(w)) / (c(h) + SMOOTH).

Defined results: a null or empty text is one end token. A null id counts as the empty text in the split. Rows that share an id are each returned, and count as often as they stand. Without training tokens all counts are zero. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, whole, words

#: The end token: no word, as it is white space.
END = b"\n"
FOLDS, HELD_OUT = 7, 2
#: Tokens of a block, about.
BLOCK_TOKENS = 1_000_000
#: N-grams that are probed at a time.
STEP = 65_536
#: Words with more than this share of the training tokens are broadcast: fewer than 65536.
FREQUENT = 65_536
HASHES, BITS_PER_ENTRY = 4, 8
#: Shards of a small table's filters.
SHARDS_LEAST = 12
MAX_FILTER_BYTES = 256 << 20
#: Weight of the unigram probability, in tokens.
SMOOTH = 20.0
LEVELS = 48

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def tokens(text: str) -> list[bytes]:
    return [*words(text), END]


class Numbering(dict):
    """Numbers what it hasn't met yet."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def text_blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray, Numbering]]:
    """By blocks of about BLOCK_TOKENS: the rows without their texts, the texts' sizes, the number of every token's word, and the words by number, the end token's first. Texts become numbers one by one, so a block holds no text and each word once."""
    rows, parts, number, size = [], [], Numbering([(END, 0)]), 0
    for b in batches:
        others = [b.column(k) for k in range(b.num_columns) if k != column]
        for k, text in enumerate(b.column(column)):
            own = tokens(text.as_py())
            parts.append(np.fromiter(map(number.__getitem__, own), dtype=np.int32, count=len(own)))
            rows.append(tuple(c[k].as_py() for c in others))
            size += len(own)
            if size >= BLOCK_TOKENS:
                yield rows, np.array(list(map(len, parts))), np.concatenate(parts), number
                rows, parts, number, size = [], [], Numbering([(END, 0)]), 0
    if rows:
        yield rows, np.array(list(map(len, parts))), np.concatenate(parts), number


def unigram_counts(train: DataFrame) -> DataFrame:
    """word (binary) and c, from rows (t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, token, number in text_blocks(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.binary()), pa.array(np.bincount(token))], ["word", "c"])

    return train.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def base_scores(rows: DataFrame, counts: DataFrame, frequent: dict[bytes, int], shards: int) -> DataFrame:
    """key, n_tokens, n_known and logs, the sum of log10(c + 1) over the text's tokens, from rows (key, t) and all counts."""
    known = rows.sparkSession.sparkContext.broadcast({w: float(np.log10(c + 1)) for w, c in frequent.items()})
    names = ["shard", "block", "words", "lengths", "texts", "keys", "sizes", "known", "logs"]
    of_block = "block long, texts binary, keys binary, sizes binary, known binary, logs binary"
    bytes_of = lambda x, kind: x.astype(kind).tobytes()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, (ids, sizes, token, number) in enumerate(text_blocks(batches, 1)):
            block = part + k
            text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            every = list(number)
            log = np.array([known.value.get(w, np.nan) for w in every])
            rare = np.isnan(log)
            easy = ~rare[token]
            out = [(block % shards, block, None, None, None, bytes_of(np.array([i[0] for i in ids]), "<i8"), bytes_of(sizes, "<i4"), bytes_of(np.bincount(text[easy], minlength=len(sizes)), "<i4"), bytes_of(np.bincount(text[easy], weights=log[token[easy]], minlength=len(sizes)), "<f8"))]
            shard = np.array([zlib.crc32(w) % shards if r else -1 for w, r in zip(every, rare, strict=True)])
            rank = np.lexsort((np.arange(len(every)), shard))  # words by shard
            place = np.empty(len(every), dtype=np.int64)
            place[rank] = np.arange(len(every))
            hard = np.flatnonzero(~easy)
            hard = hard[np.argsort(place[token[hard]], kind="stable")]
            lengths = np.bincount(place[token[hard]], minlength=len(every))
            cut, upto = np.searchsorted(shard[rank], np.arange(shards + 1)), np.concatenate(([0], np.cumsum(lengths)))
            for s in range(shards):
                a, b = cut[s], cut[s + 1]
                if a < b:
                    out.append((s, block, b" ".join([every[j] for j in rank[a:b]]), bytes_of(lengths[a:b], "<i4"), bytes_of(text[hard[upto[a] : upto[b]]], "<i4"), None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 7], strict=True)], names)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        count = dict(zip(right.column("word").to_pylist(), right.column("c").to_pylist(), strict=True))
        out = []
        for r in left.to_pylist():
            if r["words"] is None:
                out.append((r["block"], None, r["keys"], r["sizes"], r["known"], r["logs"]))
                continue
            c = np.array([count.get(w, 0) for w in r["words"].split(b" ")])
            c = np.repeat(c, np.frombuffer(r["lengths"], dtype="<i4"))
            texts, at = np.unique(np.frombuffer(r["texts"], dtype="<i4"), return_inverse=True)
            out.append((r["block"], bytes_of(texts, "<i4"), None, None, bytes_of(np.bincount(at, weights=c > 0), "<i4"), bytes_of(np.bincount(at, weights=np.log10(c + 1.0)), "<f8")))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, [pa.int64(), *[pa.binary()] * 5], strict=True)], names=["block", "texts", "keys", "sizes", "known", "logs"])

    def total(group: pa.Table) -> pa.Table:
        parts = group.to_pylist()
        own = next(r for r in parts if r["texts"] is None)
        known_n, logs = np.frombuffer(own["known"], dtype="<i4").astype(np.int64), np.frombuffer(own["logs"], dtype="<f8").copy()
        for r in sorted((r for r in parts if r["texts"] is not None), key=lambda r: r["texts"] + r["logs"]):
            at = np.frombuffer(r["texts"], dtype="<i4")
            known_n[at] += np.frombuffer(r["known"], dtype="<i4")
            logs[at] += np.frombuffer(r["logs"], dtype="<f8")
        return pa.Table.from_arrays([pa.array(np.frombuffer(own["keys"], dtype="<i8")), pa.array(np.frombuffer(own["sizes"], dtype="<i4").astype(np.int64)), pa.array(known_n), pa.array(logs)], names=["key", "n_tokens", "n_known", "logs"])

    dealt = rows.select("key", "t").mapInArrow(deal, "shard int, block long, words binary, lengths binary, texts binary, keys binary, sizes binary, known binary, logs binary")
    by_shard = counts.select(F.pmod(F.crc32("word"), F.lit(shards)).cast("int").alias("shard"), "word", "c")
    met = dealt.groupBy("shard").cogroup(by_shard.groupBy("shard")).applyInArrow(meet, of_block)
    return met.groupBy("block").applyInArrow(total, "key long, n_tokens long, n_known long, logs double")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def ngram_hashes(token: np.ndarray, number: Numbering) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of the word before each token (the end token before the first); 48-bit hashes of the numbered words, and of every pair of a token and the one before it."""
    before = np.concatenate((np.zeros(1, token.dtype), token[:-1]))  # every text ends with the end token, number 0
    h = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in number), dtype=np.uint64, count=len(number))
    cut = np.uint64(16)
    return before, mixed(h * _A) >> cut, mixed((h * _A)[before] + mixed(h)[token]) >> cut


def filters(train: DataFrame, shards: int) -> DataFrame:
    """shard, level, entries and bits: the Bloom filters of the training texts' n-grams, from rows (t). A shard has the hashes of its range."""
    width = -(-(1 << 48) // shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, token, number in text_blocks(batches, 0):
            _, one, two = ngram_hashes(token, number)
            order = np.argsort(one)
            yield dealt(one[order], np.bincount(token)[order])
            yield dealt(*np.unique(two, return_counts=True))

    def dealt(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        cut = np.searchsorted(h, np.arange(shards + 1, dtype=np.uint64) * np.uint64(width))
        packed, c = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], c.astype("<u4")
        full = [s for s in range(shards) if cut[s] < cut[s + 1]]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([packed[cut[s] : cut[s + 1]].tobytes() for s in full], pa.binary()), pa.array([c[cut[s] : cut[s + 1]].tobytes() for s in full], pa.binary())], ["shard", "h", "c"])

    def build(group: pa.Table) -> pa.Table:
        six = np.frombuffer(b"".join(group.column("h").to_pylist()), dtype=np.uint8).reshape(-1, 6)
        h = np.zeros((len(six), 8), dtype=np.uint8)
        h[:, :6] = six
        h = h.view("<u8").ravel()
        c = np.frombuffer(b"".join(group.column("c").to_pylist()), dtype="<u4").astype(np.uint64)
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        h, c = h[first], np.add.reduceat(c, first)
        level = 1 + np.floor(np.log2(c)).astype(int)
        out = []
        for k in range(1, level.max() + 1):
            own = h[level >= k]
            bits = np.zeros(-(-len(own) * BITS_PER_ENTRY // 8), dtype=np.uint8)
            at, step = steps(own, k)
            for j in range(HASHES):
                p = place(at + np.uint64(j) * step, np.uint64(len(bits) * 8))
                np.bitwise_or.at(bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
            out.append((int(group.column("shard")[0].as_py()), k, len(own), bits.tobytes()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32(), pa.int32(), pa.int64(), pa.binary()], strict=True)], names=["shard", "level", "entries", "bits"])

    return train.mapInArrow(deal, "shard int, h binary, c binary").groupBy("shard").applyInArrow(build, "shard int, level int, entries long, bits binary")


def steps(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each n-gram's probes at a level start, and how far apart they are."""
    a = mixed(h + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    return a, mixed(a) | np.uint64(1)


def place(at: np.ndarray, bits: np.ndarray | np.uint64) -> np.ndarray:
    """A probe's bit in a filter of `bits` bits, fewer than 2**32."""
    return (((at >> np.uint64(32)) * bits) >> np.uint64(32)).astype(np.int64)


class LogFrequencyFilter:
    """The filters of all shards, or of some, and of all levels; level() probes them."""

    def __init__(self, rows: list[tuple[int, int, bytes]], shards: int):
        self.width = -(-(1 << 48) // shards)
        self.of_level = {}
        for level in sorted({r[1] for r in rows}):
            own = {r[0]: r[2] for r in rows if r[1] == level}
            size = np.array([len(own.get(s, b"")) for s in range(shards)], dtype=np.int64)
            self.of_level[level] = (np.frombuffer(b"".join(own.get(s, b"") for s in range(shards)), dtype=np.uint8), np.cumsum(size) - size, (size * 8).astype(np.uint64))

    def level(self, h: np.ndarray) -> np.ndarray:
        """The last level of each n-gram that a probe finds; 0 if the first has none."""
        out, left = np.zeros(len(h), dtype=np.int64), np.arange(len(h))
        k = 1
        while len(left) and k in self.of_level:
            bits, start, size = self.of_level[k]
            shard = (h[left] // np.uint64(self.width)).astype(np.int64)
            some = size[shard] > 0
            left, shard = left[some], shard[some]
            base, room = start[shard] * 8, size[shard]
            at, step = steps(h[left], k)
            for _ in range(HASHES):
                p = place(at, room) + base
                there = (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
                left, base, room, step = left[there], base[there], room[there], step[there]
                at = at[there] + step
            out[left] = k
            k += 1
        return out


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of 2^(k-1) .. 2^k - 1."""
    return np.where(level > 0, (3 * 2.0 ** (level - 1.0) - 1) / 2, 0.0)


def text_scores(sizes: np.ndarray, c_one: np.ndarray, c_before: np.ndarray, c_two: np.ndarray, n: int, v: int) -> np.ndarray:
    """The log10 probability of each text, from the counts of its tokens, of those before them and of both."""
    p = (c_one + 1) / (n + v + 1)
    c_two = np.where((c_one > 0) & (c_before > 0), c_two, 0.0)  # no bigram without its words
    log = np.log10((np.minimum(c_two, c_before) + SMOOTH * p) / (c_before + SMOOTH))
    return np.add.reduceat(log, np.cumsum(sizes) - sizes)


def model_scores(rows: DataFrame, model: LogFrequencyFilter, n: int, v: int) -> DataFrame:
    """key and score, the model's log10 probability of the text, of rows (key, t), with the filters broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lf = shared.value
        for ids, sizes, token, number in text_blocks(batches, 1):
            before, one, two = ngram_hashes(token, number)
            c = middle(lf.level(one))
            c_two = np.zeros(len(token))
            for k in range(0, len(token), STEP):
                at = slice(k, k + STEP)
                both = (c[token[at]] > 0) & (c[before[at]] > 0)
                c_two[at][both] = middle(lf.level(two[at][both]))
            yield scored(np.array([i[0] for i in ids]), text_scores(sizes, c[token], c[before], c_two, n, v))

    return rows.select("key", "t").mapInArrow(run, "key long, score double")


def scored(keys: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(score, pa.float64())], ["key", "score"])


def routed_scores(rows: DataFrame, built: DataFrame, shards: int, n: int, v: int) -> DataFrame:
    """What model_scores() gives, with the filters left in their shards: a block sends each n-gram once to its shard."""
    width = np.uint64(-(-(1 << 48) // shards))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    names = ["shard", "block", "h", "places", "keys", "sizes", "tokens"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, (ids, sizes, token, number) in enumerate(text_blocks(batches, 1)):
            before, one, two = ngram_hashes(token, number)
            pairs, of_pair = np.unique(two, return_inverse=True)
            h = np.concatenate((one, pairs))
            out = [((part + k) % shards, part + k, None, None, np.array([i[0] for i in ids]).astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), np.concatenate((token, before, of_pair + len(one))).astype("<i4").tobytes())]
            shard = (h // width).astype(np.int64)
            rank = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[rank], np.arange(shards + 1))
            for s in np.flatnonzero(cut[:-1] < cut[1:]):
                at = rank[cut[s] : cut[s + 1]]
                out.append((int(s), part + k, h[at].astype("<u8").tobytes(), at.astype("<i4").tobytes(), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        lf = LogFrequencyFilter([(r["shard"], r["level"], r["bits"]) for r in right.to_pylist()], shards)
        out = [(r["block"], None if r["h"] is None else lf.level(np.frombuffer(r["h"], dtype="<u8")).astype(np.uint8).tobytes(), r["places"], r["keys"], r["sizes"], r["tokens"]) for r in left.to_pylist()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds[1:], strict=True)], names=["block", "levels", *names[3:]])

    def total(group: pa.Table) -> pa.Table:
        parts = group.to_pylist()
        own = next(r for r in parts if r["keys"] is not None)
        places = [np.frombuffer(r["places"], dtype="<i4") for r in parts if r["places"] is not None]
        level = np.zeros(1 + max(int(p.max()) for p in places))
        for r, at in zip([r for r in parts if r["places"] is not None], places, strict=True):
            level[at] = np.frombuffer(r["levels"], dtype=np.uint8)
        c_one, c_before, c_two = (middle(level)[x] for x in np.frombuffer(own["tokens"], dtype="<i4").reshape(3, -1))
        return pa.Table.from_batches([scored(np.frombuffer(own["keys"], dtype="<i8"), text_scores(np.frombuffer(own["sizes"], dtype="<i4").astype(np.int64), c_one, c_before, c_two, n, v))])

    dealt = rows.select("key", "t").mapInArrow(deal, "shard int, block long, h binary, places binary, keys binary, sizes binary, tokens binary")
    met = dealt.groupBy("shard").cogroup(built.select("shard", "level", "bits").groupBy("shard")).applyInArrow(meet, "block long, levels binary, places binary, keys binary, sizes binary, tokens binary")
    return met.groupBy("block").applyInArrow(total, "key long, score double")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES, frequent_share: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), whole(text_col).alias("t"))
    rows = settle(rows.withColumn("key", F.monotonically_increasing_id()))  # so that every step sees the same keys
    train = rows.where(~F.col("held_out")).select("t")
    counts = settle(unigram_counts(train))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = {bytes(r.word): r.c for r in counts.where(F.col("c") * frequent_share > n).collect()}
    # Of the table alone, as false finds depend on the filters' sizes: the same scores on every cluster.
    shards = max(SHARDS_LEAST, -(-v // 200_000), -(-n // 2_000_000))
    base = base_scores(rows, counts, frequent, shards)
    built = settle(filters(train, shards))
    size = built.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    if size <= max_filter_bytes:
        held = [(r.shard, r.level, bytes(r.bits)) for r in built.select("shard", "level", "bits").toLocalIterator()]
        model = model_scores(rows, LogFrequencyFilter(held, shards), n, v)
    else:
        model = routed_scores(rows, built, shards, n, v)
    model = rows.select("key", "doc_id", "held_out").join(model, "key")
    all_of = model.join(base, "key")
    one = float(np.log10(n + v + 1))
    return all_of.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(one)).alias("base_score"), "score")
