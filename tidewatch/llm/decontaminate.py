"""Benchmark decontamination: a BM25 inverted index of the test items, searched by every passage of every document with block-max WAND.

Items are indexed by their words (lower-cased). A posting's impact is its BM25 weight divided by the item's score for its own text, so a passage's score is the share of the item that it matches, and one threshold serves all items. Every document is cut into passages that overlap by the longest item, so an item that stands in a text stands whole in a passage. All items at or above THRESHOLD are retrieved, and a hit is verified by the shingles of the item's question and of its answer that the passage holds (five words, fewer for a short side): both overlaps must reach OVERLAP. The answer is the item's last sentence if that has three words and at most half of the item, else its last third.

Before a passage is searched by WAND, a dense pre-scan of its rare terms is made: terms that together can't bring any item to half the threshold are set apart, and the rest of the score must come from the other, rare terms, whose postings are added up over all items. A passage whose rare terms can't do so for any item is passed over; none that could reach the threshold is lost.

An index of ITEMS items and ITEM_BYTES of text at most is broadcast; larger benchmarks are searched in blocks, whose indexes are built one at a time. The numbers of items and of items with a term, and the mean length, are those of the whole benchmark, so blocks don't change a score.

Defined results: null or empty texts and items match nothing. Items of fewer than LEAST_WORDS words are found as whole runs of words, with score 1; those of fewer than SHORTEST are no evidence. An item that stands in a document more than once is reported once, by its best and first passage. Rows that share an id are each searched; equal result rows stay. Empty tables give an empty result. Other columns are not looked at by hits(), and kept by keep().
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, tidied, whole

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.5, 0.5
SHINGLE, LEAST_WORDS, SHORTEST = 5, 8, 3
#: Postings of a block; items of an index that is broadcast, and bytes of their texts.
POSTINGS, ITEMS, ITEM_BYTES = 16, 50_000, 32 << 20
_END = 1 << 60


def words(text: str) -> list[str]:
    """Words in lower case, accented letters too."""
    return text.lower().split()


def shingles(w: list[str], width: int) -> set[tuple[str, ...]]:
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def width_for(w: list[str]) -> int:
    """Five words, or half of a side that has fewer than ten, so that one changed word doesn't break all its shingles."""
    return min(SHINGLE, max(1, len(w) // 2))


def overlap(side: list[str], passage: list[str]) -> float:
    """The share of the side's shingles that the passage holds; 1 for an empty side."""
    own = shingles(side, width_for(side))
    return len(own & shingles(passage, width_for(side))) / len(own) if own else 1.0


def parted(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    w = words(text)
    ends, n = [], 0
    for line in text.split("\n"):
        for word in words(line):
            n += 1
            if word[-1] in ".?!":
                ends.append(n)
        ends.append(n)
    start = max((e for e in ends if e < len(w)), default=0)
    if not (3 <= len(w) - start <= len(w) / 2):
        start = len(w) - max(1, len(w) // 3)
    return w[:start], w[start:]


class Statistics(NamedTuple):
    """Of the whole benchmark: items that are indexed, their mean and largest length, and how many of them have a term."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]


class Index:
    """Postings by term, in blocks with their largest impact."""

    def __init__(self, items: list[tuple[int, str]], of_all: Statistics | None = None):
        self.short: dict[str, list[tuple[list[str], int]]] = {}
        for i, text in items:
            if SHORTEST <= len(w := words(text)) < LEAST_WORDS:
                self.short.setdefault(w[0], []).append((w, i))
        kept = [(i, w, text) for i, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])) if len(w := words(text)) >= LEAST_WORDS]
        self.item = [i for i, _, _ in kept]
        self.sides = [parted(text) for _, _, text in kept]
        own_df = Counter(t for _, w, _ in kept for t in set(w))
        self.term = {t: k for k, t in enumerate(sorted(own_df))}
        n_items, mean, self.longest, df = of_all or Statistics(len(kept), sum(len(w) for _, w, _ in kept) / max(1, len(kept)), max((len(w) for _, w, _ in kept), default=0), own_df)
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for n, (_, w, _) in enumerate(kept):
            tf = Counter(w)
            weight = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in tf.items()}
            own = sum(weight.values())
            for t, x in weight.items():
                postings[self.term[t]].append((n, x / own))
        self.docs = [np.array([n for n, _ in p], dtype=np.int64) for p in postings]
        self.impacts = [np.array([x for _, x in p]) for p in postings]
        self.most = np.array([p.max() for p in self.impacts]) if postings else np.empty(0)
        self.blocks = [np.array([x[k : k + POSTINGS].max() for k in range(0, len(x), POSTINGS)]) for x in self.impacts]
        # Common terms, by falling frequency, as long as they bring no item to half the threshold.
        self.rare = np.ones(len(postings) + 1, dtype=bool)
        self.rare[-1] = False  # stands for words of no item
        self.common = np.zeros(len(kept))
        for t in sorted(range(len(postings)), key=lambda t: -len(self.docs[t])):
            if (self.common[self.docs[t]] + self.impacts[t] >= THRESHOLD / 2).any():
                break
            self.common[self.docs[t]] += self.impacts[t]
            self.rare[t] = False

    def may_reach(self, terms: np.ndarray) -> bool:
        """False if no item can reach the threshold with these distinct rare terms and any common ones."""
        total = np.bincount(np.concatenate([self.docs[t] for t in terms]), weights=np.concatenate([self.impacts[t] for t in terms]), minlength=len(self.item))
        return bool((total + self.common >= THRESHOLD - 1e-9).any())

    def search(self, terms: list[int], least: float = THRESHOLD) -> list[tuple[int, float]]:
        """(item's place, score) of all items that score at least `least` for these distinct terms: block-max WAND."""
        docs, impacts, blocks = ([x[t] for t in terms] for x in (self.docs, self.impacts, self.blocks))
        most = [float(self.most[t]) for t in terms]
        at = [0] * len(terms)
        here = lambda k: int(docs[k][at[k]]) if at[k] < len(docs[k]) else _END
        out, low = [], least - 1e-9
        order = list(range(len(terms)))
        while True:
            order.sort(key=here)
            bound, pivot = 0.0, None
            for n, k in enumerate(order):
                if here(k) == _END:
                    break
                bound += most[k]
                if bound >= low:
                    pivot = n
                    break
            if pivot is None:
                return out
            target = here(order[pivot])
            while pivot + 1 < len(order) and here(order[pivot + 1]) == target:
                pivot += 1
            block_bound, next_start = 0.0, here(order[pivot + 1]) if pivot + 1 < len(order) else _END
            for k in order[: pivot + 1]:  # shallow move to the target's block
                p = int(np.searchsorted(docs[k], target, "left"))
                if p < len(docs[k]):
                    block = p // POSTINGS
                    block_bound += float(blocks[k][block])
                    after = (block + 1) * POSTINGS
                    next_start = min(next_start, int(docs[k][after]) if after < len(docs[k]) else _END)
            if block_bound < low:  # nothing before the next block, or the next term, can reach it
                target = max(next_start, target + 1)
                for k in order[: pivot + 1]:
                    at[k] = int(np.searchsorted(docs[k], target, "left"))
                continue
            if here(order[0]) == target:
                score = sum(float(impacts[k][at[k]]) for k in order[: pivot + 1])
                if score >= low:
                    out.append((target, score))
                for k in order[: pivot + 1]:
                    at[k] += 1
            else:
                for k in order[: pivot + 1]:
                    if here(k) < target:
                        at[k] = int(np.searchsorted(docs[k], target, "left"))

    def hits(self, text: str) -> list[tuple[int, float, int, float, float]]:
        """(item_id, score, first word of the passage, question's overlap, answer's overlap) of the verified items of a text."""
        w = words(text)
        return self.short_hits(w) + (self.long_hits(w) if w and self.item else [])

    def short_hits(self, w: list[str]) -> list[tuple[int, float, int, float, float]]:
        found: dict[int, tuple[int, float, int, float, float]] = {}
        for k, word in enumerate(w if self.short else []):
            for run, i in self.short.get(word, ()):
                if w[k : k + len(run)] == run:
                    found.setdefault(i, (i, 1.0, k, 1.0, 1.0))
        return list(found.values())

    def long_hits(self, w: list[str]) -> list[tuple[int, float, int, float, float]]:
        none = len(self.term)
        term = np.fromiter(map(self.term.get, w, [none] * len(w)), dtype=np.int64, count=len(w))
        rare = np.flatnonzero(self.rare[term])
        if not len(rare) or not self.may_reach(np.unique(term[rare])):
            return []
        size, step = 2 * self.longest, self.longest
        best: dict[int, tuple[float, int, float, float]] = {}
        for start in range(0, max(1, len(w) - self.longest), step):
            a, b = np.searchsorted(rare, (start, start + size))
            if a == b or not self.may_reach(np.unique(term[rare[a:b]])):
                continue
            own = np.unique(term[start : start + size])
            for n, score in self.search([int(t) for t in own if t != none]):
                question, answer = (overlap(side, w[start : start + size]) for side in self.sides[n])
                if question >= OVERLAP and answer >= OVERLAP and score > best.get(n, (0.0,))[0] + 1e-12:
                    best[n] = (score, start, question, answer)
        return [(self.item[n], *best[n]) for n in sorted(best)]


def indexes(items: DataFrame, most: int = ITEMS) -> Iterator[Index]:
    """One index, or one after the other for blocks of about `most` items or ITEM_BYTES."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), whole("text").alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // most), -(-size // ITEM_BYTES))
    if blocks == 1:
        yield Index([(r.item_id, r.text) for r in rows.collect()])
        return

    @tidied
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [(k, len(w), t) for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if len(w := words(text)) >= LEAST_WORDS for t in [None, *sorted(set(w))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True) if own else [[]] * 3, [pa.int32(), pa.int64(), pa.string()], strict=True)], ["block", "length", "term"])

    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    found = settle(rows.select("block", "text").mapInArrow(terms, "block int, length long, term string"))
    kept, total, longest = found.where("term is null").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.max("length"), F.lit(0))).first()
    df = settle(found.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    for k in range(blocks):
        own = found.where((F.col("block") == k) & F.col("term").isNotNull()).select("term").distinct()
        of_all = Statistics(kept, total / max(1, kept), longest, {r.term: r.df for r in df.join(own, "term").collect()})
        yield Index([(r.item_id, r.text) for r in rows.where(F.col("block") == k).select("item_id", "text").collect()], of_all)


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = ITEMS) -> DataFrame:
    """doc_id, item_id, score, start, question_overlap, answer_overlap of every verified item of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]

    def search(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                found = [(k, *h) for k, t in enumerate(b.column(1)) for h in shared.value.hits(t.as_py())]
                cols = list(zip(*found, strict=True)) if found else [[]] * 6
                kinds = [pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], ["doc_id", "item_id", "score", "start", "question_overlap", "answer_overlap"])

        return rows.mapInArrow(run, f"doc_id {kind}, item_id long, score double, start int, question_overlap double, answer_overlap double")

    return reduce(DataFrame.unionByName, map(search, indexes(items, most)))


def keep(docs: DataFrame, items: DataFrame, text_col: str = "text", most: int = ITEMS) -> DataFrame:
    """The rows of docs that hold no item, with their columns."""
    at = docs.columns.index(text_col)
    out = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    for index in indexes(items, most):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @tidied
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield b.filter(pa.array([not shared.value.hits(t.as_py() or "") for t in b.column(at)], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out.toDF(*docs.columns)
