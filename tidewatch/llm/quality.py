"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are fitted: one of target text (labelled good) and one of raw text (all documents). A text's log weight is the sum over its n-grams of the log ratio of the two; its score is the mean. The n-grams are single words and pairs of words, hashed into WORD_BUCKETS, and single and paired word shapes (case, digits, symbols, and whether a word repeats the one or two words before it), which have buckets of their own.

k documents are sampled without replacement by Gumbel top-k: key = score / TEMPERATURE + Gumbel noise of the row's id, and the k largest keys are selected. k is the number of documents whose score is at least the threshold that divides good and bad labelled documents best, so the noise decides near the threshold only, and documents that aren't selected are rejected.

Fitted on a bounded sample: of the labelled documents the LABELLED ones with the smallest hash of their id. Raw counts cover all documents, and every document gets its weight. The k-th largest key is found by counting rows in ever narrower ranges of keys, not by sorting.

Defined results: a null or empty text has no n-grams and score 0. Ids are whole numbers, or texts of them; others fail. A null id has the noise of id 0. Rows that share an id have the same noise; equal keys are all selected or all rejected, so a tie at the k-th place can select more than k rows. Labels that are null, or that contradict each other for one id, count as bad. Without both good and bad labelled documents nothing is rejected. An empty table gives an empty result. Other columns are not looked at by scores(), and kept by keep().
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, tidied, whole

WORD_BUCKETS = 10_000
SHAPES = 64
BUCKETS = WORD_BUCKETS + SHAPES + 3 * SHAPES * SHAPES
#: Labelled documents that the models and the threshold are fitted on, at most.
LABELLED = 20_000
#: Words whose hash and shape a worker keeps.
KNOWN = 100_000
TEMPERATURE = 0.02
SEED = 20_260


def shape(word: str) -> int:
    """Six bits: upper-case start, all upper case, a digit, and what the word ends with (0 letter or digit, 1 sentence mark, 2 exclamation mark, 3 other) or that it has no letter or digit (plus 4)."""
    letters = [c for c in word if c.isalpha()]
    last = word[-1]
    end = 0 if last.isalnum() else 1 if last in ".,;:?)\"'" else 2 if last == "!" else 3
    return bool(letters and letters[0].isupper()) + 2 * (len(letters) > 1 and word.upper() == word) + 4 * any(c.isdigit() for c in word) + 8 * (end + 4 * (not any(c.isalnum() for c in word)))


class WordFeatures(dict):
    """Of every word met: its number, and under it its hash and shape."""

    def __init__(self):
        super().__init__()
        self.hash, self.shape = array("Q"), array("q")

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.hash.append(xxhash.xxh64_intdigest(word.lower(), SEED))
        self.shape.append(shape(word.decode()))
        return n


def ngrams(texts: list[list[bytes]], known: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the texts' n-grams, repeats included, and the place of each one's text."""
    if len(known) > KNOWN:
        known.clear()
        known.hash, known.shape = array("Q"), array("q")
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    number = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    h, s = np.frombuffer(known.hash, dtype=np.uint64)[number] if len(number) else np.empty(0, np.uint64), np.frombuffer(known.shape, dtype=np.int64)[number] if len(number) else np.empty(0, np.int64)
    again = np.zeros(len(number), dtype=np.int64)
    again[2:][(number[2:] == number[:-2]) & (text[2:] == text[:-2])] = 1
    inner = text[1:] == text[:-1]
    again[1:][(number[1:] == number[:-1]) & inner] = 2
    pair = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) % np.uint64(WORD_BUCKETS))[inner]
    shapes = (WORD_BUCKETS + SHAPES + (again[1:] * SHAPES + s[:-1]) * SHAPES + s[1:])[inner]
    second = text[1:][inner]
    return np.concatenate(((h % np.uint64(WORD_BUCKETS)).astype(np.int64), pair.astype(np.int64), WORD_BUCKETS + s, shapes)), np.concatenate((text, second, text, second))


def labelled(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id and good of a bounded sample of labelled ids: small enough to broadcast."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0)) > 0).alias("good"))
    return F.broadcast(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def log_ratios(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """The log ratio of target to raw probability of every bucket."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("t")).join(sample, "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "t")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = WordFeatures(), np.zeros((2, BUCKETS), dtype=np.int64)
        for b in slices(batches):
            good = np.array(b.column(0).to_pylist(), dtype=bool)
            own, text = ngrams([t.encode().split() for t in b.column(1).to_pylist()], known)
            counts[0] += np.bincount(own, minlength=BUCKETS)
            counts[1] += np.bincount(own[good[text]], minlength=BUCKETS)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[0, some]), pa.array(counts[1, some])], ["bucket", "raw", "target"])

    counted = rows.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, a, b in counted:
        raw[bucket], target[bucket] = a, b
    out = np.zeros(BUCKETS)
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, WORD_BUCKETS + SHAPES), slice(WORD_BUCKETS + SHAPES, BUCKETS)):
        # One more count for each bucket that any text uses.
        used = raw[part] > 0
        p, q = target[part] + used, raw[part] + used
        out[part][used] = np.log(p[used] / max(p.sum(), 1)) - np.log(q[used] / max(q.sum(), 1))
    return out


def noise(doc_id: Column) -> Column:
    """Standard Gumbel noise, the same for the same id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(0)), F.lit(SEED)), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return -F.log(-F.log(uniform))


def weighed(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """docs with the columns n_ngrams, log_weight, score and key put last."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    at = docs.columns.index(text_col)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratio = WordFeatures(), shared.value
        for b in slices(batches):
            own, text = ngrams([(t or "").encode().split() for t in b.column(at).to_pylist()], known)
            n, total = np.bincount(text, minlength=b.num_rows), np.bincount(text, weights=ratio[own], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(total, pa.float64())], [f"c{k}" for k in range(b.num_columns + 2)])

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    kinds = ", ".join(f"{c} {t}" for c, t in plain.dtypes)
    out = plain.mapInArrow(run, f"{kinds}, c{len(docs.columns)} long, c{len(docs.columns) + 1} double")
    n, total = F.col(out.columns[-2]), F.col(out.columns[-1])
    score = F.when(n > 0, total / n).otherwise(0.0)
    own_id = F.col(f"c{docs.columns.index(id_col)}")
    return out.select("*", score.alias("score"), (score / TEMPERATURE + noise(own_id)).alias("key"))


def divide(good: list[float], bad: list[float]) -> float:
    """The score between the classes at which the mean of the two classes' accuracies is best; -inf if a class is empty."""
    if not good or not bad:
        return float("-inf")
    scores = np.concatenate((good, bad))
    own = np.concatenate((np.ones(len(good)), np.zeros(len(bad))))[np.argsort(scores, kind="stable")]
    scores = np.sort(scores)
    cut = np.flatnonzero(np.diff(scores) > 0) + 1
    if not len(cut):
        return float("-inf")
    below_good, below_bad = np.cumsum(own)[cut - 1], np.cumsum(1 - own)[cut - 1]
    gain = below_bad / len(bad) + (len(good) - below_good) / len(good)
    best = cut[gain >= gain.max() - 1e-12]
    best = best[np.argmax(scores[best] - scores[best - 1])]
    return float((scores[best - 1] + scores[best]) / 2)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the only column, by counting rows in ranges of it; -inf for k beyond the rows."""
    keys = keys.toDF("x")
    if k <= 0:
        return float("inf")
    low, high, n = keys.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if k >= n:
        return float("-inf")
    above = 0  # rows beyond the range
    while True:
        width = (high - low) / 4096
        inside = keys.where((F.col("x") >= low) & (F.col("x") <= high))
        if width <= 0 or low + width == low:
            return high
        bins = dict(inside.groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(4095)).alias("bin")).count().collect())
        for place in sorted(bins, reverse=True):
            if above + bins[place] >= k:
                break
            above += bins[place]
        if bins[place] <= 4096:
            own = inside.where(F.least(F.floor((F.col("x") - low) / width), F.lit(4095)) == place).collect()
            return sorted((r.x for r in own), reverse=True)[k - above - 1]
        low, high = inside.where(F.least(F.floor((F.col("x") - low) / width), F.lit(4095)) == place).agg(F.min("x"), F.max("x")).first()


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> tuple[np.ndarray, float]:
    """The log ratios and the dividing score."""
    sample = labelled(labels.select("doc_id", "quality"), most)
    ratios = log_ratios(docs, sample, id_col, text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).join(sample, "doc_id")
    scored = weighed(own, ratios, "doc_id", "t").select(F.col("c2").alias("good"), "score").collect()
    return ratios, divide([r.score for r in scored if r.good], [r.score for r in scored if not r.good])


def scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> tuple[DataFrame, np.ndarray, float]:
    """doc_id, n_ngrams, log_weight, score and key of all rows, written once; the log ratios; and the least key that is selected."""
    ratios, threshold = fit(docs, labels, id_col, text_col, most)
    all_of = settle(weighed(docs.select(id_col, text_col), ratios, id_col, text_col).select(F.col("c0").alias("doc_id"), F.col("c2").alias("n_ngrams"), F.col("c3").alias("log_weight"), "score", "key"))
    if threshold == float("-inf"):
        return all_of, ratios, threshold
    k = all_of.where(F.col("score") >= threshold).count()
    return all_of, ratios, kth_largest(all_of.select("key"), k)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED) -> DataFrame:
    """doc_id, n_ngrams, log_weight, score, key, selected."""
    all_of, _, least = scored(docs, labels, id_col, text_col, most)
    return all_of.withColumn("selected", F.col("key") >= least)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED) -> DataFrame:
    """The rows of docs that are selected, with their columns. Their keys are worked out again where the rows are, which spares a join of all texts."""
    _, ratios, least = scored(docs, labels, id_col, text_col, most)
    return weighed(docs, ratios, id_col, text_col).where(F.col("key") >= least).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
