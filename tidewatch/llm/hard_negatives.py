r"""Hard negatives: for every anchor and each of its nearest rows of the same label, the highest-scoring rows of other labels within a window below that positive's score.

Vectors become whole numbers, floor(scale x), and a score is an integer inner product, so results are exact and ties are settled by id. The index is a product quantiser: components are cut into subspaces of `width`, each with up to 256 centroids fitted on a bounded sample (SAMPLE rows with the least hashes of their ids; the fits of the subspaces are tasks of their own). Of every row it holds a byte per subspace, the norm of what the centroids leave over, rounded up, and the vector itself.

For an anchor a and a row x = q(x) + r(x), <a, q(x)> is a sum of table lookups, and |<a, r(x)>| <= |a| |r(x)|. Rows whose upper bound is under what is needed are passed over; that drops none that belongs to the result, whatever the codebook is like. The others' exact products decide.

Two passes over the index for each block of BLOCK anchors, which are the query set that is held against all rows: the first finds the positives, the second fills the windows. Every task keeps at most so many rows per anchor (and window), which serve as thresholds for its next batches, and Spark takes the best of the tasks'. Rows are dealt out by id, so a label with a third of them makes no large task. Bounds: what is broadcast is a block of anchors with their windows and the codebooks; a task holds that and a batch of BATCH rows.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, or with one of 2^22 or more in size after scaling (so that sums stay exact) take no part. Vectors of different lengths are compared as if the shorter had zeros at its end. Of rows with one id, the one with the least label and then the least vector takes part. An anchor with no other row of its label, or a window without rows, gives no rows; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, slices

BLOCK, BATCH = 4096, 4096
SAMPLE, CENTROIDS, ROUNDS, WIDTH = 8192, 256, 8, 2
LARGEST = 1 << 22

FOUND = "anchor_id long, positive_id long, positive_score long, other_id long, score long"


def whole_numbers(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, label, v: one row per id, with the vector as whole numbers."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)))  # NaN is larger than all numbers
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(good)
    out = out.select("id", F.struct("label", F.transform("v", lambda x: F.floor(x).cast("int")).alias("v")).alias("row"))
    return out.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")


def centroids(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows in order of their first components; the same for the same rows in any order."""
    x = np.unique(x, axis=0).astype(np.float64) if len(x) else np.zeros((1, x.shape[1]))
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def codebooks(rows: DataFrame, size: int, width: int) -> np.ndarray:
    """parts x CENTROIDS x width: each subspace's centroids, by a task for each subspace."""
    parts = -(-size // width)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    cut = sample.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * width + 1, F.lit(width)))).alias("part", "x"))

    def fit(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        c = centroids(np.array([[*x, *[0] * (width - len(x))] for x in own["x"]], dtype=np.int64), CENTROIDS, ROUNDS)
        c = np.concatenate([c, np.repeat(c[-1:], CENTROIDS - len(c), 0)])
        return pd.DataFrame({"part": [key[0]], "c": [c.ravel().tolist()]})

    out = np.zeros((parts, CENTROIDS, width))
    for r in cut.groupBy("part").applyInPandas(fit, "part int, c array<double>").collect():
        out[r["part"]] = np.array(r["c"]).reshape(CENTROIDS, width)
    return out


def padded(v: pa.Array, size: int) -> np.ndarray:
    """Rows of `size` whole numbers from a list column."""
    lengths = v.value_lengths().to_numpy()
    out = np.zeros((len(v), size), dtype=np.int64)
    out[np.arange(size) < lengths[:, None]] = v.flatten().to_numpy()
    return out


def indexed(rows: DataFrame, books: np.ndarray, size: int) -> DataFrame:
    """id, label, x (the numbers as 4 bytes each), codes (a byte per subspace), rest (the norm of the residual, rounded up)."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BATCH):
            x = padded(b.column(2), size)
            wide = np.pad(x, ((0, 0), (0, parts * width - size))).astype(np.float64)
            codes, rest = np.empty((len(x), parts), dtype=np.uint8), np.zeros(len(x))
            for p in range(parts):
                own = wide[:, p * width : (p + 1) * width]
                codes[:, p] = (own @ books[p].T - (books[p] ** 2).sum(1) / 2).argmax(1)
                rest += ((own - books[p][codes[:, p]]) ** 2).sum(1)
            up = np.sqrt(rest) * (1 + 1e-9) + 1e-6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(up)], ["id", "label", "x", "codes", "rest"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("id", "label", "v").mapInArrow(run, f"id long, label {kind}, x binary, codes binary, rest double")


class Best:
    """The best `most` (score, id) so far, highest score first, then smallest id."""

    def __init__(self, most: int):
        self.most, self.score, self.id = most, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score):
            score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
            order = np.lexsort((ids, -score))[: self.most]
            self.score, self.id = score[order], ids[order]

    def least(self) -> float:
        """What a row needs to come in."""
        return float(self.score[-1]) if len(self.score) == self.most else -np.inf


def enough(low: np.ndarray, most: int) -> float:
    """A score that `most` rows reach for certain, by their lower bounds."""
    return float(np.partition(low, len(low) - most)[len(low) - most]) if len(low) >= most else -np.inf


def searched(index: DataFrame, block: list, books: np.ndarray, size: int, most: int, windows: dict[int, list] | None = None, low: int = 0, high: int = 0) -> DataFrame:
    """Rows of FOUND, of each task the best `most` for every anchor (id, label, x) of the block: of its own label, or, with windows (anchor -> [(positive, score)]), of other labels within low to high hundredths of each positive's score."""
    parts, _, width = books.shape
    sent = index.sparkSession.sparkContext.broadcast((block, books, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, books, windows = sent.value
        wide = [np.frombuffer(x, np.int32).astype(np.int64) for _, _, x in anchors]
        norms = [float(np.sqrt((a.astype(np.float64) ** 2).sum())) * (1 + 1e-9) for a in wide]
        heads = [np.pad(a, (0, parts * width - size)).reshape(parts, width, 1).astype(np.float64) for a in wide]
        best = {(a, p): Best(most) for a, _, _ in anchors for p, _ in (windows[a] if windows is not None else [(None, 0)])}
        bounds = {a: [(p, -(-low * s // 100), high * s // 100) for p, s in windows[a]] for a, _, _ in anchors} if windows is not None else {}
        for b in slices(batches, BATCH):
            ids, labels, rest = b.column(0).to_numpy(), np.array(b.column(1).to_pylist()), b.column(4).to_numpy()
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int32).reshape(len(ids), size)
            cells = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(ids), parts).T.astype(np.intp) + np.arange(parts)[:, None] * CENTROIDS
            own = {v: np.nonzero(labels == v)[0] for v in set(labels.tolist())}
            other = {v: np.nonzero(labels != v)[0] for v in {label for _, label, _ in anchors}} if windows is not None else {}
            for k, (a, label, _) in enumerate(anchors):
                at = own.get(label) if windows is None else other[label] if bounds[a] else None
                if at is None or not len(at):
                    continue
                table = (books @ heads[k]).reshape(-1)
                about = table[cells[:, at]].sum(0)
                off = norms[k] * rest[at] + 1 + 1e-9 * np.abs(about)
                if windows is None:
                    at, about, off = at[ids[at] != a], about[ids[at] != a], off[ids[at] != a]
                    got = best[a, None]
                    may = np.nonzero(about + off >= max(got.least(), enough(about - off, most)))[0]
                    got.add((x[at[may]].astype(np.int64) * wide[k]).sum(1), ids[at[may]])
                    continue
                up, down, asked = about + off, about - off, []
                for p, bottom, top in bounds[a]:
                    needed = max(best[a, p].least(), bottom)
                    if needed <= top:
                        inside = down[(down >= bottom) & (up <= top)]
                        asked.append((p, bottom, top, (up >= max(needed, enough(inside, most))) & (down <= top)))
                if asked:
                    may = np.nonzero(reduce(np.logical_or, [m for *_, m in asked]))[0]
                    score, names = (x[at[may]].astype(np.int64) * wide[k]).sum(1), ids[at[may]]
                    for p, bottom, top, _ in asked:
                        fits = (score >= bottom) & (score <= top)
                        best[a, p].add(score[fits], names[fits])
        told = [(a, p, s, i, v) for a, _, _ in anchors for p, s in (windows[a] if windows is not None else [(None, None)]) for i, v in zip(best[a, p].id.tolist(), best[a, p].score.tolist())]
        for k in range(0, len(told), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told[k : k + 65_536])], ["anchor_id", "positive_id", "positive_score", "other_id", "score"])

    return index.mapInArrow(run, FOUND)


def top(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best of the tasks' rows for each key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, width: int = WIDTH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: a condition on the id, as the column `id`; low and high: the window in hundredths of the positive's score."""
    spark = rows.sparkSession
    numbers = settle(whole_numbers(rows, id_col, label_col, vector_col, scale))
    size = max(numbers.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    books = codebooks(numbers, size, width)
    index = settle(indexed(numbers, books, size))
    anchors = index.where(anchor).select("id", "label", "x")
    blocks = max(1, -(-anchors.count() // BLOCK))
    done = []
    for k in range(blocks):
        block = [tuple(r) for r in anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()]
        near = top(searched(index, block, books, size, positives), ["anchor_id"], positives).select("anchor_id", "other_id", "score")
        windows: dict[int, list] = {a: [] for a, _, _ in block}
        for a, p, s in near.collect():
            windows[a].append((p, s))
        out = top(searched(index, block, books, size, negatives, windows, low, high), ["anchor_id", "positive_id"], negatives)
        done.append(settle(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    return reduce(DataFrame.unionByName, done)
