import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import hard_negatives as hn

ROWS = "vec_id long, label int, embedding array<float>, id int, v string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2) for r in rows], ROWS)


def brute(rows, anchor, most=5):
    good = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) or abs(x * 256) >= hn.LARGEST for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        good[i] = min(good.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, (label, v) in good.items():
        if not anchor(a):
            continue
        all_ = sorted(((-score(v, w), i, own) for i, (own, w) in good.items() if i != a))
        for p, ps in [(i, -s) for s, i, own in all_ if own == label][:most]:
            inside = [(i, -s) for s, i, own in all_ if own != label and 80 * ps <= -100 * s <= 100 * ps][:most]
            out |= {(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(inside)}
    return out


def rows_of(seed, n, size=7, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, size))
    labels = rng.integers(0, 4, n)
    return [(int(k), int(labels[k]), (centres[labels[k]] * spread + rng.normal(size=size)).tolist()) for k in rng.permutation(n * 2)[:n] % n]


def mined(spark, rows, **more):
    got = hn.hard_negatives(frame(spark, rows).repartition(5), F.col("id") % 10 == 0, **more)
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("block,batch,sample", [(4096, 4096, 8192), (7, 16, 20)])
def test_equal_to_all_products(spark, monkeypatch, block, batch, sample):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "BATCH", batch)
    monkeypatch.setattr(hn, "SAMPLE", sample)  # poor codebooks cost time and no result
    rows = rows_of(1, 300)
    rows += [(k + 1000, 1, rows[0][2]) for k in range(40)]  # many ties
    rows += [(1, None, [1.0] * 7), (2000, 1, None), (2010, 2, [1.0, None, 1.0]), (2020, 2, [float("nan")] * 7), (2030, 2, [float("inf")] * 7), (2040, 3, [1e30] * 7), (None, 1, [1.0] * 7), (2050, 1, []), (2060, 2, [0.0] * 7), (2070, 1, [1.0, 2.0]), (2080, 9, [1.0] * 7), rows[5], (rows[5][0], 3, [0.5] * 7), (2090, 1, [-x for x in rows[0][2]])]
    got = mined(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows, lambda a: a % 10 == 0) and len(got) > 300


def test_few_rows_and_text_labels(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])]) == [(0, 1, 1, 2, 65536, 58880)]
    docs = spark.createDataFrame([(0, "a", [1.0]), (1, "a", [1.0]), (2, "b", [0.9])], "vec_id long, label string, embedding array<double>")
    assert hn.hard_negatives(docs, F.col("id") == 0).count() == 1


def test_bounds_hold_and_pass_over_most_rows():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(4000, 64)) * 32).astype(np.int64)
    books = np.stack([hn.centroids(x[:2000, p * 2 : p * 2 + 2], 256, 8) for p in range(32)])
    parts = x.reshape(4000, 32, 2)
    codes = np.stack([((parts[:, p].astype(float) @ books[p].T) - (books[p] ** 2).sum(1) / 2).argmax(1) for p in range(32)], 1)
    q = np.stack([books[p][codes[:, p]] for p in range(32)], 1).reshape(4000, 64)
    rest = np.sqrt(((x - q) ** 2).sum(1))
    exact, about = x[0] @ x.T, x[0] @ q.T
    off = np.sqrt((x[0] ** 2).sum()) * rest + 1
    assert (abs(exact - about) <= off).all()
    assert ((about + off) >= np.sort(exact[1:])[-5]).mean() < 0.1
