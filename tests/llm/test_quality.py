import math
import random

import pytest

from tidewatch.llm import quality as q


def rows(n=300, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(300)]
    good = lambda: " ".join(rng.choices(vocabulary, k=rng.randrange(20, 80))).capitalize() + "."
    junk = lambda: " ".join(w for w in rng.choices(vocabulary, k=6) for _ in range(12)) if rng.random() < 0.5 else good().upper().replace(" ", "!! ")
    return [(k, junk() if k % 5 == 0 else good(), k % 5 != 0) for k in range(n)]


def frames(spark, data):
    docs = spark.createDataFrame([(k, t, "x", 1.0) for k, t, _ in data], "doc_id long, text string, key string, score double")
    labels = spark.createDataFrame([(k, int(g), 0) for k, _, g in data if k is not None and k % 2 == 0], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_kept_columns(spark):
    data = rows()
    docs, labels = frames(spark, data)
    got = {r.doc_id: r for r in q.scores(docs, labels).collect()}
    wrong = [k for k, _, good in data if k % 2 and got[k].selected != good]
    assert len(wrong) <= 2
    kept = q.keep(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.selected}


def test_weights_against_plain_counting(spark):
    data = rows(60) + [(61, None, True), (62, "", True), (63, "é " * 9000, True), (None, "no id.", True), (4, "twice", True), (4, "twice", True)]
    docs, labels = frames(spark, data)
    got = q.scores(docs, labels).collect()
    label = {k: g for k, _, g in data if k is not None and k % 2 == 0}
    known = q.WordFeatures()
    counts = [dict.fromkeys(range(q.BUCKETS), 0) for _ in range(2)]
    for k, t, _ in data:
        if t:
            for n in q.ngrams([t.encode().split()], known)[0]:
                counts[0][n] += 1
                counts[1][n] += bool(label.get(k))
    ratio = {}
    for a, b in ((0, q.WORD_BUCKETS), (q.WORD_BUCKETS, q.WORD_BUCKETS + q.SHAPES), (q.WORD_BUCKETS + q.SHAPES, q.BUCKETS)):
        used = [n for n in range(a, b) if counts[0][n]]
        totals = [sum(c[n] + 1 for n in used) for c in counts]
        ratio |= {n: math.log((counts[1][n] + 1) / totals[1]) - math.log((counts[0][n] + 1) / totals[0]) for n in used}
    want = sorted((str(k), round(sum(ratio[n] for n in q.ngrams([t.encode().split()], known)[0]), 6) if t else 0.0) for k, t, _ in data)
    assert sorted((str(r.doc_id), round(r.log_weight, 6)) for r in got) == want


def test_without_two_classes_nothing_is_rejected(spark):
    docs, labels = frames(spark, rows(30))
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert all(r.selected for r in q.scores(docs, some).collect())
    assert q.scores(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("n", [1, 7, 30_000])
def test_kth_largest(spark, n):
    rng = random.Random(n)
    x = [rng.choice([rng.gauss(0, 1), 0.5, 1e6, -3.0]) for _ in range(n)]
    frame = spark.createDataFrame([(v,) for v in x], "k double")
    for k in {1, 2, n // 2 + 1, n - 1} - {0}:
        want = sorted(x, reverse=True)[k - 1] if k < n else -math.inf
        assert q.kth_largest(frame, k) == want
    assert q.kth_largest(frame, 0) == math.inf
