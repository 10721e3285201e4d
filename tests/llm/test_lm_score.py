import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import lm_score as lm


def texts():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(200)] + ["É", "é", "|", "The"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    out = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 400])))) for k in range(150)]
    return out + [(7, None), (8, ""), (9, " \t\n"), (7, "the the"), (7, "the the"), (None, "the w1"), (200, "never-seen words x" + "y" * 9000)]


def words(t):
    return [*(t or "").encode().lower().split(), b"\n"]


def exact():
    train = Counter()
    for k, t in texts():
        if zlib.crc32(("" if k is None else str(k)).encode()) % 7 != 2:
            train.update(words(t))
    return train


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, key string, shard int")


@pytest.mark.parametrize("share", [65_536, 20])  # all words are frequent; few are
def test_base_scores_are_exact(spark, share):
    train = exact()
    n, v = sum(train.values()), len(train)
    want = sorted((str(k), len(words(t)), sum(train[w] > 0 for w in words(t)), round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for k, t in texts())
    got = lm.scores(frame(spark, texts()), frequent_share=share).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2) for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    # The bigram model knows more of the training texts than single words do.
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)


def test_empty_table(spark):
    assert lm.scores(frame(spark, [])).count() == 0


def test_filter_levels_stand_for_the_counts(spark):
    rows = [(" ".join(f"k{j}" for j in range(64) if k < j),) for k in range(64)]
    shards = 5
    built = lm.filters(spark.createDataFrame(rows, "t string"), shards).collect()
    lf = lm.LogFrequencyFilter([(r.shard, r.level, bytes(r.bits)) for r in built], shards)
    hashed = lambda words: lm.ngram_hashes(np.zeros(1, np.int32), lm.Numbering([(lm.END, 0), *[(w, k + 1) for k, w in enumerate(words)]]))[1][1:]
    one = hashed([f"k{j}".encode() for j in range(1, 64)])
    assert (lf.level(one) >= np.array([1 + int(math.log2(j)) for j in range(1, 64)])).all()
    assert (lf.level(one) == np.array([1 + int(math.log2(j)) for j in range(1, 64)])).mean() > 0.9
    unseen = hashed([f"u{j}".encode() for j in range(5000)])
    assert (lf.level(unseen) > 0).mean() < 0.05


def brute_scores():
    """Each text's log10 probability from exact counts of the training texts, put into levels."""
    one, two = Counter(), Counter()
    for k, t in texts():
        if zlib.crc32(("" if k is None else str(k)).encode()) % 7 != 2:
            w = words(t)
            one.update(w)
            two.update(zip([b"\n", *w], w))
    n, v = sum(one.values()), len(one)
    mid = lambda c: (3 * 2 ** int(math.log2(c)) - 1) / 2 if c else 0.0
    out = []
    for k, t in texts():
        total = 0.0
        for a, b in zip([b"\n", *words(t)], words(t)):
            p = (mid(one[b]) + 1) / (n + v + 1)
            total += math.log10((min(mid(two[a, b]), mid(one[a])) + lm.SMOOTH * p) / (mid(one[a]) + lm.SMOOTH))
        out.append((str(k), len(words(t)), total))
    return sorted(out)


def test_scores_against_exact_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 40)  # hardly a false find
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.scores(frame(spark, texts())).collect())
    for (k, n, score), (k2, n2, want) in zip(got, brute_scores(), strict=True):
        assert (k, n) == (k2, n2) and abs(score - want) < 0.01 * n


def test_the_limit_of_the_broadcast_changes_no_score(spark):
    told = lambda **of: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lm.scores(frame(spark, texts()), **of).collect())
    assert told(max_filter_bytes=0) == told()


def test_scores_do_not_depend_on_the_session(spark):
    key, told = "spark.sql.shuffle.partitions", []
    own = spark.conf.get(key)
    try:
        for n in ("3", "11"):
            spark.conf.set(key, n)
            told.append(sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.scores(frame(spark, texts())).collect()))
    finally:
        spark.conf.set(key, own)
    assert told[0] == told[1]
