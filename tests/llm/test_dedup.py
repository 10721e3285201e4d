import random

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import bktree, exact_dedup, simhash
from tidewatch.llm.common import words

DOCS = "doc_id long, text string, h string, size long, code string, best_id string"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "h", k, "c", "b") for k, t in texts], DOCS)


def test_exact_groups(spark):
    texts = [(5, "a b"), (3, "ab"), (4, "a\tb "), (9, None), (8, ""), (7, " \n"), (1, "ä" * 70_000), (2, "ä" * 70_000 + " "), (6, "a b"), (None, "zz"), (10, "ab")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, texts)).collect()}
    assert got[5] == (4, 4, False) and got[4] == (4, 4, True) and got[3] == (4, 4, False)
    assert got[9] == (7, 3, False) and got[7] == (7, 3, True)
    assert got[1] == (2, 2, False) and got[2] == (2, 2, True)
    assert got[6] == (6, 1, True) and got[None] == (None, 1, True)
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_exact_groups_with_colliding_hashes(spark):
    texts = [(k, "x" * (k % 3) + " " * (k % 2)) for k in range(40)]
    got = exact_dedup.exact_groups(frame(spark, texts), hash_fn=lambda normal: F.lit(b"0")).collect()
    for r in got:
        same = [(len(t), -k) for k, t in texts if k % 3 == r.doc_id % 3]
        assert (r.keep_id, r.group_size) == (-max(same)[1], len(same))


def brute(codes, radius):
    root = {k: k for k in codes}
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    ids = sorted(codes)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (codes[a] ^ codes[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def test_bk_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    code = np.concatenate([centres[rng.integers(0, 30, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)), centres])
    group = rng.integers(0, 5, len(code))
    tree = bktree.build(group, code)
    q, node = bktree.near(code, tree, np.arange(len(code)), 4)
    got = set(zip(q.tolist(), node.tolist()))
    assert len(got) == len(q)
    d = np.bitwise_count(code[:, None] ^ code[None, :])
    want = set(zip(*map(np.ndarray.tolist, np.nonzero((d <= 4) & (group[:, None] == group[None, :])))))
    assert got == want


def noisy(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice("xyzuvw") * 3
    return " ".join(w)


def test_near_groups_against_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    texts, vocabulary = [], [f"w{k}" for k in range(50)]
    for g in range(25):
        base = " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 60, 200])))
        texts += [(g * 100 + k, noisy(rng, base, k % 3)) for k in range(rng.choice([1, 6]))]
    texts += [(9000, None), (9001, ""), (9002, " \t"), (8000, "Ä b C"), (8001, "Ä B c"), (8001, "Ä B c")]
    codes = {k: simhash.simhash(simhash.shingle_hashes(words(t or ""), 4)) for k, t in texts}
    want = brute(codes, 4)
    for most in (4096, 4):  # small shards are split twice
        monkeypatch.setattr(simhash, "SHARD_ROWS", most)
        got = simhash.near_groups(frame(spark, texts)).collect()
        assert len(got) == len(texts)
        assert all((r.fingerprint, r.component_id) == (f"{codes[r.doc_id]:016x}", want[r.doc_id]) for r in got)
    assert simhash.near_groups(frame(spark, [])).count() == 0


def test_fingerprint_is_the_majority_of_spark_hashes(spark):
    got = spark.sql("select xxhash64('a b c d') x, xxhash64('b c d e') y, xxhash64('c d e f') z").first()
    want = 0
    for bit in range(64):
        want |= (sum(v % 2**64 >> bit & 1 for v in got) > 1) << bit
    assert simhash.simhash(simhash.shingle_hashes(words("A b\nC d  e f"), 4)) == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(200)] + [(500, 501), (501, 502)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 501: 500, 502: 500}


def test_rows_are_dropped_and_not_ids(spark):
    rows = [(3, "same"), (5, "same"), (5, "unique"), (9, "dup"), (9, "dup"), (None, "same"), (None, "lone"), (None, "lone")]
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, row string, c0 int")
    for keep_one in (exact_dedup.keep_one, simhash.keep_one):
        kept = keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", "same"), ("5", "unique"), ("9", "dup"), ("None", "lone")]
        assert keep_one(docs.limit(0)).count() == 0
    spaced = spark.createDataFrame([(1, "a b"), (2, "a  b"), (2, "ab")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in exact_dedup.keep_one(spaced).collect()] == [(2, "a  b")]


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "else")], "doc_id string, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert len(simhash.keep_one(docs).collect()) == 2


def test_near_copies_in_shards_that_are_split(spark, monkeypatch):
    rng = random.Random(26)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(120)]
        for k in range(rng.choice([1, 9])):
            at = rng.randrange(120)
            texts.append((g * 100 + k, " ".join([*base[:at], f"x{k}", *base[at + 1 :]])))
    whole = {(r.doc_id, r.root) for r in simhash.near_copies(frame(spark, texts)).collect()}
    assert whole == {(k, k // 100 * 100) for k, _ in texts if k % 100}
    for name, most in (("SHARD_ROWS", 2), ("SHARD_BYTES", 2_000)):
        with monkeypatch.context() as m:
            m.setattr(simhash, name, most)
            assert {(r.doc_id, r.root) for r in simhash.near_copies(frame(spark, texts)).collect()} == whole
