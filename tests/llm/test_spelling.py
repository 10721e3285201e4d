import random
import re
import zlib
from collections import Counter

import pytest

from tidewatch.llm import spelling

DOCS = "doc_id long, text string, word string, n int, key string, root string, form string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "w", 1, "k", "r", "f") for k, t in rows], DOCS)


def brute_counts(rows, least_n=5):
    n = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= least_n}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(n, factor=5):
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in links.items():
        if vs:
            top = min(vs, key=lambda v: (-n[v], v))
            if n[top] >= factor * n[w]:
                form[w] = top
    out = {}
    for w in n:
        r = w
        while r in form:
            r = form[r]
        out[w] = (form.get(w), r, n[w], len(links[w]), n[form[w]] if w in form else None)
    return out


def random_words(rng):
    alphabet = "aabbcdeéÿ×z"
    words = set()
    for _ in range(60):
        w = "".join(rng.choices(alphabet, k=rng.randrange(6, 12)))
        words.add(w)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(w) + 1)
            v = rng.choice([w[:k] + rng.choice(alphabet) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k + 1 :]])
            words.add(v)
            w = v if rng.random() < 0.5 else w
    return words | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "x" * 199, "x" * 200, "x" * 201, "x" * 202, "x" * 203, "x" * 100 + "y" + "x" * 100, "y" + "x" * 201, "x" * 201 + "y", "y" * 5000, "y" * 4999, "y" * 2500 + "z" + "y" * 2500}


@pytest.mark.parametrize("most,ranks", [(2048, 200_000), (3, 200_000), (2048, 0)])
def test_variants_against_all_pairs(spark, monkeypatch, most, ranks):
    monkeypatch.setattr(spelling, "PART_ROWS", most)
    monkeypatch.setattr(spelling, "RANKS_MOST", ranks)
    rng = random.Random(5)
    n = {w: rng.choice([5, 6, 25, 30, 130, 700, 4000]) for w in random_words(rng) if len(w) >= 6}
    words = spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(words).collect()}
    want = brute(n)
    assert got == want and any(v[1] != v[0] and v[0] for v in want.values())


def test_words_of_texts(spark):
    rng = random.Random(1)
    pool = ["Straße", "strasse", "naïveté", "COLOUR", "colours", "colour", "zürich", "école×école", "abcdefg", "ABCDEFÉ", "kurz"]
    rows = [(rng.randrange(10_000), " ".join(rng.choices(pool, k=60)) + "." + rng.choice(pool) + "1" + rng.choice(pool)) for _ in range(200)]
    rows += [(None, "COLOUR colour-colour"), (3, None), (4, ""), (5, " . "), (6, "q" * 300_000), (6, "q" * 300_000), *[(7, "q" * 300_001)] * 5, rows[0], rows[0]]
    n = brute_counts(rows)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(frame(spark, rows)).collect()}
    assert got == brute(n) and any(v[0] for v in got.values())
    assert spelling.spelling_variants(frame(spark, [])).count() == 0


def test_merged_counts_like_a_counter():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randrange(8))) for _ in range(rng.randrange(1, 7))]
        lists = [x for x in lists if x] or [[1]]
        c = Counter(k for x in lists for k in x)
        for least in (1, 2, 3):
            want = sorted(k for k, m in c.items() if m >= least) if len(lists) >= least else []
            assert list(spelling.merged(lists, least)) == want
