import random

import numpy as np

from tidewatch.llm import decontaminate as d


def corpus(seed=1):
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(20)]
    def text(n):
        return " ".join(rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(3000)}" for _ in range(n))
    items = [(k, text(rng.randrange(9, 40)) + "." + "\nWhat " + text(6)) for k in range(60)]
    docs = []
    for k in range(80):
        body = text(rng.choice([0, 5, 300]))
        if k % 3 == 0:
            body += "\n" + items[k % 60][1].upper() + "  " + text(200)
        docs.append((k, body))
    return items, docs


def test_wand_finds_what_scoring_all_items_finds():
    items, docs = corpus()
    index = d.Index(items)
    rng = random.Random(9)
    for _ in range(300):
        i = rng.randrange(60)
        w = d.words(items[i][1])
        query = rng.sample(w, rng.randrange(1, len(w))) + d.words(docs[rng.randrange(80)][1])[: rng.randrange(60)]
        terms = sorted({index.term[t] for t in query if t in index.term})
        score = np.zeros(60)
        for t in terms:
            score[index.docs[t]] += index.impacts[t]
        for least in (0.05, 0.3, 0.5):
            want = {k: round(float(s), 9) for k, s in enumerate(score) if s >= least - 1e-9 and s > 0}
            assert {k: round(s, 9) for k, s in index.search(terms, least)} == want
        rare = np.array([t for t in terms if index.rare[t]], dtype=int)
        if len(rare) and not index.may_reach(rare) or not len(rare):
            assert score.max(initial=0) < d.THRESHOLD


def share(side, part):
    width = 5 if len(side) >= 10 else max(1, len(side) // 2)
    runs = {" ".join(side[k : k + width]) for k in range(len(side) - width + 1)}
    text = " " + " ".join(part) + " "
    return sum(f" {r} " in text for r in runs) / len(runs)


def test_short_answers_are_verified():
    text = "one two three four five six seven eight nine ten eleven. the answer is this"
    (hit,) = d.Index([(1, text), (2, "quite another text with nothing in common here at all.")]).hits("before " + text + " after")
    assert hit[0] == 1 and hit[3:] == (1.0, 1.0)


def brute(items, docs):
    index, out = d.Index(items), set()
    for k, text in docs:
        w = d.words(text or "")
        for start in range(0, max(1, len(w) - index.longest), index.longest):
            part = w[start : start + 2 * index.longest]
            for n, i in enumerate(index.item):
                score = sum(float(x) for t in set(part) if t in index.term for m, x in zip(index.docs[index.term[t]], index.impacts[index.term[t]], strict=True) if m == n)
                if score >= d.THRESHOLD - 1e-9 and all(share(s, part) >= d.OVERLAP for s in index.sides[n]):
                    out.add((k, i))
    return out


def test_documents_against_brute_force(spark):
    items, docs = corpus()
    docs += [(100, None), (101, ""), (102, "x " * 20_000 + items[5][1]), (None, items[7][1]), (103, items[9][1][: len(items[9][1]) // 3])]
    items += [(900, None), (901, ""), (902, "too short"), (903, items[3][1])]
    want = brute([i for i in items if i[1]], docs)
    frame = spark.createDataFrame([(k, t, 1, "y") for k, t in docs], "doc_id long, text string, item_id int, score string")
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    got = d.hits(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {(k, k % 60) for k in range(0, 80, 3)} <= want and (102, 5) in want and (None, 7) in want
    in_blocks = d.hits(frame, bench, most=20).collect()
    told = lambda rows: sorted((str(r.doc_id), r.item_id, r.start, *(round(x, 9) for x in (r.score, r.question_overlap, r.answer_overlap))) for r in rows)
    assert told(in_blocks) == told(got)
    kept = d.keep(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(k) for k, _ in docs if k not in {w[0] for w in want})
    assert d.hits(frame.limit(0), bench).count() == 0 and d.hits(frame, bench.limit(0)).count() == 0


def test_short_items_are_whole_runs_of_words(spark):
    docs = spark.createDataFrame([(1, "it was Two  Plus\nfour indeed two plus four"), (2, "two plus fourteen"), (3, "plus four two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two plus four"), (2, "four two"), (3, "it was two plus four indeed two")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.score, r.start) for r in d.hits(docs, items).collect()) == [(1, 1, 1.0, 2), (1, 3, 1.0, 0)]
    assert [r.doc_id for r in d.keep(docs, items).collect()] == [2, 3]
