import random

import pytest

from tidewatch.llm import line_dedup as ld


def words(line):
    return line.strip(" \t\r\x0b\x0c").replace("\t", " ").count(" ") + 1


def brute(texts, gram):
    """Lines that lie in a run of `gram` words or more, equal to a run that begins earlier in the corpus; all pairs of positions are tried."""
    lines = []
    for k, t in texts:
        own = [(p, x.strip()) for p, x in enumerate((t or "").split("\n")) if x.strip()]
        lines.append((k, own))
    gone = set()
    for b, (kb, later) in enumerate(lines):
        for a in range(b + 1):
            earlier = lines[a][1]
            for shift in range(-len(later), len(earlier)):
                if a == b and shift >= 0:
                    continue
                run = []
                for i in range(len(later) + 1):
                    if i < len(later) and 0 <= i + shift < len(earlier) and later[i][1] == earlier[i + shift][1]:
                        run.append(later[i])
                    else:
                        if sum(words(x) for _, x in run) >= gram:
                            gone |= {(kb, p) for p, _ in run}
                        run = []
    return gone


def corpus():
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(rng.choice([3, 8, 30, 60])) for _ in range(rng.choice([1, 2, 5]))] for _ in range(12)]
    boiler = line(6)
    out = []
    for k in range(60):
        body = [boiler] if k % 2 else []
        for _ in range(rng.randrange(1, 5)):
            body += rng.choice(passages) if rng.random() < 0.5 else [line(rng.choice([1, 10, 40]))]
            if rng.random() < 0.2:
                body.append("")
        out.append((k, "\n".join(body)))
    return out + [(100, None), (101, ""), (102, " \n\t"), (103, "\n".join([line(30)] * 4)), (104, "x " * 30_000), (105, "x " * 30_000)]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 1, "y") for k, t in texts], "doc_id long, text string, row int, gone string").coalesce(1)


NO_WORDS = 10**6


@pytest.mark.parametrize("least", [1, ld.LEAST, 25])
def test_lines_against_all_pairs_of_positions(spark, least):
    texts = corpus()
    got = {(texts[r.row][0], r.pos) for r in ld.runs(frame(spark, texts), gram=NO_WORDS, least=least).collect()}
    assert {(k, p) for k, p in got if dict(texts)[k].split("\n")[p].strip()} == brute(texts, least)


def word_brute(texts, gram, least):
    """Numbers of the words that lie in `least` words which also stand in an earlier text, or `gram` words earlier in the same one."""
    seen, gone = {}, set()
    for k, t in texts:
        w = (t or "").split()
        for i in range(len(w) - least + 1):
            g = tuple(w[i : i + least])
            first = seen.setdefault(g, (k, i))
            if first[0] != k or i - first[1] >= gram:
                gone |= {(k, i + j) for j in range(least)}
    return gone


@pytest.mark.parametrize("share", [2, ld.SHARE, 10**6])
def test_words_against_all_positions(spark, share):
    rng = random.Random(3)
    some = lambda n: [f"u{rng.randrange(10**5)}" for _ in range(n)]
    passages = [some(rng.randrange(20, 120)) for _ in range(10)]
    texts = []
    for k in range(50):
        body = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            body += some(rng.randrange(1, 30)) + (p if rng.random() < 0.6 else p[a : a + rng.randrange(60)])
        # Every text is one line of its own, with a first word that no other has.
        texts.append((k, f"first{k} " + " ".join(body)))
    done = ld.dedup(frame(spark, texts), share=share).collect()
    left = {r.doc_id: r.text.split() for r in done}
    own = dict(texts)
    must, may = word_brute(texts, ld.GRAM, ld.GRAM + ld.WINDOW - 1), word_brute(texts, ld.GRAM, ld.GRAM)
    for k, w in left.items():
        every = own[k].split()
        at, gone = 0, set()  # words are all but unique, so what is left is found again from the front
        for p, x in enumerate(every):
            if at < len(w) and w[at] == x:
                at += 1
            else:
                gone.add((k, p))
        assert at == len(w)
        assert {x for x in must if x[0] == k} <= gone <= {x for x in may if x[0] == k}


def test_a_run_whose_parts_were_met_apart(spark):
    rng = random.Random(8)
    some = lambda n: " ".join(f"z{rng.randrange(10**6)}" for _ in range(n))
    x, y = some(30), some(24)
    for sep in ("\n", " "):
        texts = [(1, f"{some(30)}{sep}{x}{sep}{some(30)}"), (2, f"{some(30)}{sep}{x}{sep}{y}"), (3, f"{some(30)}{sep}{x}{sep}{y}")]
        got = {r.doc_id: r.text for r in ld.dedup(frame(spark, texts)).collect()}
        assert got[1] == texts[0][1]
        if sep == "\n":  # a run of 30 words within lines is under the length that is sure to be found
            assert got[2].split() == texts[1][1].split()[:30] + y.split()
        assert got[3].split() == texts[2][1].split()[:30]


def test_clashing_columns_and_text_ids(spark):
    line = "a line that stands in both texts"
    docs = spark.createDataFrame([("b", f"{line}\none", 5, "g"), ("a", f"{line}\ntwo", 6, "h")], "doc_id string, text string, n_deleted int, gram string").coalesce(1)
    done = ld.dedup(docs)
    assert done.columns == ["doc_id", "text", "gram", "n_deleted"]
    assert sorted(r.n_deleted for r in done.collect()) == [0, 1]


@pytest.mark.parametrize("most", [ld.BROADCAST_SPANS, 0])
def test_texts_without_later_runs(spark, monkeypatch, most):
    monkeypatch.setattr(ld, "BROADCAST_SPANS", most)
    texts = corpus()
    docs = frame(spark, texts)
    gone = {(texts[r.row][0], r.pos) for r in ld.runs(docs).collect()}
    done = ld.dedup(docs)
    assert done.columns == [*docs.columns, "n_deleted"]
    for r in done.collect():
        t = dict(texts)[r.doc_id]
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (r.doc_id, p) not in gone)
        assert (r.text, r.n_deleted, r.row, r.gone) == (kept, sum(k == r.doc_id for k, _ in gone), 1, "y")
    assert ld.dedup(docs.limit(0)).count() == 0


def test_repeated_ids(spark):
    texts = [(5, "a b c " * 20), (5, "a b c " * 20), (None, "a b c " * 20), (3, "a b c " * 20)]
    got = {(r.row, r.pos) for r in ld.runs(frame(spark, texts)).collect()}
    assert got == {(0, 0), (1, 0), (2, 0)}


def test_passages_inside_lines_and_wrapped_anew(spark):
    rng = random.Random(5)
    some = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    p, q, long = some(60), some(120), some(49)
    wrapped = "\n".join(" ".join(q[k : k + 7]) for k in range(0, 120, 7))
    texts = [
        (0, " ".join(some(20) + p + some(20)) + "\n" + " ".join(q)),
        (1, "head  of it " + " ".join(p) + " tail\tof it\nlast\n"),  # inside a line
        (2, "before\n" + wrapped + "\n\nafter"),  # the line breaks are elsewhere
        (3, "one " + " ".join(p[:30]) + "\n" + " ".join(p[30:]) + " two"),  # from inside a line into another
        (4, " ".join(long + ["a"] + long) + "\nend"),  # twice in one line
        (5, "other " + " ".join(p[:20]) + " words"),  # too short
        (6, None),
    ]
    got = {r.doc_id: (r.text, r.n_deleted) for r in ld.dedup(frame(spark, texts)).collect()}
    assert got == {
        0: (texts[0][1], 0), 1: ("head  of it tail\tof it\nlast\n", 0), 2: ("before\n\nafter", 18), 3: ("one \ntwo", 0),
        4: (" ".join(long + ["a"]) + " \nend", 0), 5: (texts[5][1], 0), 6: (None, 0),
    }


def test_no_text_is_sent_after_the_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_SPANS", 0)
    monkeypatch.setattr(ld, "BROADCAST_IDS", 0)
    seen, around = [], ld.around

    def watched(rows, places, *more):
        seen.append(places.groupBy("gram").count().agg({"count": "min"}).first()[0])
        return around(rows, places, *more)

    monkeypatch.setattr(ld, "around", watched)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(6)
        passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
        texts = [(k, f"own{k} " + rng.choice(passages) + f" and\n{k} then " + rng.choice(passages)) for k in range(40)]
        done = ld.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
        plan = done._jdf.queryExecution().executedPlan().toString().split("\n")
        assert sum(len(r.text) < len(dict(texts)[r.doc_id]) for r in done.collect()) > 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    # The only exchange before the result is that of the cuts, which have no text (c1).
    sent = [k for k, line in enumerate(plan) if "Exchange" in line]
    assert len(sent) == 1 and not any("c1#" in line for line in plan[sent[0] :])
    # Grams that stand once go no further than the count that tells so.
    assert len(seen) == 2 and min(seen) > 1


def test_later_words_and_spans_are_sent_once(spark):
    places = spark.createDataFrame([((1, 2), 5, 7, 0), ((1, 2), 5, 7, 30), ((1, 2), 5, 7, 40), ((1, 2), 4, 9, 3), ((1, 2), 6, 8, 1)], "gram struct<a long, b long>, id long, row long, idx int")
    later = ld.later_words(places, 25)
    spans = ld.merged(spark.createDataFrame([(1, 0, 4), (1, 0, 4), (1, 2, 6), (1, 8, 9)], "row long, idx int, to int"))
    assert sorted((r.row, r.idx) for r in later.collect()) == [(7, 0), (7, 30), (7, 40), (8, 1)]
    assert [(r.row, [tuple(x) for x in r.spans]) for r in spans.collect()] == [(1, [(0, 6), (8, 9)])]
    for done in (later, spans):
        assert done._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
        assert done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1
