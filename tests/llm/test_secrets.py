import hashlib
import re

from tidewatch.llm import secrets

KEY = "AKIA" + "Q7" * 8
WEAK = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKE9"
assert len(WEAK) == 40


def brute(text):
    out = []
    for m in re.finditer(r"""((?i:p)(?i:a)(?i:s)(?i:s)(?:(?i:w)(?i:o)(?i:r)(?i:d)|(?i:w)(?i:d))|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end()))
    for k, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 16), (r"[0-9a-f]+", 32)), 1):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def rows(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id long, text string, kind string, start int")


def test_base_spans_against_plain_patterns(spark):
    texts = list(enumerate([
        None, "", "no", "password=short", "PassWord = 'longenough1' token:abcdefgh", "ſecret=abcdefghij toKen=abcdefghij", "apikey=API_KEY=abcdefghi", f"é {KEY} " + "a1" * 16 + "g" + "0" * 31,
        "secret=token=abcdefghij", "AKIAAKIA" + "B" * 20 + " AKIA1", "x" * 100_000 + " passwd: " + "0123456789abcdef" * 3, "api_key\"='abc_def.g-h+/='",
    ]))
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(rows(spark, texts))).collect()}
    assert len(got) == len(texts)
    for k, t in texts:
        want = brute(t or "")
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(sum(w[1] == n for w in want) for n in range(3))
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[n]}:{a}:{b}" for a, n, b in want).encode()).hexdigest()
    assert secrets.scan(rows(spark, [])).count() == 0


def test_weak_candidates_need_a_complement_within_reach(spark):
    url = "https://bucket.example.com/x"
    texts = [
        (1, f"{KEY} and {WEAK}"), (2, f"only {WEAK} and {url}"), (3, f"{KEY}{' .' * 300}{WEAK}"), (4, f"{WEAK} {'y ' * 150}{KEY}"), (5, f"see {url} with password=hunter2hunter2"),
        (6, f"secret={WEAK}"), (7, f"{'é ' * 399}{KEY} {WEAK} {url}"), (7, f"{'é ' * 399}{KEY} {WEAK} {url}"),
    ]
    got = secrets.digest(secrets.scan(rows(spark, texts))).collect()
    linked = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s.split(":")[0] in ("secret", "endpoint")] for r in got}
    assert linked == {1: ["secret"], 2: [], 3: [], 4: ["secret"], 5: ["endpoint"], 6: [], 7: ["secret", "endpoint"]}
    assert sum(r.doc_id == 7 for r in got) == 2
    assert {r.doc_id: r.n_linked for r in got}[7] == 2
