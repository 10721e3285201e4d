import base64
import hashlib
import random
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tidewatch.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def texts():
    rng = random.Random(5)
    some = ["", None, " ", "<|endoftext|> it's we'll", "a" * 700, "x" * 90 + " " * 95 + "\n\ny", "Öl 12345 été\r\n\t  tail  ", "\x1c\x1d a\x85b　c ﻿", "日本語" * 50]
    for _ in range(12):
        some.append("".join(rng.choice(["the", " a", "  ", "\n\n", "!?", "é", "123", "'s", " ", "q" * 40, "\x1f", " 9"]) for _ in range(rng.randrange(400))))
    return list(enumerate(some)) + [(3, "again " * 40), (3, "again " * 40), (None, "no id " * 50)]


def test_encode_and_read_back_match_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for k, t in texts():
        ids = library.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in texts()], "doc_id long, text string, key string, parts string")
    for chunk, overlap in ((64, 16), (100, 99), (32_768, 512)):
        got = byte_bpe.read_back(byte_bpe.encode(docs, PATH, P.PATTERN, chunk=chunk, overlap=overlap), PATH, P.PATTERN)
        assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert byte_bpe.read_back(byte_bpe.encode(docs.limit(0), PATH, P.PATTERN), PATH, P.PATTERN).count() == 0


def test_long_texts_are_cut_into_stretches(spark):
    long = spark.createDataFrame([(1, "word " * 100), (2, "z" * 500 + " end")], "key long, t string")
    spans = byte_bpe.stitches(long, PATH, P.PATTERN, 100, 20).orderBy("key", "start").collect()
    assert [(r.start, r.end) for r in spans if r.key == 1] == [(0, 104), (104, 204), (204, 304), (304, 404), (404, 500)]
    assert [(r.start, r.end) for r in spans if r.key == 2] == [(0, 504)] or spans[-1].end == 504


def test_one_worker_a_task_encodes_and_reads_back(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    for chunk, overlap in ((64, 16), (32_768, 512)):
        both = byte_bpe.encode_and_read_back(docs, PATH, P.PATTERN, chunk=chunk, overlap=overlap)
        apart = byte_bpe.read_back(byte_bpe.encode(docs, PATH, P.PATTERN, chunk=chunk, overlap=overlap), PATH, P.PATTERN)
        assert both.schema == apart.schema and key(both.collect()) == key(apart.collect())
    # A Python step on top of another one runs beside it, in a second worker.
    assert chained_steps(byte_bpe.read_back(byte_bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)) == 1
    for rows in (byte_bpe.encode_and_read_back(docs, PATH, P.PATTERN), corpus_pipeline.encode(spark, docs, "")):
        assert chained_steps(rows) == 0


def chained_steps(rows):
    """How many Python steps of the plan have another one under them in the same task."""
    n, inside = 0, False
    for line in rows._jdf.queryExecution().sparkPlan().toString().splitlines():
        step = re.search(r"\w+", line).group()
        if step == "MapInArrow":
            n, inside = n + inside, True
        elif step not in ("Project", "Filter", "Union"):
            inside = False
    return n
