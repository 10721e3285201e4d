r"""Secret scans with multipart credential linking.

Every whole text is searched for three base kinds, each leftmost and not overlapping:

* assign: a keyword, an equals sign or colon and a value of 8 or more characters;
* access: an access identifier, AKIA and capitals or digits, 16 or more characters;
* hex: 32 or more lower-case hex digits;

and for two weak kinds that mean little alone:

* secret: a run of 40 characters of the base64 alphabet with lower-case and capital letters and digits, as issued with access identifiers;
* endpoint: a URL or a host name of a storage or compute service.

A credential has complementary parts: an access identifier, a secret and an endpoint. Candidates of a text form scopes; within a scope, an interval join pairs every weak candidate with the parts of another kind that lie up to REACH code points away. A weak candidate is reported only when such a part co-occurs: a secret needs an access identifier; an endpoint needs an access identifier or a reported assignment. Base spans always stay. Each reported weak span carries the start of its nearest partner.

The join runs on (row, bucket of REACH code points), so a text with very many candidates is spread over its buckets, and it keeps one partner for each weak candidate, never pairs.

Defined results: a null text counts as empty. Offsets are code points, end exclusive. A text without finds has no spans and the hash of an empty string. Rows that share an id are each returned. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, whole

#: How far apart, in code points, two parts of one credential may lie.
REACH = 400

# The kinds in the order in which equal starts are listed, and their patterns.
KINDS = ["assign", "access", "hex", "secret", "endpoint"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
SECRET = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.)*(?:s3|sqs|sts|ec2|iam|storage|blob)(?:[.-][a-z0-9-]+)*\.(?:amazonaws\.com|googleapis\.com|windows\.net)(?![A-Za-z0-9-])")
KEYWORDS = ("password", "passwd", "secret", "token", "api")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of all base finds and weak candidates."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):  # a plain search, far quicker than the pattern
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    out += [(3, m.start(), m.end()) for m in SECRET.finditer(text) if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
    if "http" in text or ".com" in text or ".net" in text:
        out += [(4, m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    return sorted((k, a, b) for k, a, b in out)


SPAN = "struct<kind: int, start: int, end: int>"


def find(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and found: the candidates of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in slices(batches):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in candidates(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "found"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, found array<{SPAN}>")


def linked_spans(found: DataFrame, reach: int = REACH) -> DataFrame:
    """From rows (key, found): key, kind, start, end and partner (the start of the nearest complementary part) of every weak candidate that has one within `reach`."""
    spans = found.where(F.exists("found", lambda s: s.kind >= 3)).select("key", F.explode("found").alias("s")).select("key", "s.kind", "s.start", "s.end")
    weak = spans.where("kind >= 3").withColumn("bucket", F.floor(F.col("start") / reach))
    # Both ends of a part within reach of a start lie in its bucket or a neighbour: a part goes to all the buckets it can serve.
    part = spans.where("kind <= 1").select("key", F.col("kind").alias("of"), F.col("start").alias("from"), F.col("end").alias("to"))
    part = part.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from") / reach) - 1, F.floor(F.col("to") / reach) + 1)))
    gap = F.greatest(F.col("from") - F.col("end"), F.col("start") - F.col("to"), F.lit(0))
    fits = (F.col("kind") == 3) & (F.col("of") == 1) | (F.col("kind") == 4)
    # A part that holds the candidate itself (a value in an assignment) is no complement.
    apart = (F.col("from") >= F.col("end")) | (F.col("to") <= F.col("start"))
    met = weak.join(part, ["key", "bucket"]).where(fits & apart & (gap <= reach))
    return met.groupBy("key", "kind", "start", "end").agg(F.min_by("from", F.struct(gap.alias("gap"), F.col("from").alias("f"))).alias("partner"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, base and linked: two sorted arrays of spans (kind by name, start, end; linked ones with their partner's start)."""
    found = settle(find(docs, id_col, text_col).withColumn("key", F.monotonically_increasing_id()))
    linked = linked_spans(found.select("key", "found"), reach).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "partner"))).alias("more"))
    base = F.sort_array(F.transform(F.filter("found", lambda s: s.kind < 3), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))))
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)
    return found.join(linked, "key", "left").select(
        "doc_id",
        F.transform(base, lambda s: F.struct(name(s).alias("kind"), s.start.alias("start"), s.end.alias("end"))).alias("base"),
        F.transform(F.coalesce("more", F.array().cast("array<struct<start: int, kind: int, end: int, partner: int>>")), lambda s: F.struct(name(s).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.partner.alias("partner"))).alias("linked"),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked from scan()'s rows."""
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s.kind)
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s.start.alias("start"), place(s).alias("place"), s.end.alias("end"), s.kind.alias("kind")))
    every = F.sort_array(F.concat(plain(F.col("base")), plain(F.col("linked"))))
    return scanned.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"), F.size("linked").cast("long").alias("n_linked"))
