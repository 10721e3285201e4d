import base64
import gzip
import hashlib
import io
from pathlib import Path

from tidewatch.llm import warc

PAGES = "page_id long, url string, html string, h string, best long, payload string, n int"


def pages(spark, rows, kind=PAGES):
    return spark.createDataFrame([(k, u, t, "h", 1, "p", 2) for k, u, t in rows], kind)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_pages_come_back(spark, tmp_path):
    long = "é<p>" * 400_000
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, "http://c/\r\nWARC-Type: evil", None), (4, None, ""), (5, "u", long), (6, "v", "\r\n\r\nWARC/1.1\r\n"), (6, "v", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "x"), (None, "n", "alone"), (9, "w", "y\0z"), (-3, "w", "y\0z")]
    path = f"{tmp_path}/archives"
    warc.archive(pages(spark, rows).repartition(3), path, roll_bytes=200)
    found = warc.records(spark, path)
    assert found.where("fault is not null or not digest_ok").count() == 0 and found.where("record_type = 'warcinfo'").count() > 1
    got = sorted((r.page_id or "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.verified) for r in warc.resolved(found).collect())
    best = {"x": 2, "": 4, "y\0z": 9}
    want = []
    for k, _, t in rows:
        t = t or ""
        to = best.get(t)
        to = str(to) if to not in (None, k) else None
        want.append((str(k) if k is not None else "", len(t.encode()), digest(t), "revisit" if to else "response", to, True))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3], r[4] or "", r[5])) or sorted(map(repr, got)) == sorted(map(repr, want))
    texts = {r.record_id: bytes(r.payload).decode() for r in found.where("record_type = 'response'").collect()}
    assert texts["<urn:page:5>"] == long and texts["<urn:page:4>"] == "" and texts["<urn:page:6>"] == "\r\n\r\nWARC/1.1\r\n"
    assert {r.target_uri for r in found.where("record_id = '<urn:page:3>'").collect()} == {"http://c/%0D%0AWARC-Type: evil"}
    for p in Path(path).glob("*.warc.gz"):  # any gzip reader reads them
        with gzip.open(p) as f:
            assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert not [p for p in Path(path).iterdir() if p.name.startswith(".") and p.is_dir()]


def test_offsets_open_single_records(spark, tmp_path):
    path = f"{tmp_path}/a"
    warc.archive(pages(spark, [(k, f"u{k}", f"text {k}") for k in range(20)]), path)
    for r in warc.records(spark, path, payload=False).where("record_type = 'response'").collect():
        assert r.payload is None
        with open(r.archive, "rb") as f:
            f.seek(r.offset)
            member = gzip.decompress(f.read(r.length))
        assert f"WARC-Record-ID: {r.record_id}\r\n".encode() in member and member.endswith(b"\r\n\r\n")


def test_small_payloads_are_no_revisits_and_text_ids(spark, tmp_path):
    docs = spark.createDataFrame([("b/ü", "u", "ab"), ("a", "u", "ab"), ("c", "u", "abcd"), ("d", "u", "abcd")], "page_id string, url string, html string")
    warc.archive(docs, f"{tmp_path}/a", least_bytes=3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.resolved(warc.records(spark, f"{tmp_path}/a")).collect()}
    assert got == {"b/ü": ("response", None), "a": ("response", None), "c": ("revisit", "d"), "d": ("response", None)}
    warc.archive(docs.where("page_id = 'a'"), f"{tmp_path}/a", mode="overwrite")
    assert [r.page_id for r in warc.resolved(warc.records(spark, f"{tmp_path}/a")).collect()] == ["a"]


def test_empty_tables(spark, tmp_path):
    warc.archive(pages(spark, []), f"{tmp_path}/none")
    assert warc.resolved(warc.records(spark, f"{tmp_path}/none")).count() == 0
    assert warc.records(spark, f"{tmp_path}/not-there").count() == 0


def read_all(data):
    m, out = warc.Members(io.BytesIO(data)), []
    while m.next():
        out.append(warc.read_record(m, True))
    return [(r[2], r[3], r[-2], r[-1]) for r in out]


def test_damage_costs_one_record():
    one, two, three = (warc.gzipped(warc.page_record(str(k), "u", f"payload {k} ".encode() * 500, None, "d"), 6) for k in range(3))
    good = read_all(one + two + three)
    assert [r[3] for r in good] == [None] * 3 and good[1][2] == b"payload 1 " * 500
    broken = two[:20] + bytes([two[20] ^ 255]) + two[21:]
    got = read_all(one + broken + three)
    assert [r[1] for r in got if r[3] is None] == ["<urn:page:0>", "<urn:page:2>"] and any(r[3] for r in got)
    assert [r[3] for r in read_all(one + two[:-30])] == [None, "gzip"]
    assert [r[3] for r in read_all(one + b"noise" + three)] == [None, None]
    plain = warc.page_record("7", "u", b"abc", None, "d")
    assert read_all(warc.gzipped(plain.replace(b"abc", b"abd"), 6))[0][3] == "digest"
    assert read_all(warc.gzipped(plain.replace(b"abc", b"abcd"), 6))[0][3] == "length"
    assert read_all(warc.gzipped(plain[:-8], 6))[0][3] == "length"
    assert read_all(warc.gzipped(b"no archive", 6))[0][3] == "header"
    assert read_all(warc.gzipped(plain.replace(b"Content-Length", b"Content-Lengths"), 6))[0][3] == "header"
    assert read_all(b"") == [] and read_all(b"plain text") == []
