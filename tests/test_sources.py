import ipaddress
import json
import struct

import pytest

from tidewatch.config import Settings
from tidewatch.sources import capture as captures
from tidewatch.sources import flowrec, pcap, tables

ETH = b"\0" * 12


def ip4(proto, body, src="10.10.0.5", dst="93.184.216.34", frag=0, ihl=5):
    return struct.pack("!BBHHHBBH4s4s", 0x40 + ihl, 0, ihl * 4 + len(body), 0, frag, 64, proto, 0, ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed) + b"\0" * (ihl * 4 - 20) + body


def ip6(nxt, body, src="2001:db8::5", dst="2001:db8::9"):
    return struct.pack("!IHBB16s16s", 6 << 28, len(body), nxt, 64, ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed) + body


def tcp(flags, sport=44_321, dport=443):
    return struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0)


def udp(sport=53, dport=5000):
    return struct.pack("!HHHH", sport, dport, 8, 0)


def eth(kind, body, tags=()):
    return ETH + b"".join(struct.pack("!HH", 0x8100, t) for t in tags) + struct.pack("!H", kind) + body


def capture(packets, end="<", magic=0xA1B2C3D4, linktype=1, fraction=250_000):
    out = struct.pack(end + "IHHiIII", magic, 2, 4, 0, 0, 65_535, linktype)
    for k, p in enumerate(packets):
        data, wire = p if isinstance(p, tuple) else (p, len(p))
        out += struct.pack(end + "IIII", 1_757_500_000 + k, fraction, len(data), wire) + data
    return out


def read(spark, tmp_path, content, name="a.pcap"):
    (tmp_path / name).write_bytes(content)
    return pcap.headers(pcap.read_records(spark, f"file://{tmp_path}/{name}")).orderBy("t_us").collect()


def test_headers(spark, tmp_path):
    ext = bytes([17, 0]) + b"\0" * 6
    packets = [
        eth(0x0800, ip4(6, tcp(2))), eth(0x0800, ip4(17, udp(), ihl=6), tags=(5, 6)), eth(0x86DD, ip6(0, ext + udp(1, 2))), eth(0x0806, b"\0" * 28), (eth(0x0800, ip4(6, tcp(2)))[:40], 54),
        eth(0x0800, ip4(17, udp(), frag=5)), eth(0x0800, ip4(1, b"\0" * 8)), eth(0x86DD, ip6(59, b"")), eth(0x0800, b"\x41" + ip4(6, tcp(2))[1:]), eth(0x0800, b"x"),
    ]
    r = read(spark, tmp_path, capture(packets))
    assert [x.reason for x in r] == [None, None, None, "not_ip", None, None, None, None, "ihl", "ipv4"]
    assert (r[0].src_ip, r[0].dst_ip, r[0].src_port, r[0].dst_port, r[0].tcp_flags, r[0].protocol) == ("10.10.0.5", "93.184.216.34", 44_321, 443, 2, 6)
    assert (r[1].src_port, r[1].vlans, r[1].tcp_flags) == (53, 2, None)
    assert (r[2].ip_version, r[2].src_ip, r[2].protocol, r[2].src_port) == (6, "2001:db8::5", 17, 1)
    assert r[4].transport_truncated and r[4].src_port is None and r[4].wirelen == 54
    assert r[5].fragmented and r[5].src_port is None and not r[5].transport_truncated
    assert r[6].protocol == 1 and r[6].src_port is None and r[7].protocol is None


@pytest.mark.parametrize("end,magic,fraction", [("<", 0xA1B2C3D4, 250_000), (">", 0xA1B2C3D4, 250_000), ("<", 0xA1B23C4D, 250_000_000), (">", 0xA1B23C4D, 250_000_000)])
def test_magics(spark, tmp_path, end, magic, fraction):
    r = read(spark, tmp_path, capture([eth(0x0800, ip4(17, udp()))], end, magic, fraction=fraction))
    assert r[0].t_us == 1_757_500_000_250_000 and r[0].src_port == 53


def test_broken_files_and_link_types(spark, tmp_path):
    good = eth(0x0800, ip4(17, udp()))
    whole = capture([good, good])
    faults = lambda content: [x.fault for x in read(spark, tmp_path, content)]
    assert faults(b"\x0a\x0d\x0d\x0a" + b"\0" * 40) == ["pcapng"] and faults(b"abc") == ["header"]
    assert sorted(map(str, faults(whole[:-5]))) == ["None", "record"] and sorted(map(str, faults(whole + b"1234"))) == ["None", "None", "record_header"]
    assert sorted(map(str, faults(capture([(good, 3), good])))) == ["None", "length"]
    raw = read(spark, tmp_path, capture([ip4(17, udp()), ip6(17, udp(7, 8))], linktype=101))
    assert [x.src_port for x in raw] == [53, 7]
    loop = read(spark, tmp_path, capture([struct.pack("<I", 2) + ip4(17, udp()), struct.pack(">I", 30) + ip6(17, udp(7, 8)), struct.pack("<I", 9) + b"x" * 30], linktype=0))
    assert [x.src_port for x in loop] == [53, 7, None] and loop[2].reason == "link"
    assert read(spark, tmp_path, capture([good], linktype=147))[0].reason == "linktype"
    (tmp_path / "b.pcap").write_bytes(whole)
    e = pcap.events(spark, f"file://{tmp_path}/b.pcap").orderBy("event_seq").collect()
    assert [(x.event_seq, x.protocol, x.direction, len(x.flow_id)) for x in e] == [(0, "UDP", "outbound", 16), (1, "UDP", "outbound", 16)]
    assert pcap.first_timestamp(pcap.read_records(spark, f"file://{tmp_path}/b.pcap")).first().t_us == 1_757_500_000_250_000


BASIC = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (2, 4), (1, 4)]


def template(own, fields):
    return struct.pack("!HH", own, len(fields)) + b"".join(struct.pack("!HH", *f) for f in fields)


def a_set(set_id, body):
    return struct.pack("!HH", set_id, len(body) + 4) + body


def record(src="10.10.0.5"):
    return ipaddress.ip_address(src).packed + ipaddress.ip_address("93.184.216.34").packed + struct.pack("!HHBII", 44_321, 443, 6, 10, 1500)


def ipfix(*body, export=1_757_500_000, domain=7):
    b = b"".join(body)
    return struct.pack("!HHIII", 10, 16 + len(b), export, 0, domain) + b


def v9(*body, uptime=60_000):
    return struct.pack("!HHIIII", 9, 1, uptime, 1_757_500_000, 0, 3) + b"".join(body)


def flows(spark, tmp_path, content):
    (tmp_path / "f.bin").write_bytes(content)
    return flowrec.events(spark, f"file://{tmp_path}/f.bin").orderBy("event_seq").collect()


def test_flow_records(spark, tmp_path):
    r = flows(spark, tmp_path, ipfix(a_set(2, template(256, BASIC)), a_set(256, record() + record("10.10.0.6"))))
    assert [(x.src_ip, x.dst_port, x.protocol, x.packets, x.bytes, x.direction, x.input_mode, x.t_us) for x in r] == [(s, 443, "TCP", 10, 1500, "outbound", "ipfix", 1_757_500_000_000_000) for s in ("10.10.0.5", "10.10.0.6")]
    # Data before its template, of another domain, or after it has expired is left out.
    assert flows(spark, tmp_path, ipfix(a_set(256, record()), a_set(2, template(256, BASIC)))) == []
    assert flows(spark, tmp_path, ipfix(a_set(2, template(256, BASIC))) + ipfix(a_set(256, record()), domain=8)) == []
    later = lambda s: flows(spark, tmp_path, ipfix(a_set(2, template(256, BASIC))) + ipfix(a_set(256, record()), export=1_757_500_000 + s))
    assert len(later(1800)) == 1 and later(1801) == []
    # A replaced template, a vendor's field, times and sampling.
    r = flows(spark, tmp_path, v9(a_set(0, template(256, BASIC)), a_set(0, template(256, [*BASIC, (21, 4), (34, 4), (6, 1)])), a_set(256, record() + struct.pack("!IIB", 50_000, 100, 2))))
    assert (r[0].t_us, r[0].exporter.sampling_rate, r[0].exporter.sampled, r[0].tcp_flags) == (1_757_499_990_000_000, 100, True, 2)
    vendor = struct.pack("!HH", 256, 8) + struct.pack("!HHI", 0x8001, 2, 99) + b"".join(struct.pack("!HH", *f) for f in BASIC)
    assert flows(spark, tmp_path, ipfix(a_set(2, vendor), a_set(256, b"zz" + record())))[0].src_ip == "10.10.0.5"
    six = [(27, 16), (28, 16), (4, 1)]
    r = flows(spark, tmp_path, ipfix(a_set(2, template(300, six)), a_set(300, ipaddress.ip_address("2001:db8::1").packed * 2 + b"\x11")))
    assert (r[0].src_ip, r[0].ip_version, r[0].protocol) == ("2001:db8::1", 6, "UDP")


def test_malformed_flow_records(spark, tmp_path):
    def faults(content):
        (tmp_path / "g.bin").write_bytes(content)
        s = flowrec.read_sets(spark, f"file://{tmp_path}/g.bin")
        return [r.fault for r in s.orderBy("event_seq").collect() if r.fault], [r.fault for r in flowrec.decoded(s).collect()]

    assert faults(b"\0\5abc")[0] == ["datagram"] and faults(ipfix(a_set(2, template(256, BASIC)))[:-3])[0] == ["datagram"]
    assert faults(ipfix(struct.pack("!HH", 256, 0)))[0] == ["set"] and faults(ipfix(a_set(3, b"opts")))[0] == ["options"]
    assert faults(ipfix(a_set(2, struct.pack("!HH", 256, 0))))[0] == ["template"]
    assert faults(ipfix(a_set(2, template(256, [(1, 0xFFFF)])), a_set(256, b"12345678")))[1] == ["template_length"]
    assert flows(spark, tmp_path, ipfix(a_set(2, template(256, [(4, 1)])), a_set(256, b"\6"))) == []  # no address


def test_tables(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"attack_id": "x", "ps_letter": "a", "key_ips": ["1.2.3.4"], "t_start": 1.5, "t_end": 2}]))
    assert tuple(tables.labels(spark, f"file://{tmp_path}/l.json").first()) == ("x", "a", ["1.2.3.4"], 1_500_000, 2_000_000)
    (tmp_path / "bad.json").write_text(json.dumps([{"attack_id": "x", "ps_letter": "q", "key_ips": [], "t_start": 1, "t_end": 2}]))
    with pytest.raises(Exception, match="bad label"):
        tables.labels(spark, f"file://{tmp_path}/bad.json").collect()
    (tmp_path / "n.csv").write_text("# list\n1,Google.com.\n2,nodot\n3,b.org\n4,google.com\n5,c.net\n")
    assert [r.name for r in tables.names(spark, f"file://{tmp_path}/n.csv", 2).collect()] == ["google.com", "b.org"]
    (tmp_path / "fp.json").write_text(json.dumps({"source": "s", "ja3": {"AB": 1.0}, "ja4": {"cd": 2.0}}))
    assert {tuple(r) for r in tables.fingerprint_baseline(spark, f"file://{tmp_path}/fp.json").collect()} == {("ja3", "ab", 1_000_000), ("ja4", "cd", 2_000_000)}
    a, b = (sorted(map(str, tables.synthetic_flows(spark, 100).repartition(k).collect())) for k in (1, 5))
    assert a == b and len(a) == 100


def split_read(spark, tmp_path, content, range_bytes, name="split.pcap"):
    (tmp_path / name).write_bytes(content)
    row = lambda r: (r.linktype, r["index"], r.t_us, r.caplen, r.wirelen, bytes(r.data) if r.data is not None else None, r.fault)
    got = [row(r) for r in captures.read_captures(spark, f"{tmp_path}/{name}", range_bytes).collect()]
    return sorted(got, key=repr), sorted((r[1:] for r in pcap.records("p", content)), key=repr)


def test_a_capture_in_ranges_has_the_records_of_one(spark, tmp_path):
    inner = capture([b"z" * 30] * 25)  # a capture within packets: headers where there are none
    packets = [eth(0x0800, ip4(6, tcp(2) + b"x" * (k * 7 % 90))) for k in range(40)] + [(inner, len(inner))] * 3 + [b"", (b"abc", 1), b"\0" * 700, b"\xff" * 300]
    whole = capture(packets)
    for content in (whole, capture(packets, end=">"), whole[:-3], whole + b"\0" * 9, whole[:2000] + b"\xff" * 20 + whole[2020:], whole[:24], whole[:10], b"", pcap.PCAPNG + b"\0" * 900, b"\0" * 900):
        got, want = split_read(spark, tmp_path, content, max(1, len(content) // 8))
        assert got == want
    got, want = split_read(spark, tmp_path, whole, 10**9)
    assert got == want


def test_written_captures_come_back(spark, tmp_path):
    rows = [(1_757_500_000_000_000 + k * 1_000_003, bytes([k]) * k) for k in range(60)]
    captures.write_captures(spark.createDataFrame(rows, "t_us long, data binary").repartition(3), f"{tmp_path}/out")
    got = captures.read_captures(spark, f"{tmp_path}/out", 512).collect()
    assert sorted((r.t_us, bytes(r.data)) for r in got) == rows and len({r.path for r in got}) == 3
    assert all(sorted(r["index"] for r in got if r.path == p) == list(range(sum(r.path == p for r in got))) for p in {r.path for r in got})


def test_thresholds_and_calibration_from_files(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("version: 1\nscan: {unique_dst_min: 7}\ntls_quic: {novelty_days: 2}\nlatency: {watermark_ms: 500, slo_p95_ms: 2000}\nc2: {cv_max: 0.2}\nthroughput: {sustain_seconds: 60}\n")
    got = Settings.load(str(tmp_path / "t.yaml"))
    assert (got.scan.min_hosts, got.scan.min_ports, got.tls.novelty_s, got.window.delay_s, got.c2.max_cv) == (7, 100, 172_800.0, 0.5, 0.2)
    assert got.ddos == Settings().ddos
    (tmp_path / "bad.yaml").write_text("scan: {unique_dest_min: 7}\n")
    with pytest.raises(ValueError):
        Settings.load(str(tmp_path / "bad.yaml"))
    (tmp_path / "c.json").write_text(json.dumps({"fitted": "x", "detectors": {"scan": {"a": 2.5, "b": -1}, "c2": {"a": 1.0}}}, indent=1))
    assert [tuple(r) for r in tables.calibration(spark, f"file://{tmp_path}/c.json").collect()] == [("scan", 2.5, -1.0)]
