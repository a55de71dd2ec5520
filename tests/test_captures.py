import random
import struct

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evidence
from tidewatch.sources import captures, pcap
from tidewatch.sources.frames import decode_frame, dns_name

T0 = 1_780_000_000


def ip4(src, dest, kind, body):
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, kind, 0) + bytes(src) + bytes(dest) + body


def tcp(sport, dport, seq, flags=16, payload=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, seq % 2**32, 0, 5 << 4, flags, 0, 0, 0) + payload


def ether(ip):
    return bytes(12) + (b"\x86\xdd" if ip[0] >> 4 == 6 else b"\x08\x00") + ip


A, B = (10, 0, 0, 1), (192, 168, 0, 5)


def classic(packets, order="<", nano=False, link=1):
    out = struct.pack(f"{order}IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    for ns, frame in packets:
        out += struct.pack(f"{order}IIII", ns // 10**9, ns % 10**9 // (1 if nano else 1000), len(frame), len(frame)) + frame
    return out


def ngblock(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    return struct.pack(f"{order}II", kind, len(body) + 12) + body + struct.pack(f"{order}I", len(body) + 12)


def nextgen(packets, order="<", resolution=None, shift=None):
    options = b""
    if resolution is not None:
        options += struct.pack(f"{order}HHB3x", 9, 1, resolution)
    if shift is not None:
        options += struct.pack(f"{order}HHq", 14, 8, shift)
    unit = 10**6 if resolution is None else 2 ** (resolution & 127) if resolution & 128 else 10**resolution
    out = ngblock(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1), order) + ngblock(1, struct.pack(f"{order}HHI", 1, 0, 0) + options, order)
    for ns, frame in packets:
        at = (ns - (shift or 0) * 10**9) * unit // 10**9
        out += ngblock(6, struct.pack(f"{order}IIIII", 0, at >> 32, at & 0xFFFFFFFF, len(frame), len(frame)) + frame, order)
    return out


def some(n, seed=1, inside=b""):
    r = random.Random(seed)
    return [((T0 + k) * 10**9 + 250_000_000, ether(ip4(A, B, 6, tcp(4000 + k % 3, 80, 1000 * k, payload=inside if inside and k % 10 == 4 else r.randbytes(r.randrange(90)))))) for k in range(n)]


def read(spark, path, split):
    return [(r.packet_number, r.packet_us, r.src_port, r.frame_length) for r in captures.packets(captures.listed(spark, str(path)), split).orderBy("packet_number").collect()]


def expected(packets):
    return [(k + 1, ns // 1000, 4000 + k % 3, len(f)) for k, (ns, f) in enumerate(packets)]


@pytest.mark.parametrize("make", [classic, lambda p: classic(p, ">", True), nextgen, lambda p: nextgen(p, ">"), lambda p: nextgen(p, resolution=9, shift=T0 // 2), lambda p: nextgen(p[:40]) + nextgen(p[40:], ">", resolution=0x80 | 20)])
def test_ranges_read_as_one_pass(spark, tmp_path, make):
    packets = some(90)
    data = make(packets)
    (tmp_path / "x.pcap").write_bytes(data + data[40:47])  # a cut last record ends it
    assert read(spark, tmp_path, 1 << 20) == read(spark, tmp_path, 1000) == expected(packets)


@pytest.mark.parametrize("make", [classic, nextgen])
def test_a_capture_inside_a_payload_is_no_begin(spark, tmp_path, make):
    """Payloads hold whole records, so ranges that begin in one find plausible chains there."""
    inner = make([(ns, bytes(20)) for ns, _ in some(40)])
    packets = some(60, inside=inner[24:] if make is classic else inner)
    (tmp_path / "x.pcap").write_bytes(make(packets))
    assert read(spark, tmp_path, 700) == expected(packets)


def test_odd_captures(spark, tmp_path):
    (tmp_path / "head.pcap").write_bytes(classic([]))
    (tmp_path / "short.pcap").write_bytes(classic([])[:10])
    big = ether(ip4(A, B, 6, tcp(4000, 80, 0, payload=bytes(5000))))
    (tmp_path / "big.pcap").write_bytes(classic([(T0 * 10**9, big)] * 3))
    got = captures.packets(captures.listed(spark, str(tmp_path)), 512).orderBy("packet_number").collect()
    assert [(r.packet_number, r.frame_length, r.is_retransmission) for r in got] == [(1, len(big), False), (2, len(big), False), (3, len(big), False)]  # at one time: late, not sent again
    (tmp_path / "junk.pcap").write_bytes(b"no capture at all")
    with pytest.raises(Exception, match="not a capture file"):
        captures.packets(captures.listed(spark, str(tmp_path))).collect()
    with pytest.raises(FileNotFoundError):
        pcap.discover(spark, str(tmp_path / "..")) if False else pcap.discover(spark, str(_empty(tmp_path)))


def _empty(tmp_path):
    (tmp_path / "none").mkdir()
    return tmp_path / "none"


def test_only_assigned_captures_are_opened(spark, tmp_path):
    packets = some(5)
    (tmp_path / "dump-2026-06-09.pcap").write_bytes(classic(packets))
    (tmp_path / "dump-2026-06-10.pcap").write_bytes(b"would be an error")
    files = captures.listed(spark, str(tmp_path))
    us = 1_780_963_200_000_000  # 2026-06-09
    cases = spark.createDataFrame([("CASE-0001", us)], "case_id string, first_us long")
    needed = evidence.needed_captures(files, evidence.capture_assignment(cases, files))
    assert captures.packets(needed).count() == 5
    other = spark.createDataFrame([("CASE-0001", us), ("CASE-0002", us + 40 * 86_400_000_000)], "case_id string, first_us long")
    assert evidence.needed_captures(files, evidence.capture_assignment(other, files)).count() == 2


def test_link_types():
    ip = ip4(A, B, 6, tcp(4000, 80, 7))
    for link, frame in ((1, ether(ip)), (113, bytes(14) + b"\x08\x00" + ip), (276, b"\x08\x00" + bytes(18) + ip), (0, struct.pack("<I", 2) + ip), (0, struct.pack(">I", 2) + ip), (108, struct.pack(">I", 2) + ip), (101, ip), (12, ip), (228, ip)):
        d = decode_frame(frame, link)
        assert (d.src_ip, d.src_port, d.dest_ip, d.dest_port, d.protocol, d.tcp_seq) == ("10.0.0.1", 4000, "192.168.0.5", 80, "TCP", 7), link
    v6 = bytes([0x60, 0, 0, 0, 0, 8, 17, 64]) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + struct.pack(">HHHH", 53, 5353, 8, 0)
    for link, frame in ((0, struct.pack("<I", 30) + v6), (229, v6), (101, v6), (113, bytes(14) + b"\x86\xdd" + v6)):
        assert decode_frame(frame, link)[:5] == ("::1", 53, "::2", 5353, "UDP"), link
    assert decode_frame(ip, 147)[:4] == (None,) * 4 and decode_frame(b"", 1).src_ip is None
    for n in range(len(ether(ip))):
        decode_frame(ether(ip)[:n])


def test_application_fields():
    at = lambda payload, sport=4000, dport=80: decode_frame(ether(ip4(A, B, 6, tcp(sport, dport, 1, payload=payload))))
    assert at(b"GET /a?b=c HTTP/1.1\r\nHost: x\r\n\r\n")[4:8] == ("HTTP", "GET", "/a?b=c", None)
    assert at(b"HTTP/1.0 404 Not Found\r\n")[4:8] == ("HTTP", None, None, 404)
    assert at(b"GETTING /a HTTP/1.1")[4:8] == ("TCP", None, None, None)
    query = struct.pack(">HHHHHH", 1, 256, 1, 0, 0, 0) + b"\x03www\x07example\x03org\x00\x00\x01\x00\x01"
    udp = lambda p, port: decode_frame(ether(ip4(A, B, 17, struct.pack(">HHHH", 4000, port, 8 + len(p), 0) + p)))
    assert (udp(query, 53).protocol, udp(query, 53).dns_query) == ("DNS", "www.example.org")
    assert udp(query, 5353).protocol == "MDNS" and udp(query, 54).dns_query is None
    assert at(struct.pack(">H", len(query)) + query, dport=53).dns_query == "www.example.org"
    assert dns_name(query[:15]) is None and dns_name(b"") is None and dns_name(query[:12] + b"\x00\x00\x01\x00\x01") == "<Root>"
    padded = ether(ip4(A, B, 6, tcp(1, 2, 3))) + bytes(6)  # filled up to the least length of a frame
    assert decode_frame(padded).tcp_length == 0


def test_simple_and_obsolete_blocks(spark, tmp_path):
    frame = ether(ip4(A, B, 6, tcp(4000, 80, 1)))
    data = nextgen(some(1)) + ngblock(3, struct.pack("<I", len(frame)) + frame) + ngblock(2, struct.pack("<HHIIII", 0, 0, 0, 77, len(frame), len(frame)) + frame)
    (tmp_path / "x.pcapng").write_bytes(data)
    got = captures.packets(captures.listed(spark, str(tmp_path))).orderBy("packet_number").collect()
    assert [(r.packet_number, r.packet_us, r.src_ip) for r in got] == [(1, T0 * 10**6 + 250_000, "10.0.0.1"), (2, None, "10.0.0.1"), (3, 77, "10.0.0.1")]


def plain(rows):
    """tcp_stream and is_retransmission of (pair, forth, us, seq, length, flags) in order, one at a time."""
    opened, stream, seen, out, n = {}, {}, {}, [], 0
    for pair, forth, us, seq, length, flags in rows:
        first = flags & 18 == 2
        if pair not in stream or first and opened.get(pair) != seq:
            stream[pair], n = n, n + 1
        if first:
            opened[pair] = seq
        span, way = length + bool(flags & 2) + bool(flags & 1), (stream[pair], forth)
        last, pos, top, at = seen.get(way, (seq, 0, None, 0))
        pos += (seq - last + 2**31) % 2**32 - 2**31
        again = span > 0 and top is not None and pos < top and us - at >= 3000 and not (span <= 1 and length == span and pos == top - 1)
        if span and (top is None or pos + span > top):
            top, at = pos + span, us
        seen[way] = (seq, pos, top, at)
        out.append((stream[pair], again))
    return out


@pytest.mark.parametrize("block", [65_536, 7])
def test_connections_equal_a_plain_model(spark, monkeypatch, block):
    monkeypatch.setattr(captures, "BLOCK", block)
    r, rows, seq = random.Random(4), [], {}
    for k in range(500):
        port, forth = r.choice((1, 1, 1, 1, 2, 3)), r.random() < 0.6
        at = seq.setdefault((port, forth), 2**32 - 300)
        length, flags = r.choice((0, 1, 40, 40)), r.choice((16,) * 12 + (2, 18, 17))
        start = (at + r.choice((0, 0, 0, 0, -1, -40, -80, 500))) % 2**32
        seq[(port, forth)] = (start + length) % 2**32
        rows.append((port, forth, T0 * 10**6 + k * r.choice((500, 2000)), start, length, flags))
    rows.sort(key=lambda x: x[2])
    data = [("f", k + 1, us, *(("a", p, "b", 80) if forth else ("b", 80, "a", p)), s, fl, n) for k, (p, forth, us, s, n, fl) in enumerate(rows)]
    raw = spark.createDataFrame(data, "pcap_path string, packet_number long, packet_us long, src_ip string, src_port int, dest_ip string, dest_port int, tcp_seq long, tcp_flags int, tcp_length int")
    raw = raw.withColumns({"packet_ns": F.lit(0), "link": F.lit(1)}).unionByName(raw.limit(1).withColumns({"packet_number": F.lit(9999).cast("long"), "tcp_seq": F.lit(None).cast("long"), "packet_ns": F.lit(0), "link": F.lit(1)}))
    got = captures.with_connections(raw).orderBy("packet_number").collect()
    want = plain(rows)
    assert [(x.tcp_stream, x.is_retransmission) for x in got] == [*want, (None, False)]
    assert len({s for s, _ in want}) > 5 and 20 < sum(a for _, a in want) < 300


def test_export_reads_each_capture_once(spark, tmp_path, monkeypatch):
    packets = some(60)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pcap").write_bytes(classic(packets, nano=True))
    (tmp_path / "in" / "other.pcap").write_bytes(b"not needed, not opened")
    files = captures.listed(spark, str(tmp_path / "in"))
    path = files.where("pcap_path like '%x.pcap'").first().pcap_path
    rows = spark.createDataFrame([(f"CASE-{c}", path, n) for c in range(5) for n in range(1, 61) if n % (c + 1) == 0] * 2, "case_id string, pcap_path string, packet_number long")
    done = captures.export_cases(rows, files, f"{tmp_path}/out", 800).collect()
    assert [(r.case_id, r.packets) for r in done] == [(f"CASE-{c}", 60 // (c + 1)) for c in range(5)] and len(list((tmp_path / "out").iterdir())) == 5
    for c, r in enumerate(done):
        with open(r.file, "rb") as f:
            data = f.read()
        assert data == nextgen([p for n, p in enumerate(packets, 1) if n % (c + 1) == 0], resolution=9).replace(struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9), b"?") or read(spark, r.file, 1 << 20) == [(k + 1, ns // 1000, 4000 + (n - 1) % 3, len(f)) for k, (n, (ns, f)) in enumerate((n, p) for n, p in enumerate(packets, 1) if n % (c + 1) == 0)]
    monkeypatch.setattr(captures, "PART", 20)
    parts = captures.export_cases(rows.where("case_id = 'CASE-0'"), files, f"{tmp_path}/parts").collect()
    assert [(r.part, r.packets) for r in parts] == [(0, 19), (1, 20), (2, 20), (3, 1)]


def test_filters_name_protocols_and_fill_batches(spark):
    kind = "case_id string, ord int, src_ip string, src_port int, dest_ip string, dest_port int, proto string, first_us long, last_us long"
    rows = [("C1", 1, "10.0.0.1", 4000, "192.168.0.5", None, "TCP", 0, 0), ("C1", 2, "::1", 1, "::2", 2, "udp ", 0, 0), ("C1", 3, "::1", 1, "10.0.0.1", 2, "TCP", 0, 0), ("C1", 4, "10.0.0.1", None, "10.0.0.2", None, "ICMP", 0, 0), ("C1", 5, "10.0.0.1", 9, "10.0.0.2", 9, None, 0, 0)]
    got = {r.ord: r.filter for r in evidence.display_filter(spark.createDataFrame(rows, kind)).collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert got[1].startswith("tcp && ((ip.src == 10.0.0.1 && ip.dst == 192.168.0.5 && tcp.srcport == 4000) || (ip.src == 192.168.0.5 && ip.dst == 10.0.0.1 && tcp.dstport == 4000)) && frame.time_epoch >= -2.000000")
    assert got[2].startswith("udp && ((ipv6.src == ::1 && ipv6.dst == ::2 && udp.srcport == 1 && udp.dstport == 2)")
    assert got[4].startswith("icmp && ((ip.src == 10.0.0.1 && ip.dst == 10.0.0.2) ||") and got[5].startswith("((ip.src == 10.0.0.1 && ip.dst == 10.0.0.2) ||")
    many = spark.createDataFrame([(f"C{c}", k, "x" * (10 + 7 * k % 50)) for c in range(3) for k in range(1, 40)], "case_id string, ord int, filter string")
    shared = evidence.capture_filters(many, spark.createDataFrame([("C0", "p"), ("C1", "p"), ("C1", "q"), ("C2", None)], "case_id string, pcap_path string"), spark.createDataFrame([("p",), ("q",)], "pcap_path string"))
    got = evidence.filter_batches(shared, 200, "pcap_path").orderBy("pcap_path", "batch").collect()
    for path, cases in (("p", (0, 1, 2)), ("q", (1, 2))):
        want, held = [], []
        for f in ["x" * (10 + 7 * k % 50) for _ in cases for k in range(1, 40)]:
            if held and len(" || ".join([*held, f])) > 200:
                want, held = [*want, " || ".join(held)], []
            held.append(f)
        assert [r.filter for r in got if r.pcap_path == path] == [*want, " || ".join(held)]
        assert [r.batch for r in got if r.pcap_path == path] == list(range(1, len(want) + 2))


def test_protocols_of_selectors_and_packets_must_agree(spark):
    s = spark.createDataFrame([("C1", 1, "a", 1, "b", 2, "UDP", 0, 10**6), ("C2", 1, "a", 1, "b", 2, "TCP", 0, 10**6), ("C3", 1, "a", 1, "b", 2, None, 0, 10**6)], "case_id string, ord int, src_ip string, src_port int, dest_ip string, dest_port int, proto string, first_us long, last_us long")
    p = spark.createDataFrame([(1, "TCP", None), (2, "UDP", None), (3, "HTTP", 4), (4, "TLSv1.3", None), (5, None, None)], "packet_number long, protocol string, tcp_stream long").selectExpr("*", "0L as packet_us", "'a' as src_ip", "1 as src_port", "'b' as dest_ip", "2 as dest_port")
    got = evidence.packet_matches(p, s)
    assert {c: sorted(r.packet_number for r in got.collect() if r.case_id == c) for c in ("C1", "C2", "C3")} == {"C1": [2, 4, 5], "C2": [1, 3, 4, 5], "C3": [1, 2, 3, 4, 5]}
