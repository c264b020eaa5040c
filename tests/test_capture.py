import os

import pytest

from flowbeam.plans.ingest import decode_frames, ingest_captures
from flowbeam.sources.capture import FILE_REJECTS, FRAME_REJECTS, frames_from_files, scan_files
from flowbeam.sources.flows import read_flows
from tests.wire import pcap_file, udp_frame, v5_packet, v5_record

GOOD = v5_packet([v5_record(sport=1), v5_record(sport=2)])


def write(dir_, name, data):
    os.makedirs(dir_, exist_ok=True)
    with open(os.path.join(dir_, name), "wb") as fh:
        fh.write(data)


def frames(spark, dir_):
    rows = frames_from_files(scan_files(spark, dir_)).collect()
    return sorted(((os.path.basename(r.path), r.frame_no, r.reject_reason, r.payload) for r in rows))


@pytest.mark.parametrize("little_endian,nanos", [(True, False), (False, False), (True, True), (False, True)])
def test_byte_orders_and_resolutions(spark, tmp_dir, little_endian, nanos):
    write(tmp_dir, "a.pcap", pcap_file([udp_frame(GOOD)], little_endian=little_endian, nanos=nanos))
    rows = frames_from_files(scan_files(spark, tmp_dir)).collect()
    assert len(rows) == 1 and rows[0].payload == GOOD and rows[0].reject_reason is None
    assert rows[0].ts_ms == 1185488138000 + (0 if nanos else 0)  # 123 us / 123 ns -> 0 ms


def test_frame_kinds(spark, tmp_dir):
    frames_ = [
        udp_frame(GOOD),                              # 0 good
        udp_frame(GOOD, proto=6),                     # 1 TCP -> not_udp
        udp_frame(b"\x00\x09junk"),                   # 2 UDP with a bad v5 payload
        udp_frame(GOOD, vlan=True),                   # 3 802.1Q tag
        udp_frame(GOOD, ip_options=b"\x01" * 8),      # 4 IP options
        udp_frame(GOOD, frag=0x2000),                 # 5 more-fragments -> fragment
        b"\x00" * 12 + b"\x86\xdd" + b"\x60" + b"\x00" * 39,  # 6 IPv6 -> not_ipv4
    ]
    write(tmp_dir, "b.pcap", pcap_file(frames_))
    got = {no: (reason, payload) for _, no, reason, payload in frames(spark, tmp_dir)}
    assert got[0] == (None, GOOD) and got[3] == (None, GOOD) and got[4] == (None, GOOD)
    assert got[1][0] == "not_udp" and got[5][0] == "fragment" and got[6][0] == "not_ipv4"
    assert got[2] == (None, b"\x00\x09junk")


def test_damaged_files(spark, tmp_dir):
    whole = pcap_file([udp_frame(GOOD), udp_frame(GOOD)])
    write(tmp_dir, "cut.pcap", whole[:-5])
    write(tmp_dir, "empty.pcap", b"")
    write(tmp_dir, "magic.pcap", b"\x00" * 40)
    write(tmp_dir, "short.pcap", b"\xd4\xc3\xb2\xa1")
    got = frames(spark, tmp_dir)
    assert {r for _, _, r, _ in got if r} <= set(FILE_REJECTS + FRAME_REJECTS)
    assert [(n, no, r) for n, no, r, _ in got] == [
        ("cut.pcap", 0, None), ("cut.pcap", 1, "truncated_frame"),
        ("magic.pcap", 0, "bad_magic"), ("short.pcap", 0, "truncated_header"),
    ]


def test_ingest_writes_flows_and_rejects(spark, tmp_dir):
    caps = os.path.join(tmp_dir, "caps")
    write(caps, "c.pcap", pcap_file([udp_frame(GOOD), udp_frame(GOOD, proto=6), udp_frame(b"\x00\x09xx")]))
    counts = ingest_captures(spark, caps, os.path.join(tmp_dir, "flows"), os.path.join(tmp_dir, "rejects"))
    assert (counts.flows, counts.rejects) == (2, 2)
    flows = read_flows(spark, os.path.join(tmp_dir, "flows")).collect()
    assert sorted(r.src_port for r in flows) == [1, 2]
    assert {(r.year, r.month, r.day) for r in flows} == {(2007, 7, 26)}
    rejects = spark.read.parquet(os.path.join(tmp_dir, "rejects")).collect()
    assert sorted(r.reject_reason for r in rejects) == ["bad_version", "not_udp"]


def test_decode_frames_schema(spark, tmp_dir):
    write(tmp_dir, "d.pcap", pcap_file([udp_frame(GOOD)]))
    flows, rejects = decode_frames(frames_from_files(scan_files(spark, tmp_dir)))
    assert flows.count() == 2 and rejects.count() == 0


# -- byte ranges of one file ---------------------------------------------------------------------


def kinds_of_frames():
    """One frame for each outcome, in the order of FRAME_REJECTS after a good one."""
    return [
        udp_frame(GOOD), b"\x00" * 12 + b"\x08", b"\x00" * 12 + b"\x86\xdd" + b"\x60" + b"\x00" * 39,
        udp_frame(GOOD)[:14] + b"\x44" + udp_frame(GOOD)[15:], udp_frame(GOOD, frag=0x2000), udp_frame(GOOD, proto=6),
        udp_frame(b""), udp_frame(GOOD, vlan=True)[:17], udp_frame(GOOD)[:-1], b"", udp_frame(GOOD, ip_options=b"\x01" * 40),
    ]


def straight(data, name):
    """(file, frame_no, ts_ms, reason, payload) by one plain walk over the bytes."""
    import struct

    if not data:
        return []
    if len(data) < 24:
        return [(name, 0, None, "truncated_header", None)]
    order = {b"\xa1\xb2": ">", b"\xd4\xc3": "<", b"\x4d\x3c": "<"}[data[:2]]
    nanos = data[:4] in (b"\xa1\xb2\x3c\x4d", b"\x4d\x3c\xb2\xa1")
    link, out, at = struct.unpack(order + "I", data[20:24])[0], [], 24
    while at < len(data):
        if at + 16 > len(data):
            return [*out, (name, len(out), None, "truncated_frame", None)]
        sec, frac, kept, _ = struct.unpack(order + "IIII", data[at : at + 16])
        ms = sec * 1000 + frac // (1_000_000 if nanos else 1000)
        if at + 16 + kept > len(data):
            return [*out, (name, len(out), ms, "truncated_frame", None)]
        out.append((name, len(out), ms, *plain_payload(data[at + 16 : at + 16 + kept], link)))
        at += 16 + kept
    return out


def plain_payload(frame, link):
    if link == 1:
        tagged = frame[12:14] == b"\x81\x00"
        if len(frame) < (18 if tagged and len(frame) >= 14 else 14):
            return "truncated_frame", None
        if frame[16 if tagged else 12 :][:2] != b"\x08\x00":
            return "not_ipv4", None
        frame = frame[18 if tagged else 14 :]
    elif link not in (101, 228):
        return "unsupported_link", None
    if len(frame) < 20:
        return "truncated_frame", None
    header = (frame[0] & 15) * 4
    if frame[0] >> 4 != 4:
        return "not_ipv4", None
    if header < 20:
        return "bad_ip_header", None
    if int.from_bytes(frame[6:8], "big") & 0x3FFF:
        return "fragment", None
    if frame[9] != 17:
        return "not_udp", None
    length = int.from_bytes(frame[header + 4 : header + 6], "big")
    if len(frame) < header + 8 or length < 8 or len(frame) < header + length:
        return "truncated_frame", None
    return None, frame[header + 8 : header + length]


def by_ranges(spark, dir_, range_bytes, block=4 << 20):
    from flowbeam.sources.capture import frames_by_range

    rows = frames_by_range(scan_files(spark, dir_), range_bytes, block).collect()
    return sorted((os.path.basename(r.path), r.frame_no, r.ts_ms, r.reject_reason, r.payload and bytes(r.payload)) for r in rows)


def ranged_files():
    import random

    rng = random.Random(4)
    frames_ = [rng.choice(kinds_of_frames()) for _ in range(300)]
    whole = pcap_file(frames_)
    inner = pcap_file([udp_frame(GOOD)] * 12)[24:]  # records inside a datagram, as a guess would like them
    return {
        "plain name %41.pcap": whole, "big.pcap": pcap_file(frames_, little_endian=False, nanos=True), "raw.pcap": pcap_file([f[14:] for f in frames_], link_type=101),
        "link.pcap": pcap_file(frames_[:40], link_type=105), "cut.pcap": whole[:-7], "cuthead.pcap": pcap_file(frames_[:99]) + b"\x00" * 9,
        "false.pcap": pcap_file([udp_frame(inner), udp_frame(GOOD), udp_frame(inner * 3)] * 5), "long.pcap": pcap_file([bytes(300_000), udp_frame(GOOD), udp_frame(bytes(60_000)), udp_frame(GOOD)] * 2),
        "lost.pcap": whole[:9000] + b"\xff" * 40 + whole[9000:], "empty.pcap": b"", "short.pcap": b"\xd4\xc3", "header.pcap": whole[:24],
    }


@pytest.mark.parametrize("range_bytes,block", [(12_000, 300), (65_536, 4 << 20), (1 << 30, 4 << 20)])
def test_ranges_equal_one_walk(spark, tmp_dir, range_bytes, block):
    files = ranged_files()
    for name, data in files.items():
        write(tmp_dir, name, data)
    wanted = sorted(row for name, data in files.items() for row in straight(data, name))
    assert by_ranges(spark, tmp_dir, range_bytes, block) == wanted


def test_unreadable_file_of_several_ranges(spark, tmp_dir):
    write(tmp_dir, "magic.pcap", b"\x01" * 10_000)
    assert by_ranges(spark, tmp_dir, 1000) == [("magic.pcap", 0, None, "bad_magic", None)]


def test_whole_contents_equal_ranges(spark, tmp_dir):
    from flowbeam.sources.capture import frames_of_contents

    for name, data in ranged_files().items():
        write(tmp_dir, name.replace("%", ""), data)
    rows = frames_of_contents(spark.read.format("binaryFile").load(tmp_dir)).collect()
    got = sorted((os.path.basename(r.path), r.frame_no, r.ts_ms, r.reject_reason, r.payload and bytes(r.payload)) for r in rows)
    assert got == by_ranges(spark, tmp_dir, 1 << 20)


def test_one_file_is_read_by_many_tasks_block_by_block(spark, tmp_dir):
    from flowbeam.sources import capture

    data = pcap_file([udp_frame(GOOD)] * 4000)
    write(tmp_dir, "a.pcap", data)
    parts = capture.frames_by_range(scan_files(spark, tmp_dir), len(data) // 8)
    from pyspark.sql import functions as F

    assert parts.select(F.spark_partition_id().alias("p")).distinct().count() > 5
    asked = []
    records = capture.Records(lambda at, n: asked.append(n) or data[at : at + n], len(data), capture.CaptureHeader(data[:24]), 24, len(data), 10_000)
    assert sum(len(o) for _, _, o in records.blocks()) == 4000 and max(asked) == 10_000
    # of a record of any length only what decides on it is read
    huge = pcap_file([bytes(1 << 22), udp_frame(GOOD)])
    asked.clear()
    records = capture.Records(lambda at, n: asked.append(n) or huge[at : at + n], len(huge), capture.CaptureHeader(huge[:24]), 24, len(huge), 10_000)
    assert sum(len(o) for _, _, o in records.blocks()) == 2 and max(asked) == capture.DECIDING_BYTES


def planted_guess(tail):
    """A datagram that holds a row of record headers, the last of which lies about its length."""
    import struct

    inner = b"".join(struct.pack("<IIII", 1185488138, 0, 8, 8) + bytes(8) for _ in range(9))
    return udp_frame(inner + struct.pack("<IIII", 1185488138, 0, tail, tail) + bytes(1200))


@pytest.mark.parametrize("tail", [200_000, 700])
def test_a_wrong_guess_costs_its_own_range_a_turn(spark, tmp_dir, monkeypatch, tail):
    from flowbeam.sources import capture

    data = pcap_file([udp_frame(GOOD)] * 30 + [planted_guess(tail)] * 8 + [udp_frame(GOOD)] * 1500)
    write(tmp_dir, "a.pcap", data)
    turns, real = [], capture._map_ranges

    def counted(ranges, work, schema):
        turns.append(schema)
        assert len(turns) < 12, "a turn a range"
        return real(ranges, work, schema)

    monkeypatch.setattr(capture, "_map_ranges", counted)
    assert by_ranges(spark, tmp_dir, 2000) == sorted(straight(data, "a.pcap"))


def test_ranges_without_any_guess_take_few_turns(spark, tmp_dir, monkeypatch):
    import struct

    from flowbeam.sources import capture

    # no header is plausible: the length on the wire is less than what was kept
    frame = udp_frame(GOOD)
    data = pcap_file([])[:24] + (struct.pack("<IIII", 1185488138, 0, len(frame), 0) + frame) * 700
    write(tmp_dir, "a.pcap", data)
    turns, real = [], capture._map_ranges

    def counted(ranges, work, schema):
        turns.append(schema)
        assert len(turns) < 12, "a turn a range"
        return real(ranges, work, schema)

    monkeypatch.setattr(capture, "_map_ranges", counted)
    assert by_ranges(spark, tmp_dir, 2000) == sorted(straight(data, "a.pcap"))
