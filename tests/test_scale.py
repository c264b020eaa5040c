"""What must not grow with the number of files, ranges or readers of a column."""

import os
import random

from pyspark.sql import functions as F

from flowbeam.sources import capture
from tests.conftest import SF_SMALL
from tests.wire import pcap_file, udp_frame, v5_packet, v5_record

PACKET = v5_packet([v5_record()])


def test_many_small_files_are_one_micro_batch(spark, tmp_dir):
    from flowbeam.sinks.ledger import Ledger
    from flowbeam.sources.flows import read_flows
    from flowbeam.streaming.ingest import start_capture_ingest

    landing, flows, rejects = (os.path.join(tmp_dir, d) for d in ("landing", "flows", "rejects"))
    os.makedirs(landing)
    for k in range(70):
        with open(os.path.join(landing, f"{k}.pcap"), "wb") as fh:
            fh.write(pcap_file([udp_frame(PACKET)]))
    start_capture_ingest(spark, landing, flows, rejects).awaitTermination()
    assert read_flows(spark, flows).count() == 70
    assert len(Ledger(spark, flows).closed()) == 1


def test_micro_batches_are_bounded_by_bytes(spark, tmp_dir):
    from flowbeam.sinks.ledger import Ledger
    from flowbeam.sources.flows import read_flows
    from flowbeam.streaming.ingest import start_capture_ingest

    landing, flows, rejects = (os.path.join(tmp_dir, d) for d in ("landing", "flows", "rejects"))
    os.makedirs(landing)
    one = pcap_file([udp_frame(PACKET)])
    for k in range(6):
        with open(os.path.join(landing, f"{k}.pcap"), "wb") as fh:
            fh.write(one)
    start_capture_ingest(spark, landing, flows, rejects, max_bytes_per_trigger=2 * len(one)).awaitTermination()
    assert read_flows(spark, flows).count() == 6
    assert 3 <= len(Ledger(spark, flows).closed()) <= 6


def _timed_file(seed, records):
    """Records of all years in no order, of many lengths."""
    rng, out = random.Random(seed), pcap_file([], little_endian=False)
    for _ in range(records):
        frame = udp_frame(v5_packet([v5_record(sport=rng.randrange(65536)) for _ in range(rng.randrange(1, 6))]))
        second = rng.randrange(700_000_000, 1_700_000_000)
        out += second.to_bytes(4, "big") + bytes(4) + len(frame).to_bytes(4, "big") * 2 + frame
    return out


def test_ranges_of_a_file_whose_times_are_in_no_order_take_few_turns(spark, tmp_dir, monkeypatch):
    data = _timed_file(5, 1500)
    with open(os.path.join(tmp_dir, "a.pcap"), "wb") as fh:
        fh.write(data)
    turns, dealt = [], capture._dealt
    monkeypatch.setattr(capture, "_dealt", lambda *a: turns.append(1) or dealt(*a))
    files = capture.scan_files(spark, tmp_dir)
    got = capture.frames_by_range(files, 16_384).orderBy("frame_no").collect()
    assert len(data) // 16_384 > 15 and len(turns) <= 4
    whole = capture.frames_by_range(files, 1 << 30).orderBy("frame_no").collect()
    assert len(whole) == 1500 and got == whole


def test_a_range_reads_little_beyond_its_end(tmp_dir):
    data, reads = _timed_file(6, 3000), []

    def fetch(offset, size):
        reads.append(size)
        return data[offset : offset + size]

    records = capture.Records(fetch, len(data), capture.CaptureHeader(data[:24]), 24, 65_536)
    assert sum(len(found) for _, _, found in records.blocks()) > 100
    assert sum(reads) <= 65_536 + capture.DECIDING_BYTES


def test_small_ranges_share_tasks(spark):
    files = spark.createDataFrame([("a", 500 << 16)], "path string, length long")
    assert capture._dealt(capture.file_ranges(files, 1 << 16), 1 << 16).rdd.getNumPartitions() <= 16


def test_capture_files_are_runs_of_a_partition(spark, tmp_dir):
    from flowbeam.sinks.capture import write_capture_files

    payloads = [bytes([k]) * (k + 30) if k % 5 else None for k in range(20)]
    packets = spark.createDataFrame([(p,) for p in payloads], "payload binary").coalesce(1)
    assert write_capture_files(packets, tmp_dir, frames_per_file=7) == 3
    names = sorted(n for n in os.listdir(tmp_dir) if n.endswith(".pcap"))
    assert names == [f"capture-00000-{run:012d}.pcap" for run in range(3)]
    good, bad = capture.read_capture(spark, tmp_dir)
    rows = good.orderBy("path", "frame_no").collect()
    assert [bytes(r.payload) for r in rows] == [p for p in payloads if p is not None] and bad.isEmpty()


def test_cut_and_other_frames_keep_their_lengths(spark, tmp_dir):
    from flowbeam.sinks.capture import TRANSPORTS, write_capture_files

    rows = [(bytes(n), t) for t in TRANSPORTS for n in (0, 1, 40)]
    write_capture_files(spark.createDataFrame(rows, "payload binary, transport string").coalesce(1), tmp_dir)
    frames = capture.frames_from_files(capture.scan_files(spark, tmp_dir)).orderBy("frame_no").collect()
    wanted = {"udp": None, "tcp": "not_udp", "ipv6": "not_ipv4", "ip_header": "bad_ip_header", "fragment": "fragment", "cut": "truncated_frame"}
    assert [f.reject_reason for f in frames] == [wanted[t] for _, t in rows]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_packet_is_built_once_however_often_it_is_read(spark):
    from flowbeam.plans.catalog import QUERIES

    assert _plan(QUERIES["v5_reject_counts"](spark, SF_SMALL)).count("array_join") <= 2


def test_an_address_is_parsed_once_however_often_it_is_read(spark):
    from flowbeam.plans.catalog import QUERIES

    assert _plan(QUERIES["ip_round_trip"](spark, SF_SMALL)).count("unhex") <= 2


def test_a_document_is_parsed_once_however_many_fields_are_read(spark):
    from flowbeam.sources.documents import split_lines

    docs, rejects = split_lines(spark.createDataFrame([('{"bytes":1}',), ("x",)], "value string"), keep_text=True)
    assert _plan(docs).count("from_json") == 1 and _plan(rejects).count("from_json") == 1


def test_columns_computed_once_keep_nulls_and_order(spark):
    from flowbeam.functions.once import computed_once

    df = spark.createDataFrame([(1, None), (None, 2)], "a int, b int")
    out = computed_once(df, b=F.col("b") + 1, c=F.col("a") * 2)
    assert out.columns == ["a", "b", "c"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None, 2), (None, 3, None)]
