import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowbeam.operators.decode import REJECT_REASONS, V5_HEADER_EXTRA, decode, decode_v5
from flowbeam.operators.encode import encode_v5
from flowbeam.schema import FLOW_COLUMNS, PAYLOAD_SCHEMA
from flowbeam.sources.testviews import flows_view
from tests.conftest import SF_SMALL
from tests.wire import v5_packet, v5_record


def run(spark, payloads):
    df = spark.createDataFrame([("p", i, p) for i, p in enumerate(payloads)], PAYLOAD_SCHEMA)
    flows, rejects = decode_v5(df)
    return flows.orderBy("frame_no", "src_port").collect(), {r.frame_no: r.reject_reason for r in rejects.collect()}


def test_good_packets(spark):
    good2 = v5_packet([v5_record(sport=1), v5_record(sport=2)])
    good30 = v5_packet([v5_record(sport=i) for i in range(30)])
    trailing = v5_packet([v5_record(sport=7)]) + b"\x00" * 10
    assert len(good2) == 120 and len(good30) == 1464
    flows, rejects = run(spark, [good2, good30, trailing])
    assert rejects == {}
    counts = {}
    for r in flows:
        counts[r.frame_no] = counts.get(r.frame_no, 0) + 1
    assert counts == {0: 2, 1: 30, 2: 1}


@pytest.mark.parametrize(
    "payload,reason",
    [
        (v5_packet([v5_record()] * 2, version=9), "bad_version"),
        (v5_packet([v5_record()], count=0), "bad_count"),
        (v5_packet([v5_record()], count=31), "bad_count"),
        (v5_packet([v5_record()] * 3)[:72], "underflow"),
        (b"", "underflow"),
        (b"\x00", "underflow"),
        (b"\x00\x05\x00", "underflow"),
        (v5_packet([v5_record()], nsecs=1_000_000_000), "bad_nanoseconds"),
    ],
)
def test_rejects(spark, payload, reason):
    flows, rejects = run(spark, [payload])
    assert flows == [] and rejects == {0: reason}


def test_unsigned_fields_and_times(spark):
    rec = v5_record(src="203.0.113.132", dst="198.51.100.137", sport=65535, dport=6667,
                    packets=4_000_000_001, octets=4_000_000_000, first=1001, last=1501, prot=200)
    pkt = v5_packet([rec], uptime=3_000_000_000, secs=1185488138, nsecs=123_000_000)
    (row,), _ = run(spark, [pkt])
    assert (row.src_addr, row.dst_addr, row.src_port, row.dst_port) == ("203.0.113.132", "198.51.100.137", 65535, 6667)
    assert (row.bytes, row.packets, row.protocol) == (4_000_000_000, 4_000_000_001, 200)
    assert (row.time_ms, row.duration_ms) == (1182488139124, 500)


def test_all_fields(spark):
    rec = v5_record(nexthop="1.2.3.4", input_if=3, output_if=4, tcp_flags=0x12, tos=5, src_as=65000,
                    dst_as=7, src_mask=24, dst_mask=16)
    pkt = v5_packet([rec], sequence=77, engine_type=1, engine_id=2, sampling=(1 << 14) | 100)
    df = spark.createDataFrame([("p", 0, pkt)], PAYLOAD_SCHEMA)
    flows = decode_v5(df, all_fields=True)[0]
    assert set(V5_HEADER_EXTRA) <= set(flows.columns)
    r = flows.first()
    assert (r.next_hop, r.input_if, r.output_if, r.tcp_flags, r.tos) == ("1.2.3.4", 3, 4, 0x12, 5)
    assert (r.src_as, r.dst_as, r.src_mask, r.dst_mask) == (65000, 7, 24, 16)
    assert (r.flow_sequence, r.engine_type, r.engine_id, r.sampling_mode, r.sampling_interval) == (77, 1, 2, 1, 100)


def test_round_trip_over_lineitem_flows(spark):
    flows = flows_view(spark, SF_SMALL, keep_keys=False)
    decoded, rejects = decode(encode_v5(flows).select("payload"))
    assert rejects.count() == 0
    a, b = flows.select(*FLOW_COLUMNS), decoded.select(*FLOW_COLUMNS)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_decoder_registry_checks_output():
    with pytest.raises(ValueError):
        decode(None, "v9")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(min_size=0, max_size=200), min_size=1, max_size=8),
       st.lists(st.integers(0, 3), min_size=1, max_size=8))
def test_property_each_packet_rejected_once_or_fully_decoded(spark, blobs, counts):
    # random bytes, plus well-formed headers with random counts and truncations
    payloads = list(blobs)
    for c, blob in zip(counts, blobs):
        payloads.append(v5_packet([v5_record()] * c, count=c)[: 24 + 48 * c - (len(blob) % 3)])
    df = spark.createDataFrame([("p", i, p) for i, p in enumerate(payloads)], PAYLOAD_SCHEMA)
    flows, rejects = decode_v5(df)
    n_flows = {r.frame_no: r["count"] for r in flows.groupBy("frame_no").count().collect()}
    rej_rows = rejects.collect()
    rej = [r.frame_no for r in rej_rows]
    assert len(rej) == len(set(rej))
    assert {r.reject_reason for r in rej_rows} <= set(REJECT_REASONS)
    for i, p in enumerate(payloads):
        declared = int.from_bytes(p[2:4], "big") if len(p) >= 4 else None
        if i in rej:
            assert i not in n_flows
        else:
            assert n_flows.get(i) == declared


FLOW_ROWS = st.lists(
    st.tuples(
        st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1),      # addresses as numbers
        st.integers(0, 65535), st.integers(0, 65535),              # ports
        st.integers(946684800000, 4102444800000),                  # start 2000..2100
        st.integers(0, 3_600_000),                                 # duration up to an hour
        st.integers(0, 255),                                       # protocol
        st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1),      # bytes, packets
    ),
    min_size=1, max_size=70,
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(FLOW_ROWS)
def test_property_encode_decode_round_trip(spark, rows):
    import ipaddress

    from flowbeam.schema import FLOW_SCHEMA

    data = [(str(ipaddress.IPv4Address(a)), str(ipaddress.IPv4Address(b)), sp, dp, t, d, p, by, pk)
            for a, b, sp, dp, t, d, p, by, pk in rows]
    flows = spark.createDataFrame(data, FLOW_SCHEMA).repartition(3)
    decoded, rejects = decode(encode_v5(flows).select("payload"))
    assert rejects.count() == 0
    assert sorted(tuple(r) for r in decoded.select(*FLOW_COLUMNS).collect()) == sorted(data)


def test_hot_packet_key_is_cut_into_runs(spark):
    from pyspark.sql import functions as F

    from flowbeam.operators.encode import encode_v5

    rows = spark.range(1000).select(
        F.lit("10.0.0.1").alias("src_addr"), F.lit("10.0.0.2").alias("dst_addr"), F.lit(1).alias("src_port"),
        F.lit(2).alias("dst_port"), (F.col("id") + 1_000_000).alias("time_ms"), F.lit(5).cast("long").alias("duration_ms"),
        F.lit(6).alias("protocol"), F.lit(10).cast("long").alias("bytes"), F.lit(1).cast("long").alias("packets"), F.lit(7).alias("k"))
    counts = [r["count"] for r in encode_v5(rows, packet_by=["k"]).collect()]
    assert sum(counts) == 1000 and max(counts) == 30 and len(counts) == 34
