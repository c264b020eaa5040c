import os

from flowbeam.sources.flows import read_flows
from flowbeam.streaming.ingest import start_capture_ingest
from tests.wire import pcap_file, udp_frame, v5_packet, v5_record


def test_stream_ingest_resumes_and_skips_done_files(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    ckpt, flows, rejects = (os.path.join(tmp_dir, d) for d in ("ckpt", "flows", "rejects"))

    def drop(name, n):
        pkt = v5_packet([v5_record(sport=i) for i in range(n)])
        with open(os.path.join(landing, name), "wb") as fh:
            fh.write(pcap_file([udp_frame(pkt), udp_frame(pkt, proto=6)]))

    drop("a.pcap", 3)
    drop("b.pcap", 4)
    q = start_capture_ingest(spark, landing, flows, rejects, checkpoint=ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    assert read_flows(spark, flows).count() == 7
    drop("c.pcap", 5)  # arrives later; a restarted query picks up only the new file
    q = start_capture_ingest(spark, landing, flows, rejects, checkpoint=ckpt)
    q.awaitTermination()
    assert read_flows(spark, flows).count() == 12
    assert spark.read.parquet(rejects).count() == 3


def test_replayed_batch_is_not_duplicated(spark, tmp_dir):
    from flowbeam.sources.capture import frames_from_files, scan_files
    from flowbeam.streaming.ingest import write_stream_batch

    caps = os.path.join(tmp_dir, "caps")
    os.makedirs(caps)
    pkt = v5_packet([v5_record(sport=i) for i in range(4)])
    with open(os.path.join(caps, "a.pcap"), "wb") as fh:
        fh.write(pcap_file([udp_frame(pkt), udp_frame(pkt, proto=6)]))
    flows, rejects = os.path.join(tmp_dir, "flows"), os.path.join(tmp_dir, "rejects")
    frames = frames_from_files(scan_files(spark, caps))
    for _ in range(2):  # the same batch delivered twice (a retry after a failure)
        write_stream_batch(frames, 7, flows, rejects)
    assert read_flows(spark, flows).count() == 4
    assert spark.read.parquet(rejects).count() == 1
    assert {r.ingest_batch for r in read_flows(spark, flows).collect()} == {"stream-7"}


def test_batch_overwrite_is_static_even_in_dynamic_sessions(spark, tmp_dir):
    from flowbeam.schema import FLOW_SCHEMA
    from flowbeam.sinks.flows import write_partitioned

    path = os.path.join(tmp_dir, "ingest_batch=1")
    april = ("10.0.0.1", "10.0.0.2", 1, 2, 1491040800000, 5, 6, 10, 1)
    may = ("10.0.0.1", "10.0.0.2", 1, 2, 1493632800000, 5, 6, 10, 1)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        write_partitioned(spark.createDataFrame([april, may], FLOW_SCHEMA), path, mode="overwrite")
        write_partitioned(spark.createDataFrame([may], FLOW_SCHEMA), path, mode="overwrite")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert read_flows(spark, tmp_dir).count() == 1


def _captures(folder, name, dst):
    from tests.wire import pcap_file, udp_frame, v5_packet, v5_record

    os.makedirs(folder, exist_ok=True)
    pkt = v5_packet([v5_record(src="10.9.8.7", dst=dst, first=9_000, last=9_000)], uptime=10_000, secs=1185488139)
    with open(os.path.join(folder, name), "wb") as fh:
        fh.write(pcap_file([udp_frame(pkt)]))


def test_streams_and_batches_share_a_table_and_restart(spark, tmp_dir):
    from flowbeam.plans.ingest import ingest_captures
    from flowbeam.streaming.ingest import start_capture_ingest

    a, b, c = (os.path.join(tmp_dir, d) for d in "abc")
    flows, rejects = os.path.join(tmp_dir, "flows"), os.path.join(tmp_dir, "rejects")

    def stream(folder):
        start_capture_ingest(spark, folder, flows, rejects).awaitTermination()

    def seen():
        return sorted(r.dst_addr for r in to_display_addresses(read_flows(spark, flows)).collect())

    def to_display_addresses(df):
        from flowbeam.operators.project import to_display

        return to_display(df).withColumnRenamed("dstAddress", "dst_addr")

    _captures(a, "1.pcap", "10.0.0.1")
    stream(a)
    _captures(a, "2.pcap", "10.0.0.2")
    stream(a)  # restarted without an explicit checkpoint: only the new file
    _captures(b, "1.pcap", "10.0.0.3")
    stream(b)  # another landing folder into the same table
    _captures(c, "1.pcap", "10.0.0.4")
    ingest_captures(spark, c, flows, rejects)
    ingest_captures(spark, c, flows, rejects)  # a rerun replaces its own output
    assert seen() == ["10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.4"]


def test_times_do_not_depend_on_the_session_zone(spark):
    from pyspark.sql import functions as F

    from flowbeam.functions.time import format_time, parse_time, parse_time_literal

    texts = ["20070726215000", "2007-07-26-21:50:00", "2007-02-30-00:00:00", "2007-07-26-24:00:00", "20070726215000\n", "1969-12-31-23:59:59"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = df.select("t", parse_time(F.col("t")).alias("ms")).withColumn("back", format_time(F.col("ms"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)

    def literal(t):
        try:
            return parse_time_literal(t)
        except ValueError:
            return None

    assert [r.ms for r in rows] == [literal(t) for t in texts]
    assert [r.back for r in rows] == ["2007-07-26-21:50:00"] * 2 + [None] * 3 + ["1969-12-31-23:59:59"]
