"""Ledger of ingested files, commit logs, versions of keyed tables, results and specs."""

import os

import pytest
from pyspark.sql import functions as F

from flowbeam.plans import ingest
from flowbeam.schema import FLOW_SCHEMA, SPEC_SCHEMA
from flowbeam.sinks import keyed, log, results, specs
from flowbeam.sinks.flows import compact_flows, drop_replaced_batches
from flowbeam.sinks.ledger import Ledger
from flowbeam.sources.documents import read_documents
from flowbeam.sources.flows import read_flows
from flowbeam.sources.keyed import read_keyed, source_lookup
from flowbeam.streaming import ingest as streaming
from tests.wire import pcap_file, udp_frame, v5_packet, v5_record


def drop(folder, name, n, src="10.1.0.1", stamp=None):
    os.makedirs(folder, exist_ok=True)
    packet = v5_packet([v5_record(src=src, dst=f"10.2.0.{i}", sport=i) for i in range(n)])
    path = os.path.join(folder, name)
    with open(path, "wb") as fh:
        fh.write(pcap_file([udp_frame(packet), udp_frame(packet, proto=6)]))
    if stamp:
        os.utime(path, (stamp, stamp))


@pytest.fixture
def paths(tmp_dir):
    return [os.path.join(tmp_dir, d) for d in ("landing", "flows", "rejects")]


def test_a_folder_adds_up(spark, paths):
    landing, flows, rejects = paths
    drop(landing, "a.pcap", 8)
    assert ingest.ingest_captures(spark, *paths) == ingest.IngestCounts(8, 1)
    drop(landing, "a.pcap", 9)  # the next day's file under the same name
    assert ingest.ingest_captures(spark, *paths) == ingest.IngestCounts(9, 1)
    drop(landing, "b.pcap", 3)
    assert ingest.ingest_captures(spark, os.path.relpath(landing), flows, rejects) == ingest.IngestCounts(3, 1)
    for _ in range(2):
        assert ingest.ingest_captures(spark, *paths) == ingest.IngestCounts(0, 0)
    assert read_flows(spark, flows).count() == 20 and spark.read.parquet(rejects).count() == 3


def test_same_length_but_another_time_is_new(spark, paths):
    drop(paths[0], "a.pcap", 4, stamp=1_000_000)
    ingest.ingest_captures(spark, *paths)
    drop(paths[0], "a.pcap", 4, src="10.1.0.2", stamp=2_000_000)
    assert ingest.ingest_captures(spark, *paths).flows == 4


def test_bounded_batches(spark, paths):
    for k in range(6):
        drop(paths[0], f"{k}.pcap", k + 1)
    assert ingest.ingest_captures(spark, *paths, batch_bytes=500) == ingest.IngestCounts(21, 6)
    assert len(Ledger(spark, paths[1]).live()) > 1 and read_flows(spark, paths[1]).count() == 21


@pytest.mark.parametrize("mode", ["parquet", "documents", "keyed"])
def test_batch_that_broke_off_between_its_sinks(spark, paths, mode, monkeypatch):
    landing, table, rejects = paths
    read = {"parquet": read_flows, "documents": read_documents, "keyed": read_keyed}[mode]
    drop(landing, "a.pcap", 5)
    ingest.ingest_captures(spark, *paths, mode=mode)
    drop(landing, "b.pcap", 4, src="10.1.0.2")
    with monkeypatch.context() as broken:
        broken.setattr(ingest, "Observation", lambda name: 1 / 0)  # after the flows, before the rejects
        with pytest.raises(ZeroDivisionError):
            ingest.ingest_captures(spark, *paths, mode=mode)
    if mode != "keyed":  # a keyed batch counts once it is whole
        assert read(spark, table).count() == 5
    ingest.ingest_captures(spark, *paths, mode=mode)
    assert read(spark, table).count() == 9 and spark.read.parquet(rejects).count() == 2
    assert Ledger(spark, table).unfinished("batch-") == []


@pytest.mark.parametrize("mode", ["parquet", "documents", "keyed"])
def test_stream_killed_between_its_sinks(spark, paths, mode, monkeypatch):
    landing, table, rejects = paths
    read = {"parquet": read_flows, "documents": read_documents, "keyed": read_keyed}[mode]

    def run():
        query = streaming.start_capture_ingest(spark, *paths, mode=mode)
        query.awaitTermination()

    drop(landing, "a.pcap", 5)
    with monkeypatch.context() as broken:
        broken.setattr(ingest, "Observation", lambda name: 1 / 0)
        with pytest.raises(Exception):
            run()
    assert not Ledger(spark, table).closed()
    run()
    drop(landing, "b.pcap", 4, src="10.1.0.2")
    run()
    assert read(spark, table).count() == 9 and spark.read.parquet(rejects).count() == 2
    assert ingest.ingest_captures(spark, *paths, mode=mode) == ingest.IngestCounts(0, 0)


def test_stream_with_a_lost_checkpoint(spark, paths, tmp_dir):
    def run(checkpoint):
        streaming.start_capture_ingest(spark, *paths, checkpoint=checkpoint).awaitTermination()

    def files(names):
        listed = ingest.scan_files(spark, paths[0])
        return listed.filter(F.regexp_extract("path", "([^/]+)$", 1).isin(names))

    drop(paths[0], "a.pcap", 5)
    streaming.ingest_stream_batch(files(["a.pcap"]), 0, *paths[1:], "s")
    drop(paths[0], "b.pcap", 4)
    for _ in range(2):  # numbers begin again, with all files
        streaming.ingest_stream_batch(files(["a.pcap", "b.pcap"]), 0, *paths[1:], "s")
    assert read_flows(spark, paths[1]).count() == 9


def test_compaction_of_batches(spark, paths):
    for k in range(3):
        drop(paths[0], f"{k}.pcap", 4, src=f"10.1.0.{k}")
        ingest.ingest_captures(spark, *paths)
    ledger = Ledger(spark, paths[1])

    def files():
        return sum(n.endswith(".parquet") for d, _, names in os.walk(paths[1]) if "_ledger" not in d for n in names)

    before = files()
    assert compact_flows(spark, paths[1]) == 3 and len(ledger.live()) == 1
    assert read_flows(spark, paths[1]).count() == 12  # old files are there and not read
    assert drop_replaced_batches(spark, paths[1]) == 3 and files() < before
    assert read_flows(spark, paths[1]).count() == 12 and compact_flows(spark, paths[1]) == 0
    assert ingest.ingest_captures(spark, *paths).flows == 0  # their files stay known


# -- commit log ------------------------------------------------------------------------------


def test_two_writers_never_take_one_number(spark, tmp_dir):
    one, two = log.CommitLog(spark, tmp_dir), log.CommitLog(spark, tmp_dir)
    assert one.commit({"w": 1}, 1) == 1 and two.commit({"w": 2}, 1) is None and two.commit({"w": 2}) == 2
    with open(os.path.join(tmp_dir, "_log", "0000000003.json"), "w"):
        pass  # a writer that died
    assert one.commit({"w": 3}) == 4 and list(two.entries()) == [1, 2, 4]


def rows(spark, *items):
    return spark.createDataFrame([(s, d, 1, 2, t, 5, 6, b, 1) for s, d, t, b in items], FLOW_SCHEMA)


def seen(spark, path):
    return {(r.src_addr, r.dst_addr): r.bytes for r in read_keyed(spark, path).collect()}


def test_keyed_update_costs_its_batch(spark, tmp_dir):
    path = os.path.join(tmp_dir, "keyed")
    big = spark.range(20_000).select(
        F.expr("format_string('10.0.%d.%d', id div 200, id % 200)").alias("src_addr"), F.lit("10.9.9.9").alias("dst_addr"),
        F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"), F.col("id").alias("time_ms"), F.lit(5).cast("long").alias("duration_ms"),
        F.lit(6).alias("protocol"), F.col("id").alias("bytes"), F.lit(1).cast("long").alias("packets"))
    keyed.update_keyed(big, path)
    whole = log.size_of(spark, path)
    keyed.update_keyed(rows(spark, *[(f"10.7.0.{k}", "10.0.0.2", 1, k) for k in range(20)]), path)  # in many buckets
    assert log.size_of(spark, path) - whole < whole / 5
    assert read_keyed(spark, path).count() == big.select("src_addr").distinct().count() + 20


def test_keyed_versions_tokens_and_compaction(spark, tmp_dir):
    path = os.path.join(tmp_dir, "keyed")
    first = rows(spark, ("10.0.0.1", "10.0.0.2", 9, 1), ("10.0.0.3", "10.0.0.1", 9, 2))
    second = rows(spark, ("10.0.0.1", "10.0.0.2", 3, 7))
    assert keyed.update_keyed(first, path, token="a") and keyed.update_keyed(second, path, token="b")
    assert not keyed.update_keyed(first, path, token="a")  # a batch offered again changes nothing
    wanted = {("10.0.0.1", "10.0.0.2"): 7, ("10.0.0.3", "10.0.0.1"): 2}
    assert seen(spark, path) == wanted
    assert keyed.compact_keyed(spark, path, bucket_bytes=16) and seen(spark, path) == wanted
    plan = read_keyed(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan  # one version needs no merging
    assert keyed.drop_old_versions(spark, path) >= 2 and seen(spark, path) == wanted
    assert not keyed.update_keyed(second, path, token="b")
    assert keyed.update_keyed(rows(spark, ("10.0.0.3", "10.0.0.1", 1, 5)), path, token="c")
    assert seen(spark, path)[("10.0.0.3", "10.0.0.1")] == 5
    assert [r.bytes for r in source_lookup(spark, path, "10.0.0.3").collect()] == [5]
    assert [r.bytes for r in source_lookup(spark, path, "10.0.0.3", use_store_filter=False).collect()] == [5]
    assert max(keyed._Versions(spark, path).live.values())[1] > keyed.KEY_BUCKETS


def test_keyed_version_without_entry_is_not_read(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "keyed")
    keyed.update_keyed(rows(spark, ("10.0.0.1", "10.0.0.2", 9, 1)), path)
    later = rows(spark, ("10.0.0.1", "10.0.0.2", 9, 5))
    with monkeypatch.context() as broken:
        broken.setattr(log.CommitLog, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            keyed.update_keyed(later, path, token="t")
    assert seen(spark, path) == {("10.0.0.1", "10.0.0.2"): 1}
    assert keyed.update_keyed(later, path, token="t") and seen(spark, path) == {("10.0.0.1", "10.0.0.2"): 5}


def test_compaction_gives_way_to_another_writer(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "keyed")
    keyed.update_keyed(rows(spark, ("10.0.0.1", "10.0.0.2", 9, 1)), path)
    write = keyed._write

    def slow(*args):
        write(*args)
        monkeypatch.setattr(keyed, "_write", write)
        keyed.update_keyed(rows(spark, ("10.0.0.1", "10.0.0.2", 9, 6)), path)

    monkeypatch.setattr(keyed, "_write", slow)
    assert not keyed.compact_keyed(spark, path) and seen(spark, path) == {("10.0.0.1", "10.0.0.2"): 6}


# -- results and specs -----------------------------------------------------------------------


def test_failed_rewrite_leaves_the_old_result(spark, tmp_dir):
    from flowbeam.operators.project import to_display

    root = os.path.join(tmp_dir, "results")
    flows = to_display(rows(spark, ("10.0.0.1", "10.0.0.2", 9, 1), ("10.0.0.1", "10.0.0.3", 9, 2)))
    assert results.write_results(flows, root, "j") == 2
    broken = flows.withColumn("bytes", F.when(F.col("bytes") == 2, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="no"):
        results.write_results(broken, root, "j")
    assert results.results_page(spark, root, "j", 0, 9).count() == 2 and results.result_count(spark, root, "j").first().rows == 2
    for n in (1, 0, 1):
        assert results.write_results(flows.limit(n), root, "j") == n
        assert results.result_count(spark, root, "j").first().rows == results.job_rows(spark, root, "j").count() == n
    results.write_results(flows, root, "k")
    assert sorted(r.job_id for r in results.read_results(spark, root).collect()) == ["j", "k", "k"]


def test_spec_ids_are_taken_once(spark, tmp_dir):
    path = os.path.join(tmp_dir, "specs")

    def batch(*ids):
        return spark.createDataFrame([(i, "Test", "n", {}) for i in ids], SPEC_SCHEMA)

    specs.append_specs(batch("a", "b"), path)
    for refused in (batch("c", "a"), batch("d", "d"), batch("e", None)):
        with pytest.raises(ValueError):
            specs.append_specs(refused, path)
    assert sorted(r.job_id for r in specs.read_specs(spark, path).collect()) == ["a", "b"]


def test_second_of_two_spec_writers_loses(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "specs")
    commit = log.CommitLog.commit

    def slow(self, entry, number=None):
        monkeypatch.setattr(log.CommitLog, "commit", commit)
        specs.insert_spec(spark, path, "x", "Test", "other", {})  # another writer comes in between
        return commit(self, entry, number)

    monkeypatch.setattr(log.CommitLog, "commit", slow)
    with pytest.raises(ValueError, match="exists"):
        specs.insert_spec(spark, path, "x", "Test", "mine", {})
    assert specs.find_spec(spark, path, "x")["name"] == "other"
