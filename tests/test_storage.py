import os

from pyspark.sql import functions as F

from flowbeam.operators import filters, project
from flowbeam.schema import FLOW_SCHEMA, SchemaError
from flowbeam.sinks import results
from flowbeam.sinks.flows import write_flows, write_partitioned
from flowbeam.sinks.keyed import source_bucket_literal, update_keyed, upsert_keyed
from flowbeam.sinks.specs import find_spec, insert_spec
from flowbeam.sources.documents import read_documents, split_documents, term_query
from flowbeam.sources.flows import load_flows, read_flows
from flowbeam.sources.keyed import read_keyed, source_lookup
from flowbeam.sources.testviews import flows_view
from tests.conftest import SF_SMALL

import pytest

ROWS = [
    ("10.0.0.1", "10.0.0.2", 1, 2, 1491040800000, 5, 6, 10, 1),   # 2017-04-01
    ("10.0.0.1", "10.0.0.2", 1, 2, 1491127200000, 5, 6, 20, 1),   # 2017-04-02
    ("10.0.0.3", "10.0.0.1", 1, 2, 1493632800000, 5, 17, 30, 1),  # 2017-05-01
]


def test_partitioned_write_layout_and_pruned_read(spark, tmp_dir):
    path = os.path.join(tmp_dir, "flows")
    write_partitioned(spark.createDataFrame(ROWS, FLOW_SCHEMA), path)
    assert sorted(os.listdir(os.path.join(path, "year=2017"))) == ["month=4", "month=5"]
    df = filters.in_time_range(read_flows(spark, path), 1491040800000, 1491127200000)
    assert sorted(r.bytes for r in df.collect()) == [10, 20]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "make_date" in plan
    assert load_flows(spark, path).count() == 3


def test_documents_round_trip_and_term_query(spark, tmp_dir):
    path = os.path.join(tmp_dir, "docs")
    write_flows(spark.createDataFrame(ROWS, FLOW_SCHEMA), path, "elastic")
    docs = read_documents(spark, path)
    assert docs.exceptAll(project.to_display(spark.createDataFrame(ROWS, FLOW_SCHEMA))).count() == 0
    assert term_query(docs, "srcAddress", "10.0.0.1").count() == 2
    with pytest.raises(ValueError):
        term_query(docs, "nope", 1)
    with pytest.raises(ValueError):
        write_flows(docs, path, "mongo")


def test_keyed_upsert_last_write_wins(spark, tmp_dir):
    first = spark.createDataFrame(ROWS, FLOW_SCHEMA)
    v1 = upsert_keyed(first, os.path.join(tmp_dir, "v1"))
    older = spark.createDataFrame([("10.0.0.1", "10.0.0.2", 7, 8, 1, 5, 6, 99, 1)], FLOW_SCHEMA)
    v2 = upsert_keyed(older, os.path.join(tmp_dir, "v2"), previous_path=v1)
    got = {(r.src_addr, r.dst_addr): r.bytes for r in read_keyed(spark, v2).collect()}
    # the later write replaces the pair even though its flow is older
    assert got == {("10.0.0.1", "10.0.0.2"): 99, ("10.0.0.3", "10.0.0.1"): 30}
    assert [r.bytes for r in source_lookup(spark, v1, "10.0.0.1").collect()] == [20]
    assert [r.bytes for r in source_lookup(spark, v1, "10.0.0.1", use_store_filter=False).collect()] == [20]
    plan = source_lookup(spark, v1, "10.0.0.1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(src_addr,10.0.0.1)" in plan
    obs = write_flows(first, os.path.join(tmp_dir, "v3"), "hbase")
    assert obs.get["rows"] == 3


def test_keyed_update_touches_only_its_buckets(spark, tmp_dir):
    path = os.path.join(tmp_dir, "keyed")
    update_keyed(spark.createDataFrame(ROWS, FLOW_SCHEMA), path)

    def files():
        return {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("bucket=")}

    before = files()
    update_keyed(spark.createDataFrame([("10.0.0.1", "10.0.0.9", 7, 8, 1, 5, 6, 99, 1)], FLOW_SCHEMA), path)
    after = files()
    hit = f"bucket={source_bucket_literal('10.0.0.1')}"
    assert {d for d in after if before.get(d) != after[d]} == {hit}
    got = {(r.src_addr, r.dst_addr): r.bytes for r in read_keyed(spark, path).collect()}
    assert got == {("10.0.0.1", "10.0.0.2"): 20, ("10.0.0.1", "10.0.0.9"): 99, ("10.0.0.3", "10.0.0.1"): 30}
    # the same batch again changes nothing
    assert write_flows(spark.createDataFrame(ROWS, FLOW_SCHEMA), path, "keyed").get["rows"] == 3
    assert read_keyed(spark, path).count() == 3


def test_keyed_rows_need_a_key(spark, tmp_dir):
    bad = spark.createDataFrame([("host", "10.0.0.2", 1, 2, 1, 5, 6, 10, 1)], FLOW_SCHEMA)
    with pytest.raises(Exception, match="has no key"):
        update_keyed(bad, os.path.join(tmp_dir, "keyed"))
    spark.range(3).write.parquet(os.path.join(tmp_dir, "other"))
    with pytest.raises(SchemaError):
        read_keyed(spark, os.path.join(tmp_dir, "other"))


def test_document_rejects(spark, tmp_dir):
    good = project.to_document(project.to_display(spark.createDataFrame(ROWS, FLOW_SCHEMA))).first().value
    lines = [good, "not json", "", "{}", good.replace('"bytes":10', '"bytes":"x"'), "[1]"]
    path = os.path.join(tmp_dir, "docs")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    docs, rejects = split_documents(spark, path)
    assert [r.bytes for r in docs.collect()] == [10]
    assert sorted(r.reject_reason for r in rejects.collect()) == ["missing_field", "unreadable", "unreadable", "unreadable"]


def test_results_overwrite_drop_and_page(spark, tmp_dir):
    root = os.path.join(tmp_dir, "results")
    flows = flows_view(spark, SF_SMALL, keep_keys=False)
    results.write_results(project.to_display(flows.limit(0)), root, "empty")
    results.write_results(project.to_display(flows), root, "all")
    results.write_results(project.to_display(flows.filter(F.col("protocol") == 6)), root, "tcp")
    n_tcp = flows.filter(F.col("protocol") == 6).count()
    assert results.result_count(spark, root, "tcp").first().rows == n_tcp
    results.write_results(project.to_display(flows.filter(F.col("protocol") == 99)), root, "tcp")
    assert results.result_count(spark, root, "tcp").first().rows == 0  # empty rerun replaces rows
    assert results.drop_results(spark, root, "all")
    assert not results.drop_results(spark, root, "all")
    with pytest.raises(KeyError):
        results.result_count(spark, root, "all")
    results.write_results(project.to_display(flows), root, "all")
    page1 = results.results_page(spark, root, "all", 0, 7).collect()
    page2 = results.results_page(spark, root, "all", 7, 7).collect()
    ordered = project.to_display(flows).orderBy(*results.PAGE_ORDER).limit(14).collect()
    assert page1 + page2 == ordered
    assert results.page_as_json(results.results_page(spark, root, "all", 0, 1)).first().value.startswith("{")
    with pytest.raises(ValueError):
        results.write_results(project.to_display(flows), root, "../x")


def test_spec_table_insert_and_find(spark, tmp_dir):
    path = os.path.join(tmp_dir, "specs")
    params = {"start": "2017-04-01-00:00:00", "end": "2017-05-01-00:00:00", "src_addr": "198.51.100.1"}
    insert_spec(spark, path, "j1", "FlowQuery", "april", params)
    insert_spec(spark, path, "j2", "Test", "t", {})
    assert find_spec(spark, path, "j1")["params"] == params
    with pytest.raises(KeyError):
        find_spec(spark, path, "missing")
    with pytest.raises(ValueError):
        insert_spec(spark, path, "j3", "FlowQuery", "bad", {"start": "x"})
    with pytest.raises(ValueError, match="exists"):
        insert_spec(spark, path, "j1", "FlowQuery", "again", params)


def test_jobs_end_to_end(spark, tmp_dir, capsys):
    from flowbeam.plans.jobs import run_flow_query, run_source_lookup, run_top_pairs

    flows_path, root = os.path.join(tmp_dir, "flows"), os.path.join(tmp_dir, "results")
    write_partitioned(spark.createDataFrame(ROWS, FLOW_SCHEMA), flows_path)
    job = {"job_id": "j1", "name": "april", "type": "FlowQuery",
           "params": {"start": "2017-04-01-00:00:00", "end": "2017-04-30-00:00:00", "src_addr": "10.0.0.1"}}
    assert run_flow_query(spark, flows_path, job, root) == 2
    rows = run_top_pairs(spark, flows_path, 1)
    assert [tuple(r) for r in rows] == [("10.0.0.1", "10.0.0.2", 30)]  # tie on 30: address order
    keyed = upsert_keyed(spark.createDataFrame(ROWS, FLOW_SCHEMA), os.path.join(tmp_dir, "keyed"))
    assert run_source_lookup(spark, keyed, "10.0.0.1") == 1
    assert "(10.0.0.1,10.0.0.2,30)" in capsys.readouterr().out
