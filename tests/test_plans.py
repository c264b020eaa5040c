"""Physical-plan checks: the operators plan the way their docstrings claim."""

from flowbeam.operators.decode import decode
from flowbeam.operators.encode import encode_v5
from flowbeam.operators.toptalk import latest_per_pair, top_pairs
from flowbeam.sources.testviews import flows_view
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_pairs_partial_aggregate_and_top_k(spark):
    p = plan(top_pairs(flows_view(spark, SF_SMALL), 10))
    assert "TakeOrderedAndProject" in p and "partial_sum" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double>" in p


def test_latest_per_pair_combines_map_side(spark):
    p = plan(latest_per_pair(flows_view(spark, SF_SMALL)))
    assert "partial_max" in p and "Window" not in p


def test_decode_stays_in_the_jvm(spark):
    flows, rejects = decode(encode_v5(flows_view(spark, SF_SMALL, keep_keys=False)).select("payload"))
    for df in (flows, rejects):
        p = plan(df)
        assert "Python" not in p and "ArrowEval" not in p and "BatchEval" not in p


def test_multi_spec_is_an_equi_join(spark):
    import __spark_entry__ as entry

    p = plan(entry.queries()["multi_spec_query"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p
    assert "NestedLoopJoin" not in p and "Cartesian" not in p


def test_multi_spec_falls_back_to_shuffle_join(spark):
    from pyspark.sql import functions as F

    from flowbeam.operators.multispec import multi_spec_query

    flows = flows_view(spark, SF_SMALL, keep_keys=False)
    specs = flows.select(
        F.concat(F.lit("j"), F.col("src_addr")).alias("job_id"),
        (F.col("time_ms") - 1000).alias("start_ms"),
        (F.col("time_ms") + 1000).alias("end_ms"),
        "src_addr",
        F.lit(None).cast("string").alias("dst_addr"),
        F.lit(None).cast("int").alias("src_port"),
        F.lit(None).cast("int").alias("dst_port"),
        F.lit(None).cast("int").alias("protocol"),
    )
    big = multi_spec_query(flows, specs, broadcast_bytes=0)
    small = multi_spec_query(flows, specs)
    assert "SortMergeJoin" in plan(big) or "ShuffledHashJoin" in plan(big)
    assert big.exceptAll(small).count() == 0 and small.exceptAll(big).count() == 0


def test_source_lookup_prunes_by_statistics(spark, tmp_path):
    from flowbeam.sinks.keyed import upsert_keyed
    from flowbeam.sources.keyed import source_lookup

    path = upsert_keyed(flows_view(spark, SF_SMALL), str(tmp_path / "keyed"))
    p = plan(source_lookup(spark, path, "10.0.1.5"))
    assert "EqualTo(src_addr,10.0.1.5)" in p


def test_result_page_is_a_pushed_range(spark, tmp_path):
    from flowbeam.operators.project import to_display
    from flowbeam.sinks import results

    root = str(tmp_path / "results")
    results.write_results(to_display(flows_view(spark, SF_SMALL, keep_keys=False)), root, "j")
    page = results.results_page(spark, root, "j", 100, 10)
    p = plan(page)
    assert "GreaterThanOrEqual(row_no,100)" in p and "LessThanOrEqual(row_no,109)" in p
    assert all("/job_id=j/" in f for f in page.inputFiles())
    assert "Location: InMemoryFileIndex(1 paths)" in p  # the job's own folder, not the root


def test_decode_is_one_codegen_stage(spark, tmp_path):
    # a single interpreted expression (e.g. a higher-order function) would drop its whole
    # operator out of whole-stage codegen; decode stored packets (a plan without a shuffle,
    # whose codegen stages are visible before execution)
    path = str(tmp_path / "packets")
    encode_v5(flows_view(spark, SF_SMALL, keep_keys=False)).select("payload").write.parquet(path)
    flows, _ = decode(spark.read.parquet(path))
    p = flows._jdf.queryExecution().executedPlan().toString()
    lines = [ln for ln in p.splitlines() if any(op in ln for op in ("Project [", "Filter ", "Generate "))]
    decode_ops = [ln for ln in lines if "sequence(" in ln or "conv(" in ln]
    assert decode_ops and all("*(" in ln for ln in decode_ops), "\n".join(decode_ops)


def test_multi_spec_prunes_day_partitions(spark, tmp_path):
    from pyspark.sql import functions as F

    from flowbeam.functions.time import parse_time_literal as ms
    from flowbeam.operators.multispec import multi_spec_query
    from flowbeam.sinks.flows import write_partitioned
    from flowbeam.sources.flows import read_flows

    path = str(tmp_path / "flows")
    write_partitioned(flows_view(spark, SF_SMALL, keep_keys=False), path)
    specs = spark.createDataFrame(
        [("a", ms("1996-03-01-00:00:00"), ms("1996-03-03-23:59:59"), "10.0.1.5", None, None, None, None)],
        "job_id string, start_ms long, end_ms long, src_addr string, dst_addr string, src_port int, "
        "dst_port int, protocol int",
    )
    stored = read_flows(spark, path)
    out = multi_spec_query(stored, specs)
    p = plan(out)
    assert "PartitionFilters: [" in p and "unix_date(make_date(year" in p
    expected = flows_view(spark, SF_SMALL, keep_keys=False).filter(
        F.col("time_ms").between(ms("1996-03-01-00:00:00"), ms("1996-03-03-23:59:59"))
        & (F.col("src_addr") == "10.0.1.5")
    )
    assert sorted(map(tuple, out.drop("job_id").collect())) == sorted(map(tuple, expected.collect()))


def test_multi_spec_open_range_keeps_the_plan(spark, tmp_path):
    from flowbeam.operators.multispec import multi_spec_query
    from flowbeam.sinks.flows import write_partitioned
    from flowbeam.sources.flows import read_flows

    path = str(tmp_path / "flows")
    flows = flows_view(spark, SF_SMALL, keep_keys=False)
    write_partitioned(flows, path)
    specs = spark.createDataFrame(
        [("a", 0, 253402300799000, "10.0.1.5", None, None, None, None)],
        "job_id string, start_ms long, end_ms long, src_addr string, dst_addr string, src_port int, "
        "dst_port int, protocol int",
    )
    out = multi_spec_query(read_flows(spark, path), specs)
    p = plan(out)
    assert "unix_date(make_date(year" in p and "SortMergeJoin" not in p and "BroadcastHashJoin" in p
    assert out.count() == flows.filter("src_addr = '10.0.1.5'").count()


def test_day_cover_is_exact_and_short(spark):
    from pyspark.sql import functions as F

    from flowbeam.operators.multispec import day_cover

    ranges = [(0, 0), (5, 70), (-40, 3), (31, 32), (0, 2932896), (9000, 12000), (-719162, 2932896)]
    df = spark.createDataFrame(ranges, "a long, b long")
    for r in df.select("a", "b", day_cover(F.col("a"), F.col("b")).alias("c")).collect():
        days = [d for x in r.c for d in range(x.bucket << 5 * x.level, (x.bucket + 1) << 5 * x.level)]
        assert sorted(days) == list(range(r.a, r.b + 1)) and len(r.c) < 300
