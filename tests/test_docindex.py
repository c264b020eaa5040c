"""The document index: only row groups that may hold a term are read."""

import os

from pyspark.sql import functions as F

from flowbeam.operators.project import to_display
from flowbeam.sinks.docindex import index_documents, indexed_term_query, read_index
from flowbeam.sinks.flows import write_documents
from flowbeam.sources.documents import read_documents, term_query


def flows(spark, n=20_000):
    i = F.col("id")
    return spark.range(n).select(
        F.format_string("10.0.%d.%d", F.expr("id % 97"), F.expr("id div 97 % 199")).alias("src_addr"),
        F.format_string("10.9.%d.%d", F.expr("id * 7919 % 211"), F.expr("id * 31 % 251")).alias("dst_addr"),
        F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"), (F.lit(1491040800000) + i % 2 * 86_400_000).alias("time_ms"),
        i.alias("duration_ms"), F.lit(6).alias("protocol"), i.alias("bytes"), F.lit(1).cast("long").alias("packets"))


def rows_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_lookups_skip_row_groups_and_days(spark, tmp_dir):
    path = os.path.join(tmp_dir, "docs")
    write_documents(flows(spark), path)
    assert index_documents(spark, path, row_group_bytes=100_000) > 0 and index_documents(spark, path) == 0
    docs = read_documents(spark, path)
    some = docs.limit(1).first()
    for field in ("srcAddress", "dstAddress"):
        found = indexed_term_query(spark, path, field, some[field])
        wanted = term_query(docs, field, some[field])
        assert sorted(found.collect()) == sorted(wanted.collect()) and wanted.count()
        assert rows_read(found) < 20_000 / 4, field  # the rest of the row groups were not read
    day = some.time[:10]
    there = indexed_term_query(spark, path, "srcAddress", some.srcAddress, (day, day))
    plan = there._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert {r.time[:10] for r in there.collect()} == {day}
    assert indexed_term_query(spark, path, "dstAddress", "1.2.3.4").count() == 0


def test_index_follows_its_folder(spark, tmp_dir):
    path = os.path.join(tmp_dir, "docs")
    write_documents(flows(spark, 500), path)
    index_documents(spark, path)
    write_documents(flows(spark, 300), path)
    with open(os.path.join(path, "part-extra.json"), "w") as fh:
        fh.write('not json\n{"srcAddress":"10.0.0.1"}\n\n')
    assert index_documents(spark, path) > 1
    index = read_index(spark, path)
    assert index.count() == 800 == read_documents(spark, path).count()
    text = {r.value for r in spark.read.text(path).collect()}
    assert {r.value for r in index.collect()} <= text  # what was written, byte by byte


def test_whole_documents_only(spark, tmp_dir):
    good = to_display(flows(spark, 1)).toJSON().first()
    path = os.path.join(tmp_dir, "docs")
    lines = [good, "no", "{}", good.replace('"bytes":0', '"bytes":"x"'), "[1]", ""]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    assert read_documents(spark, path).count() == 1 and index_documents(spark, path) > 0 and read_index(spark, path).count() == 1
