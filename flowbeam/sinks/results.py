"""Stored query results: one directory per job under a results root, paged reads.

``write_results`` writes a new version of the job's rows beside the old one; an entry of the
job's commit log, written last, makes it the result. Until then, and after a write that fails,
the old result stays readable; a rerun with no rows replaces it too. Other jobs are untouched.
The entry holds the row count.

Rows are stored in a total order with a dense ``row_no`` (0-based), numbered without
collecting anything: the sorted rows are checkpointed (into the shared checkpoint folder),
each partition's row count comes from a small aggregate, and the running start of each
partition is joined back as a broadcast of one row per partition. A page is then a
``row_no`` range filter that reaches the Parquet scan (row-group statistics prune it), so a
deep page costs the same as the first one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbeam.schema import DISPLAY_SCHEMA
from flowbeam.session import checkpoint_root
from flowbeam.sinks import log

_JOB_ID_RE = re.compile(r"[A-Za-z0-9_.-]+")
RESULT_SCHEMA = T.StructType(
    DISPLAY_SCHEMA.fields
    + [T.StructField("row_no", T.LongType()), T.StructField("job_id", T.StringType())]
)
# Total order of display rows for paging (rows equal in all of these are identical).
PAGE_ORDER = ["time", "srcAddress", "dstAddress", "srcPort", "dstPort", "protocol", "duration", "bytes", "packets"]


def _check_job_id(job_id: str) -> str:
    if not isinstance(job_id, str) or not _JOB_ID_RE.fullmatch(job_id):
        raise ValueError(f"job id must match {_JOB_ID_RE.pattern}: {job_id!r}")
    return job_id


def partition_path(root: str, job_id: str) -> str:
    return f"{root.rstrip('/')}/job_id={_check_job_id(job_id)}"


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` sorted by ``order`` with a dense 0-based ``row_no`` column."""
    checkpoint_root(rows.sparkSession)
    ordered = rows.orderBy(*order).checkpoint(eager=True)
    local = ordered.select(
        "*",
        F.spark_partition_id().alias("_part"),
        (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("_i"),
    )
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start")
    )
    # one row per partition: a size bound known from the plan, safe to broadcast
    numbered = local.join(F.broadcast(starts), "_part")
    return numbered.select(*rows.columns, (F.col("_start") + F.col("_i")).alias("row_no"))


def write_results(display_rows: DataFrame, root: str, job_id: str) -> int:
    """Materialise one job's result rows (display schema) in place of any earlier result.

    Returns the number of rows. Earlier versions are removed when the new one counts, but for
    the last, which a reader may still be at.
    """
    spark, path = display_rows.sparkSession, partition_path(root, job_id)
    rows = number_rows(display_rows.select(*DISPLAY_SCHEMA.fieldNames()), PAGE_ORDER)
    counted, version = Observation("result"), f"version={uuid.uuid4().hex}"
    rows = rows.observe(counted, F.count(F.lit(1)).alias("rows"))
    rows.sortWithinPartitions("row_no").write.parquet(f"{path}/{version}")
    entries = log.CommitLog(spark, path)
    earlier = entries.entries()
    entries.commit({"version": version, "rows": int(counted.get["rows"])})
    current = earlier[max(earlier)]["version"] if earlier else None
    for old in {e["version"] for e in earlier.values()} - {current}:
        log.remove(spark, f"{path}/{old}")
    return int(counted.get["rows"])


def drop_results(spark: SparkSession, root: str, job_id: str) -> bool:
    """Remove a job's result set; afterwards the job is unknown. False if there was none."""
    return log.remove(spark, partition_path(root, job_id))


def _current(spark: SparkSession, root: str, job_id: str) -> dict:
    """The entry of the job's result; KeyError for a job without one."""
    entries = log.CommitLog(spark, partition_path(root, job_id)).entries()
    if not entries:
        raise KeyError(f"no result of job {job_id!r}")
    return entries[max(entries)]


def job_results(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    """One job's rows, read from its own directory; KeyError for a job without a result."""
    path = f"{partition_path(root, job_id)}/{_current(spark, root, job_id)['version']}"
    rows = spark.read.schema(T.StructType(RESULT_SCHEMA.fields[:-1])).parquet(path)
    return rows.withColumn("job_id", F.lit(job_id))


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """The rows of every job's result."""
    jobs = [n.removeprefix("job_id=") for n in log.names(spark, root) if n.startswith("job_id=")]
    paths = [f"{partition_path(root, j)}/{_current(spark, root, j)['version']}" for j in jobs if log.names(spark, f"{partition_path(root, j)}/_log")]
    if not paths:
        return spark.createDataFrame([], RESULT_SCHEMA)
    return spark.read.schema(RESULT_SCHEMA).option("basePath", root).parquet(*paths).select(*RESULT_SCHEMA.fieldNames())


def result_count(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    """The number of a job's rows, as its result was written with."""
    return spark.createDataFrame([(_current(spark, root, job_id)["rows"],)], "rows long")


def job_rows(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    """A job's rows in display columns (no paging)."""
    return job_results(spark, root, job_id).select(*DISPLAY_SCHEMA.fieldNames())


def results_page(spark: SparkSession, root: str, job_id: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset+limit-1`` of a job's result in the stored total order."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must be >= 0")
    rows = job_results(spark, root, job_id)
    page = rows.filter(F.col("row_no").between(F.lit(offset), F.lit(offset + limit - 1)))
    return page.orderBy("row_no").select(*DISPLAY_SCHEMA.fieldNames())


def page_as_json(page: DataFrame) -> DataFrame:
    """Each row of a page as one JSON text (column ``value``)."""
    return page.select(F.to_json(F.struct(*page.columns)).alias("value"))
