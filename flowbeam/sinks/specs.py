"""Query-spec table: add specs under ids that nobody has taken, look one up by id.

Specs of one call are written to a directory of their own and count with one entry of the table's
commit log. Before an entry is written its ids are compared with those of all entries so far, and
the entry's number is taken exclusively: a writer that came second compares again. So an id is in
the table once, whoever writes at the same time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbeam.operators.spec import validate_spec
from flowbeam.schema import SPEC_SCHEMA
from flowbeam.sinks import log


def append_specs(specs: DataFrame, path: str) -> None:
    """Add spec rows (job_id, type, name, params); ValueError for an id that is null, twice there or taken.

    All rows are added or none.
    """
    spark, part = specs.sparkSession, f"part={uuid.uuid4().hex}"
    specs.select(*SPEC_SCHEMA.fieldNames()).write.parquet(f"{path}/{part}")
    written = spark.read.schema(SPEC_SCHEMA).parquet(f"{path}/{part}")
    try:
        twice = written.groupBy("job_id").count().filter("count > 1 or job_id is null").first()
        if twice is not None:
            raise ValueError(f"spec id {twice['job_id']!r} is null or given twice")
        entries = log.CommitLog(spark, path)
        while True:
            last, known = entries.last(), _committed(spark, path)
            if known:
                taken = written.join(spark.read.schema(SPEC_SCHEMA).parquet(*known), "job_id", "left_semi").first()
                if taken is not None:
                    raise ValueError(f"spec {taken['job_id']!r} exists")
            if entries.commit({"part": part}, last + 1) is not None:
                return
    except ValueError:
        log.remove(spark, f"{path}/{part}")
        raise


def _committed(spark: SparkSession, path: str) -> list[str]:
    return [f"{path}/{e['part']}" for _, e in sorted(log.CommitLog(spark, path).entries().items())]


def insert_spec(spark: SparkSession, path: str, job_id: str, kind: str, name: str, params: Mapping[str, str]) -> None:
    """Validate one spec on the driver and add it; ValueError for an id that is taken."""
    validate_spec({"name": name, "type": kind, "params": dict(params)})
    row = [(job_id, kind, name, {str(k): str(v) for k, v in params.items()})]
    append_specs(spark.createDataFrame(row, SPEC_SCHEMA), path)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    parts = _committed(spark, path)
    return spark.read.schema(SPEC_SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], SPEC_SCHEMA)


def find_spec(spark: SparkSession, path: str, job_id: str) -> dict:
    """The spec with ``job_id`` as a dict; KeyError when absent (one row crosses to the driver)."""
    rows = read_specs(spark, path).filter(F.col("job_id") == F.lit(job_id)).limit(1).collect()
    if not rows:
        raise KeyError(f"spec {job_id!r} not found")
    return rows[0].asDict(recursive=True)
