"""Helpers to run a per-document kernel in Arrow batches and to materialise narrow tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowbeam.session import scratch_path, ship_package

#: Rows turned into Python objects at a time; long texts never pile up beyond this many.
ROWS_AT_ONCE = 128


def map_rows(
    df: DataFrame, columns: list[str], make_kernel: Callable[[], Callable], schema: str,
    many: bool = False, finish: Callable | None = None,
) -> DataFrame:
    """Apply a row kernel to ``columns`` of every row, one Arrow batch after another.

    ``make_kernel`` runs once per task and returns ``f(*values)``, which gives the output row
    as a tuple or, with ``many``, an iterable of tuples.
    """
    ship_package(df.sparkSession)
    out_schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = [kernel(*row) for row in zip(*(c.to_pylist() for c in part.columns))]
                if many:
                    rows = [r for group in rows for r in group]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow
                    )

    return df.select(*columns).mapInArrow(run, out_schema)


def add_columns(df: DataFrame, column: str, make_kernel: Callable[[], Callable], schema: str) -> DataFrame:
    """All columns of ``df`` in the struct ``row``, beside the kernel's columns for ``column``."""
    ship_package(df.sparkSession)
    out_schema = T.StructType([T.StructField("row", df.schema), *T._parse_datatype_string(schema)])
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = [kernel(x) for x in part.column("arg").to_pylist()]
                made = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays([part.column("row").cast(arrow.field(0).type), *made], schema=arrow)

    return df.select(F.struct("*").alias("row"), F.col(column).alias("arg")).mapInArrow(run, out_schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared scratch folder and read it back: computed once, lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables in the shared scratch folder that go when the block ends.

    ``store`` keeps a table for the block only, ``result`` one that outlives it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, scratch_path(spark, "scratch")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
