"""Index of a document folder for term lookups: where the documents of an address are.

JSON lines hold no statistics, so a term query over them reads everything. The index is a Parquet
table beside the documents with one narrow row for each: its terms (addresses, ports, protocol),
its time and its raw text. It is partitioned by month, sorted by source within files, and has
Bloom filters on both addresses; so a lookup reads the row groups that may hold the term, whichever
address it is about. The text in the index is what was written, byte by byte.

``index_documents`` adds the folder's new files, as the ledger of the index tells, and may be run
after every ingest. Lines that are no whole document are not indexed; ``split_documents`` gives
them with a reason.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbeam.functions.time import parse_time, utc_date
from flowbeam.operators.project import from_document
from flowbeam.schema import DISPLAY_COLUMNS, DISPLAY_SCHEMA
from flowbeam.sinks.ledger import BATCH_COLUMN, Ledger, only_closed
from flowbeam.sources.documents import split_lines

#: Fields with a Bloom filter: values in no order of the files.
BLOOM_FIELDS = ("srcAddress", "dstAddress")
#: Bytes of a row group; a lookup reads whole ones.
ROW_GROUP_BYTES = 8 << 20
_ROWS_PER_GROUP = 20_000


def index_path(documents: str) -> str:
    """Where the index of a document folder lies (readers of the folder do not see it)."""
    return f"{documents.rstrip('/')}/_index"


def index_documents(spark: SparkSession, documents: str, row_group_bytes: int = ROW_GROUP_BYTES) -> int:
    """Index the document files that the index does not hold; returns how many there were."""
    path = index_path(documents)
    ledger = Ledger(spark, path)
    for stale in ledger.unfinished("index-"):
        ledger.forget(stale)
    lines = only_closed(spark.read.text(documents), documents)
    files = lines.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    listed = files.select(
        F.col("file_path").alias("path"), F.col("file_size").alias("length"),
        F.unix_millis("file_modification_time").alias("modified_ms"),
    )
    batch = f"index-{uuid.uuid4().hex[:16]}"
    new = ledger.open(batch, ledger.new_files(listed))
    count = new.count()
    if not count:
        ledger.forget(batch)
        return 0
    own = lines.select("value", F.col("_metadata.file_path").alias("path"))
    docs, _ = split_lines(own.join(new.select("path"), "path", "left_semi").select("value"), keep_text=True)
    # documents whose time is not in our format are under no month
    month = F.trunc(utc_date(parse_time(F.col("time"))), "month")
    rows = docs.select(*DISPLAY_COLUMNS, "value", month.alias("month"))
    writer = (
        rows.hint("rebalance", "month")
        .sortWithinPartitions("month", "srcAddress", "dstAddress")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("parquet.block.size", row_group_bytes)
    )
    for field in BLOOM_FIELDS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{field}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{field}", _ROWS_PER_GROUP)
    # a dictionary per column chunk would answer for small files only
    writer.option("parquet.enable.dictionary#srcAddress", "false").option("parquet.enable.dictionary#dstAddress", "false").partitionBy(
        "month"
    ).parquet(f"{path}/{BATCH_COLUMN}={batch}")
    ledger.close(batch, documents=count)
    return count


def read_index(spark: SparkSession, documents: str) -> DataFrame:
    """Indexed documents: display columns, ``value`` (the text) and ``month``."""
    path = index_path(documents)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in DISPLAY_SCHEMA.fields)}, value string, {BATCH_COLUMN} string, month date"
    return only_closed(spark.read.schema(schema).option("basePath", path).parquet(path), path).drop(BATCH_COLUMN)


def indexed_term_query(spark: SparkSession, documents: str, field: str, value, days: tuple[str, str] | None = None) -> DataFrame:
    """Documents whose ``field`` equals ``value``, as display rows, through the index.

    ``days`` (first and last ISO date) leaves other months' files unopened. Documents that were
    added after the last ``index_documents`` are not found.
    """
    if field not in DISPLAY_COLUMNS:
        raise ValueError(f"unknown document field {field!r}")
    rows = read_index(spark, documents).filter(F.col(field) == F.lit(value))
    if days is not None:
        first, last = (F.trunc(F.lit(d).cast("date"), "month") for d in days)
        rows = rows.filter(F.col("month").between(first, last))
        # times are texts that sort as times; "." sorts after the "-" that ends a date
        rows = rows.filter(F.col("time").between(F.lit(days[0]), F.lit(f"{days[1]}.")))
    return from_document(rows.select("value"), "value")
