"""Ingested files and the batches of a flow table.

``<flows>/_ledger/files/batch=<id>`` lists the files (path, length, modification time) of a batch
before any of its rows are written; an entry of the table's commit log closes the batch when its
flows and rejects are complete. A file counts as ingested when it is in a closed batch, so a
folder may be ingested again and again: only files that are new or have changed are read, and a
batch that broke off is done again as a whole. Readers take closed batches only. Compaction adds
a batch that replaces others in the same entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbeam.sinks import log

FILE_COLUMNS = ["path", "length", "modified_ms"]
FILES_SCHEMA = "path string, length bigint, modified_ms bigint, batch string"
BATCH_COLUMN = "ingest_batch"


class Ledger:
    """The ledger of the flow table (or documents, or keyed table) at ``table``."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table.rstrip("/")
        self.files_root = f"{self.table}/_ledger/files"
        self.log = log.CommitLog(spark, f"{self.table}/_ledger")

    def exists(self) -> bool:
        return log.exists(self.spark, f"{self.table}/_ledger")

    def closed(self) -> set[str]:
        """Batches whose files are ingested."""
        return {e["batch"] for e in self.log.entries().values()}

    def live(self) -> list[str]:
        """Closed batches that no compaction has replaced."""
        entries = self.log.entries().values()
        return sorted({e["batch"] for e in entries} - {b for e in entries for b in e.get("replaces", ())})

    def unfinished(self, prefix: str) -> list[str]:
        """Batches of that prefix with listed files that were never closed."""
        listed = {n.removeprefix("batch=") for n in log.names(self.spark, self.files_root) if n.startswith("batch=")}
        return sorted(b for b in listed - self.closed() if b.startswith(prefix))

    def new_files(self, files: DataFrame) -> DataFrame:
        """The listed files that no closed batch holds."""
        closed = self.closed()
        files = files.select(*FILE_COLUMNS)
        if not closed or not log.names(self.spark, self.files_root):
            return files
        known = self.spark.read.schema(FILES_SCHEMA).parquet(self.files_root).filter(F.col("batch").isin(sorted(closed)))
        return files.join(known, FILE_COLUMNS, "left_anti")

    def open(self, batch: str, files: DataFrame) -> DataFrame:
        """Write down a batch's files and give them back as written."""
        path = f"{self.files_root}/batch={batch}"
        files.select(*FILE_COLUMNS).write.mode("overwrite").parquet(path)
        return self.spark.read.schema("path string, length bigint, modified_ms bigint").parquet(path)

    def close(self, batch: str, **entry: object) -> None:
        self.log.commit({"batch": batch, **entry})

    def forget(self, batch: str) -> None:
        log.remove(self.spark, f"{self.files_root}/batch={batch}")


def only_closed(rows: DataFrame, table: str) -> DataFrame:
    """Rows of the table's live batches; all rows of a table that has no ledger."""
    if BATCH_COLUMN not in rows.columns:
        return rows
    ledger = Ledger(rows.sparkSession, table)
    return rows.filter(F.col(BATCH_COLUMN).isin(ledger.live())) if ledger.exists() else rows
