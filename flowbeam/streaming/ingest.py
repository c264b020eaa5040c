"""Incremental capture ingest: ``readStream.format("binaryFile")`` -> framing -> decode -> sinks.

The stream carries names, lengths and times of arriving files; each micro-batch (bounded by the
bytes of its files, so that many small files do not make many batches: a batch costs a directory a
day) frames its files by byte ranges and goes to the flow sink (Parquet,
documents or keyed) and the rejects table with ``foreachBatch``. It is a batch of the table's
ledger, named by the stream and its number, and counts when its ledger entry is written, after
both sinks. A micro-batch replayed after a failure overwrites its own directories, or finds its
name in the keyed table; one replayed after its entry finds all its files in the ledger. So output
is exactly once in each sink, also when a checkpoint is lost or a folder is ingested in batch too.
The stream's checkpoint lies beside the flow table by the landing folder's full name: a restarted
query continues where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowbeam.plans.ingest import ingest_files, source_id, write_batch
from flowbeam.sinks.ledger import Ledger
from flowbeam.sinks.log import qualified

#: Bytes of capture files in a micro-batch.
TRIGGER_BYTES = 16 << 30

BINARY_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def capture_stream(
    spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None, max_bytes_per_trigger: int = TRIGGER_BYTES
) -> DataFrame:
    """Streaming DataFrame of (path, length, modified_ms) of files arriving under ``landing_dir``.

    A micro-batch has so many bytes of files, or so many files if their number is given.
    """
    bound = ("maxBytesPerTrigger", max_bytes_per_trigger) if max_files_per_trigger is None else ("maxFilesPerTrigger", max_files_per_trigger)
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option(*bound).load(landing_dir)
    return files.select("path", "length", F.unix_millis("modificationTime").alias("modified_ms"))


def write_stream_batch(
    frames: DataFrame, batch_id: int, flows_path: str, rejects_path: str, stream_id: str = "stream"
) -> None:
    """Write one micro-batch of frames idempotently, without a ledger (a replay of ``batch_id`` overwrites its own output)."""
    part = f"ingest_batch={stream_id}-{int(batch_id)}"
    write_batch(
        frames, f"{flows_path.rstrip('/')}/{part}", f"{rejects_path.rstrip('/')}/{part}", save_mode="overwrite"
    )


def ingest_stream_batch(
    files: DataFrame, batch_id: int, flows_path: str, rejects_path: str, stream_id: str, mode: str = "parquet"
) -> None:
    """Ingest one micro-batch of listed files, unless the ledger has them."""
    ledger = Ledger(files.sparkSession, flows_path)
    new, batch = ledger.new_files(files), f"{stream_id}-{int(batch_id)}"
    if new.isEmpty():
        return
    if batch in ledger.closed():  # numbers began again with a new checkpoint
        batch = f"{batch}-{uuid.uuid4().hex[:8]}"
    ingest_files(ledger, batch, new, rejects_path, mode)


def start_capture_ingest(
    spark: SparkSession,
    landing_dir: str,
    flows_path: str,
    rejects_path: str,
    checkpoint: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    processing_time: str = "30 seconds",
    mode: str = "parquet",
    max_bytes_per_trigger: int = TRIGGER_BYTES,
) -> StreamingQuery:
    """Start the ingest query; ``available_now`` processes what is there and stops.

    An own ``checkpoint`` names a stream of its own: batch numbers belong to it.
    """
    stream_id = "stream-" + source_id(qualified(spark, landing_dir), checkpoint or "")
    checkpoint = checkpoint or f"{flows_path.rstrip('/')}/_checkpoints/{stream_id}"

    def each_batch(files: DataFrame, batch_id: int) -> None:
        ingest_stream_batch(files, batch_id, flows_path, rejects_path, stream_id, mode)

    writer = (
        capture_stream(spark, landing_dir, max_files_per_trigger, max_bytes_per_trigger)
        .writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()
