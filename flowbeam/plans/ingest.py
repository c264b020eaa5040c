"""Capture files -> decoded flows (date-partitioned Parquet, documents or keyed) + rejects.

A folder is ingested as often as one likes: the ledger of the flow table tells which files are
new. They are dealt into batches of bounded size, and each batch is one framing pass whose frames
are kept (memory, then disk) while both of its tables are written. A lost executor only costs a
recomputation of its frames from the files; a run that breaks off leaves an unfinished batch,
whose output the next run removes before it ingests those files again.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowbeam.operators.decode import decode
from flowbeam.schema import REJECT_SCHEMA
from flowbeam.sinks import log
from flowbeam.sinks.flows import MODE_ALIASES, MODE_DOCUMENTS, MODE_PARQUET, write_flows
from flowbeam.sinks.ledger import BATCH_COLUMN, Ledger
from flowbeam.sources.capture import RANGE_BYTES, frames_from_files, scan_files, udp_payloads

#: Bytes of capture files whose frames are kept at a time.
BATCH_BYTES = 256 << 30


@dataclass
class IngestCounts:
    flows: int
    rejects: int


def decode_frames(frames: DataFrame, fmt: str = "v5") -> tuple[DataFrame, DataFrame]:
    """Framed capture rows -> (flows, rejects of frames and packets in REJECT_SCHEMA)."""
    payloads, frame_rejects = udp_payloads(frames)
    flows, packet_rejects = decode(payloads.drop("ts_ms"), fmt)
    rejects = frame_rejects.unionByName(packet_rejects.select(*REJECT_SCHEMA.fieldNames()))
    return flows.drop("path", "frame_no"), rejects


def write_batch(
    frames: DataFrame, flows_path: str, rejects_path: str, mode: str = "parquet", save_mode: str = "append",
    token: str | None = None,
) -> IngestCounts:
    """Write one batch of framed rows to the flow sink and the rejects table.

    ``token`` names the batch to a keyed table, which takes it only once.
    """
    frames = frames.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        flows, rejects = decode_frames(frames)
        flow_obs = write_flows(flows, flows_path, mode, save_mode, token)
        reject_obs = Observation("rejects")
        rejects.observe(reject_obs, F.count(F.lit(1)).alias("rows")).write.mode(save_mode).parquet(rejects_path)
        return IngestCounts(int(flow_obs.get["rows"]), int(reject_obs.get["rows"]))
    finally:
        frames.unpersist()


def source_id(*names: str) -> str:
    """A short stable name for an input folder."""
    return hashlib.sha256("\0".join(n.rstrip("/") for n in names).encode()).hexdigest()[:12]


def batch_paths(batch: str, flows_path: str, rejects_path: str, mode: str) -> tuple[str, str]:
    """Where a batch's flows and rejects go (a keyed table has no directories of batches)."""
    part = f"{BATCH_COLUMN}={batch}"
    keyed = MODE_ALIASES.get(mode, mode) not in (MODE_PARQUET, MODE_DOCUMENTS)
    return flows_path if keyed else f"{flows_path.rstrip('/')}/{part}", f"{rejects_path.rstrip('/')}/{part}"


def ingest_files(
    ledger: Ledger, batch: str, files: DataFrame, rejects_path: str, mode: str = "parquet", range_bytes: int = RANGE_BYTES
) -> IngestCounts:
    """Ingest listed files as one batch. A batch that broke off is written again as a whole."""
    files = ledger.open(batch, files)
    flows_to, rejects_to = batch_paths(batch, ledger.table, rejects_path, mode)
    counts = write_batch(frames_from_files(files, range_bytes), flows_to, rejects_to, mode, "overwrite", batch)
    ledger.close(batch, flows=counts.flows, rejects=counts.rejects)
    return counts


def ingest_captures(
    spark: SparkSession,
    capture_path: str,
    flows_path: str,
    rejects_path: str,
    mode: str = "parquet",
    batch_bytes: int = BATCH_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> IngestCounts:
    """Ingest every capture file under ``capture_path`` that the table does not hold yet.

    A file is known by its path, length and modification time. Returns what this run added. Flows
    (Parquet or documents) and rejects go to ``ingest_batch=<id>`` below their tables. Batch runs
    on one table take turns; streams may run beside them.
    """
    ledger = Ledger(spark, flows_path)
    for stale in ledger.unfinished("batch-"):
        for path in batch_paths(stale, flows_path, rejects_path, mode):
            if path != flows_path:
                log.remove(spark, path)
        ledger.forget(stale)
    files = ledger.new_files(scan_files(spark, capture_path))
    total = files.agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files")).first()
    counts = IngestCounts(0, 0)
    parts = max(1, -(-(total["bytes"] or 0) // batch_bytes))
    for part in range(parts if total["files"] else 0):
        some = files.filter(F.pmod(F.xxhash64("path"), F.lit(parts)) == part)
        if parts > 1 and some.isEmpty():
            continue
        added = ingest_files(ledger, f"batch-{uuid.uuid4().hex[:16]}", some, rejects_path, mode, range_bytes)
        counts = IngestCounts(counts.flows + added.flows, counts.rejects + added.rejects)
    return counts
