"""Flow table sinks (partitioned Parquet, documents, keyed) and the sink choice by mode.

Write layout at scale: rows are redistributed with the ``REBALANCE`` hint on the date
columns before the write. Each task then holds whole days (files = days plus splits, not
tasks x days), and AQE splits a partition that grows past the advisory size (a day holding
a third of all rows becomes many tasks and files) and merges tiny ones; unlike a range
repartition there is no extra sampling pass over the input. Inside each file rows are
sorted by ``src_addr`` and time, so Parquet row-group statistics prune address lookups.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowbeam.functions.time import date_parts
from flowbeam.operators.curve import address_curve
from flowbeam.operators.project import to_display
from flowbeam.schema import FLOW_COLUMNS, FLOW_SCHEMA, PARTITION_COLUMNS, require_columns
from flowbeam.sinks import log

# Sink modes (search documents and a keyed store are written as files here).
MODE_PARQUET = "parquet"
MODE_DOCUMENTS = "documents"
MODE_KEYED = "keyed"
MODES = (MODE_PARQUET, MODE_DOCUMENTS, MODE_KEYED)
MODE_ALIASES = {"elastic": MODE_DOCUMENTS, "hbase": MODE_KEYED}

# Rows per output file.
MAX_RECORDS_PER_FILE = 1 << 20
# Bytes of a row group of files along the address curve, and about those of a row in them.
CURVE_ROW_GROUP_BYTES = 2 << 20
CURVE_ROW_BYTES = 24


def with_date_partitions(flows: DataFrame) -> DataFrame:
    """Flow columns plus (year, month, day) of the UTC start date."""
    require_columns(flows, FLOW_SCHEMA, "flows")
    return flows.select(*FLOW_COLUMNS, *date_parts(F.col("time_ms")))


def write_partitioned(
    flows: DataFrame,
    path: str,
    mode: str = "append",
    observation: Observation | None = None,
    by_curve: bool = False,
    row_group_bytes: int = CURVE_ROW_GROUP_BYTES,
) -> None:
    """Append flows under ``path/year=Y/month=M/day=D`` (1-based month, UTC).

    Files are sorted by source and time, or ``by_curve`` of both addresses, with small row groups
    and Bloom filters on them: lookups by destination then skip row groups as well.
    """
    out = with_date_partitions(flows).hint("rebalance", *PARTITION_COLUMNS)
    if observation is not None:
        out = out.observe(observation, F.count(F.lit(1)).alias("rows"))
    if by_curve:
        # a column of its own: computed once a row, not once a comparison
        out = out.withColumn("_curve", address_curve(F.col("src_addr"), F.col("dst_addr")))
    order = ["_curve"] if by_curve else ["src_addr"]
    writer = (
        out.sortWithinPartitions(*PARTITION_COLUMNS, *order, "time_ms")
        .drop("_curve")
        .write.mode(mode)
        # "overwrite" replaces everything under ``path`` whatever the session's default
        .option("partitionOverwriteMode", "static")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    )
    if by_curve:
        writer = writer.option("parquet.block.size", row_group_bytes)
        for column in ("src_addr", "dst_addr"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", row_group_bytes // CURVE_ROW_BYTES)
    writer.partitionBy(*PARTITION_COLUMNS).parquet(path)


def compact_flows(spark: SparkSession, path: str, everything: bool = False) -> int:
    """Rewrite the batches added since the last compaction (or ``everything``) as one batch.

    Small files of a day become few sized ones, along the curve of both addresses. The new batch
    replaces the old ones in a single ledger entry: readers see either. Returns how many batches
    were replaced; their directories stay until ``drop_replaced_batches``.
    """
    from flowbeam.sinks.ledger import BATCH_COLUMN, Ledger
    from flowbeam.sources.flows import read_flows

    ledger = Ledger(spark, path)
    old = [b for b in ledger.live() if everything or not b.startswith("compact-")]
    if len(old) < 2:
        return 0
    batch = f"compact-{uuid.uuid4().hex[:16]}"
    rows = read_flows(spark, path).filter(F.col(BATCH_COLUMN).isin(old)).select(*FLOW_COLUMNS)
    write_partitioned(rows, f"{path.rstrip('/')}/{BATCH_COLUMN}={batch}", "overwrite", by_curve=True)
    ledger.close(batch, replaces=old)
    return len(old)


def drop_replaced_batches(spark: SparkSession, path: str) -> int:
    """Remove directories of replaced batches; run it when no reader is under way."""
    from flowbeam.sinks.ledger import BATCH_COLUMN, Ledger

    ledger = Ledger(spark, path)
    replaced = sorted(ledger.closed() - set(ledger.live()))
    return sum(log.remove(spark, f"{path.rstrip('/')}/{BATCH_COLUMN}={b}") for b in replaced)


def write_documents(flows: DataFrame, path: str, mode: str = "append") -> None:
    """Flows as JSON-lines documents of display rows (one document per flow)."""
    to_display(flows).write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).json(path)


def write_flows(
    flows: DataFrame, path: str, mode: str = MODE_PARQUET, save_mode: str = "append", token: str | None = None
) -> Observation:
    """Write flows with the sink named by ``mode``; returns an Observation with the row count.

    ``save_mode`` applies to the Parquet and document sinks. The keyed table at ``path`` is
    updated, and created by the first write; a ``token`` it has seen is counted but not written.
    """
    mode = MODE_ALIASES.get(mode, mode)
    if mode not in MODES:
        raise ValueError(f"unknown write mode {mode!r}; want one of {MODES}")
    obs = Observation("flow_sink")
    if mode == MODE_PARQUET:
        write_partitioned(flows, path, mode=save_mode, observation=obs)
    elif mode == MODE_DOCUMENTS:
        write_documents(flows.observe(obs, F.count(F.lit(1)).alias("rows")), path, save_mode)
    else:
        from flowbeam.sinks.keyed import update_keyed

        counted = flows.observe(obs, F.count(F.lit(1)).alias("rows"))
        if not update_keyed(counted, path, token=token):
            counted.write.format("noop").mode("overwrite").save()
    return obs
