"""Projections between flow rows, display rows and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbeam.functions.protocol import protocol_name
from flowbeam.functions.time import format_time
from flowbeam.schema import DISPLAY_COLUMNS, DISPLAY_SCHEMA, require_columns


def to_display(flows: DataFrame, *extra: str) -> DataFrame:
    """Flow rows -> display rows (text time ``yyyy-MM-dd-HH:mm:ss`` UTC, protocol name)."""
    require_columns(flows, ["src_addr", "dst_addr", "src_port", "dst_port", "time_ms"])
    return flows.select(
        *extra,
        F.col("src_addr").alias("srcAddress"),
        F.col("dst_addr").alias("dstAddress"),
        F.col("src_port").alias("srcPort"),
        F.col("dst_port").alias("dstPort"),
        format_time(F.col("time_ms")).alias("time"),
        F.col("duration_ms").cast("long").alias("duration"),
        protocol_name(F.col("protocol")).alias("protocol"),
        F.col("bytes").cast("long").alias("bytes"),
        F.col("packets").cast("long").alias("packets"),
    )


def to_document(display: DataFrame, *extra: str) -> DataFrame:
    """Display rows -> one JSON text per row (column ``value``)."""
    require_columns(display, DISPLAY_SCHEMA, "display rows")
    return display.select(*extra, F.to_json(F.struct(*DISPLAY_COLUMNS)).alias("value"))


def from_document(docs: DataFrame, col: str = "value") -> DataFrame:
    """JSON texts -> display rows (missing fields become NULL)."""
    parsed = F.from_json(F.col(col), DISPLAY_SCHEMA).alias("_doc")
    return docs.select(parsed).select("_doc.*")
