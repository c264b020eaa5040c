"""Counts: result rows, flows per calendar day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbeam.functions.time import date_parts
from flowbeam.schema import require_columns


def row_count(df: DataFrame, name: str = "flows") -> DataFrame:
    """One-row DataFrame with the number of rows (partial counts per task, one tiny shuffle)."""
    return df.agg(F.count(F.lit(1)).alias(name))


def flows_per_day(flows: DataFrame) -> DataFrame:
    """(year, month, day, flows, bytes) per UTC calendar day of the flow start."""
    require_columns(flows, ["time_ms", "bytes"], "flows")
    return flows.groupBy(*date_parts(F.col("time_ms"))).agg(
        F.count(F.lit(1)).alias("flows"), F.sum(F.col("bytes").cast("long")).alias("bytes")
    )
