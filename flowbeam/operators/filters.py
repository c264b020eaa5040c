"""Flow predicates: time range, addresses, ports, protocol; date-partition pruning.

All predicates are plain Catalyst comparisons against literals, so on a stored flow table
they reach the Parquet scan (``PushedFilters``), and the derived ``make_date(year, month,
day)`` bound prunes date partitions (``PartitionFilters``).
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbeam.functions.time import MS_PER_DAY
from flowbeam.operators.spec import FlowSpec
from flowbeam.schema import PARTITION_COLUMNS, require_columns


def time_between(start_ms: int, end_ms: int, col: str = "time_ms") -> Column:
    """Start time within [start_ms, end_ms], both ends inclusive."""
    return F.col(col).between(F.lit(start_ms), F.lit(end_ms))


def partition_range(start_ms: int, end_ms: int) -> Column:
    """Bound on the (year, month, day) partition columns covering [start_ms, end_ms] (UTC)."""
    d1 = F.date_from_unix_date(F.lit(start_ms // MS_PER_DAY))
    d2 = F.date_from_unix_date(F.lit(end_ms // MS_PER_DAY))
    return F.make_date(*[F.col(c) for c in PARTITION_COLUMNS]).between(d1, d2)


def spec_predicates(spec: FlowSpec) -> list[Column]:
    preds = [time_between(spec.start_ms, spec.end_ms)]
    if spec.src_addr is not None:
        preds.append(F.col("src_addr") == F.lit(spec.src_addr))
    if spec.dst_addr is not None:
        preds.append(F.col("dst_addr") == F.lit(spec.dst_addr))
    if spec.src_port is not None:
        preds.append(F.col("src_port") == F.lit(spec.src_port))
    if spec.dst_port is not None:
        preds.append(F.col("dst_port") == F.lit(spec.dst_port))
    if spec.protocol is not None:
        preds.append(F.col("protocol") == F.lit(spec.protocol))
    return preds


def flow_query(flows: DataFrame, spec: FlowSpec) -> DataFrame:
    """Flows matching every parameter present in ``spec`` (one conjunctive filter)."""
    require_columns(flows, ["time_ms", "src_addr", "dst_addr", "src_port", "dst_port", "protocol"])
    preds = spec_predicates(spec)
    if all(c in flows.columns for c in PARTITION_COLUMNS):
        preds.append(partition_range(spec.start_ms, spec.end_ms))
    return flows.filter(functools.reduce(operator.and_, preds))


def by_source(flows: DataFrame, src_addr: str) -> DataFrame:
    return flows.filter(F.col("src_addr") == F.lit(src_addr))


def by_destination(flows: DataFrame, dst_addr: str) -> DataFrame:
    return flows.filter(F.col("dst_addr") == F.lit(dst_addr))


def in_time_range(flows: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    cond = time_between(start_ms, end_ms)
    if all(c in flows.columns for c in PARTITION_COLUMNS):
        cond = cond & partition_range(start_ms, end_ms)
    return flows.filter(cond)
