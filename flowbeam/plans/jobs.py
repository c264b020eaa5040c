"""End-to-end jobs: what a user runs, as Spark jobs over flow tables.

* ``run_flow_query``   - validate a spec, filter the flow table, store display rows per job.
* ``run_top_pairs``    - host pairs exchanging the most bytes (all flows, or keyed semantics).
* ``run_source_lookup``- flows of one source address in the keyed table, and their count.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Row, SparkSession

from flowbeam.operators import filters, project, spec, toptalk
from flowbeam.sinks.results import write_results
from flowbeam.sources.documents import read_documents
from flowbeam.sources.flows import load_flows
from flowbeam.sources.keyed import read_keyed, source_lookup


def run_flow_query(
    spark: SparkSession, flows_path: str, job: Mapping, results_root: str, loader: str = "parquet"
) -> int:
    """Validate ``job`` (job_id, name, type, params), run it, store its rows; returns the row count.

    The rows are counted while they are written (no second pass over the flow table).
    """
    flow_spec = spec.validate_spec(job)
    if flow_spec is None:
        raise ValueError(f"spec {job.get('job_id')!r} is not a flow query")
    flows = load_flows(spark, flows_path, loader)
    rows = project.to_display(filters.flow_query(flows, flow_spec))
    return write_results(rows, results_root, job["job_id"])


def top_pairs_source(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Flow rows for top pairs from a stored table of the given kind."""
    if kind == "parquet":
        return load_flows(spark, path)
    if kind == "documents":
        docs = read_documents(spark, path)
        return docs.selectExpr("srcAddress as src_addr", "dstAddress as dst_addr", "bytes")
    if kind == "keyed":
        return read_keyed(spark, path)
    raise ValueError(f"unknown source kind {kind!r}")


def run_top_pairs(spark: SparkSession, path: str, n: int = 10, kind: str = "parquet", show: bool = True) -> list[Row]:
    """Top ``n`` pairs by bytes; only ``n`` rows reach the driver. Prints ``(a,b,bytes)`` lines."""
    if n < 0:
        raise ValueError("n must be >= 0")
    rows = toptalk.top_pairs(top_pairs_source(spark, path, kind), n).collect()
    if show:
        for r in rows:
            print(f"({r.addr_a},{r.addr_b},{r.bytes})")
    return rows


def run_source_lookup(spark: SparkSession, keyed_path: str, src_addr: str, use_store_filter: bool = True) -> int:
    """Number of keyed-table flows whose source is ``src_addr`` (and prints it)."""
    n = project.to_display(source_lookup(spark, keyed_path, src_addr, use_store_filter)).count()
    print(f"flows from {src_addr}: {n}")
    return n
