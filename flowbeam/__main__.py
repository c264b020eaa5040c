"""Command line: ``spark-submit flowbeam/__main__.py <command> ...`` or ``python -m flowbeam``.

Commands (each one Spark application):

  ingest    <captures> <flows> <rejects> [--mode parquet|documents|keyed]
  stream    <landing> <flows> <rejects> [--checkpoint DIR] [--max-files N] [--continuous]
  query     <flows> <results> --job-id ID --name NAME [--param key=value ...]
  page      <results> --job-id ID [--offset N] [--limit N]
  top-pairs <path> [--print N] [--kind parquet|documents|keyed]
  lookup    <keyed> <src_addr> [--scan-filter true|false]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _bool(text: str) -> bool:
    value = text.strip().lower()
    if value not in ("true", "false"):
        raise argparse.ArgumentTypeError(f"want true or false, got {text!r}")
    return value == "true"


def _param(text: str) -> tuple[str, str]:
    if "=" not in text:
        raise argparse.ArgumentTypeError(f"want key=value, got {text!r}")
    key, value = text.split("=", 1)
    return key, value


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="flowbeam", description="Network-flow jobs on Spark")
    sub = parser.add_subparsers(dest="command", required=True)

    p = sub.add_parser("ingest", help="capture files -> flow table + rejects")
    p.add_argument("captures")
    p.add_argument("flows")
    p.add_argument("rejects")
    p.add_argument("--mode", default="parquet", help="parquet, documents (elastic) or keyed (hbase)")

    p = sub.add_parser("stream", help="ingest capture files as they arrive")
    p.add_argument("landing")
    p.add_argument("flows")
    p.add_argument("rejects")
    p.add_argument("--checkpoint")
    p.add_argument("--max-files", type=int, help="files of a micro-batch (default: as many as its bytes allow)")
    p.add_argument("--continuous", action="store_true", help="keep running (default: process what is there)")

    p = sub.add_parser("query", help="run one flow-query spec and store its rows")
    p.add_argument("flows")
    p.add_argument("results")
    p.add_argument("--job-id", required=True)
    p.add_argument("--name", required=True)
    p.add_argument("--param", type=_param, action="append", default=[], help="start=..., src_addr=...")

    p = sub.add_parser("page", help="print a page of a stored result as JSON lines")
    p.add_argument("results")
    p.add_argument("--job-id", required=True)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--limit", type=int, default=100)

    p = sub.add_parser("top-pairs", help="host pairs exchanging the most bytes")
    p.add_argument("path")
    p.add_argument("--print", dest="n", type=int, default=10)
    p.add_argument("--kind", default="parquet", choices=["parquet", "documents", "keyed"])

    p = sub.add_parser("lookup", help="count flows of one source address in a keyed table")
    p.add_argument("keyed")
    p.add_argument("src_addr")
    p.add_argument("--scan-filter", type=_bool, default=True)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    from flowbeam.session import get_session

    spark = spark or get_session(app=f"flowbeam-{args.command}")
    if args.command == "ingest":
        from flowbeam.plans.ingest import ingest_captures

        counts = ingest_captures(spark, args.captures, args.flows, args.rejects, args.mode)
        print(f"flows written: {counts.flows}, rejects: {counts.rejects}")
    elif args.command == "stream":
        from flowbeam.streaming.ingest import start_capture_ingest

        query = start_capture_ingest(
            spark, args.landing, args.flows, args.rejects, checkpoint=args.checkpoint,
            available_now=not args.continuous, max_files_per_trigger=args.max_files,
        )
        query.awaitTermination()
    elif args.command == "query":
        from flowbeam.plans.jobs import run_flow_query

        job = {"job_id": args.job_id, "name": args.name, "type": "FlowQuery", "params": dict(args.param)}
        print(f"rows: {run_flow_query(spark, args.flows, job, args.results)}")
    elif args.command == "page":
        from flowbeam.sinks.results import page_as_json, results_page

        page = page_as_json(results_page(spark, args.results, args.job_id, args.offset, args.limit))
        for row in page.collect():  # one page: at most ``limit`` rows
            print(row.value)
    elif args.command == "top-pairs":
        from flowbeam.plans.jobs import run_top_pairs

        run_top_pairs(spark, args.path, args.n, args.kind)
    elif args.command == "lookup":
        from flowbeam.plans.jobs import run_source_lookup

        run_source_lookup(spark, args.keyed, args.src_addr, args.scan_filter)
    return 0


if __name__ == "__main__":
    sys.exit(main())
