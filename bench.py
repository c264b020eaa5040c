"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each step forces full evaluation (``collect`` for small results, the ``noop`` sink for
large ones). Queries run once to warm up (code generation, JIT) and then three times; the
median is reported. Writes run once to warm up and once timed, each into a fresh path.
Inputs that a query reads from storage (keyed table, documents, v5 packets, capture files)
are prepared first and not timed; their write rates are reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from flowbeam.plans import catalog  # noqa: E402
from flowbeam.session import get_session, scratch_path  # noqa: E402


def timed(fn, runs: int = 3):
    """(median seconds of ``runs`` timed runs after one warm-up run, last result)."""
    fn()
    times, out = [], None
    for _ in range(runs):
        t0 = time.perf_counter()
        out = fn()
        times.append(time.perf_counter() - t0)
    return statistics.median(times), out


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        f"local[{cpus}]",
        app="flowbeam-bench",
        **{"spark.sql.shuffle.partitions": str(int(cpus) * 2), "spark.driver.memory": "16g"},
    )
    from flowbeam.operators.decode import decode
    from flowbeam.operators.encode import encode_v5
    from flowbeam.sinks.capture import write_capture_files
    from flowbeam.sinks.flows import write_documents, write_partitioned
    from flowbeam.sinks.keyed import upsert_keyed
    from flowbeam.sources.capture import read_capture
    from flowbeam.sources.documents import read_documents, term_query
    from flowbeam.sources.flows import read_flows
    from flowbeam.sources.keyed import source_lookup
    from flowbeam.sources.testviews import ORDER_KEYS, flows_view

    flows = flows_view(spark, sf_dir, keep_keys=False)
    n_flows = flows.count()  # also warms up the JVM
    catalog.top_pairs_by_bytes(spark, sf_dir).collect()

    q, rates = {}, {}
    q["top_pairs"], _ = timed(lambda: catalog.top_pairs_by_bytes(spark, sf_dir).collect())
    q["full_spec_query"], _ = timed(lambda: catalog.flow_query_full(spark, sf_dir).collect())
    q["flow_query_count"], _ = timed(lambda: catalog.flow_query_count(spark, sf_dir).collect())
    q["flows_per_day"], _ = timed(lambda: catalog.flows_per_day(spark, sf_dir).collect())
    q["latest_per_pair"], _ = timed(lambda: noop(catalog.latest_per_pair(spark, sf_dir)))
    q["multi_spec_query"], _ = timed(lambda: noop(catalog.multi_spec_query(spark, sf_dir)))
    q["spec_validation"], _ = timed(lambda: noop(catalog.spec_validation(spark, sf_dir)))

    def timed_write(name, write):
        """Time ``write(path)`` into a fresh path (warm-up run into another); returns the path."""
        paths = [scratch_path(spark, f"bench-{name}-warm"), scratch_path(spark, f"bench-{name}")]
        runs = iter(paths)
        seconds, _ = timed(lambda: write(next(runs)), runs=1)
        return seconds, paths[1]

    q["partitioned_write"], path = timed_write("flows", lambda p: write_partitioned(flows, p))
    rates["partitioned_write_rows_per_s"] = n_flows / q["partitioned_write"]
    q["partitioned_range"], _ = timed(lambda: noop(catalog.filters.in_time_range(
        read_flows(spark, path), catalog._ms(catalog.RANGE_SPEC["start"]), catalog._ms(catalog.RANGE_SPEC["end"]))))

    t_keyed, keyed = timed_write(
        "keyed", lambda p: upsert_keyed(flows_view(spark, sf_dir), p, tie_breakers=ORDER_KEYS)
    )
    rates["keyed_write_rows_per_s"] = n_flows / t_keyed
    q["source_lookup"], _ = timed(lambda: source_lookup(spark, keyed, catalog.SRC_ADDR).collect())

    t_docs, docs = timed_write("docs", lambda p: write_documents(flows, p))
    rates["document_write_rows_per_s"] = n_flows / t_docs
    q["doc_term_lookup"], _ = timed(
        lambda: term_query(read_documents(spark, docs), "srcAddress", catalog.SRC_ADDR).collect()
    )

    packets = scratch_path(spark, "bench-packets")
    encode_v5(flows_view(spark, sf_dir, keep_keys=False)).select("payload").write.parquet(packets)
    q["v5_decode"], _ = timed(lambda: noop(decode(spark.read.parquet(packets))[0]))
    rates["v5_decode_records_per_s"] = n_flows / q["v5_decode"]

    caps = scratch_path(spark, "bench-captures")
    fl = flows_view(spark, sf_dir).withColumn("_day", F.floor(F.col("time_ms") / 86400000))
    write_capture_files(encode_v5(fl, packet_by=["l_orderkey", "_day"]), caps)

    def capture_decode():
        payloads, _ = read_capture(spark, caps)
        noop(decode(payloads.drop("ts_ms"))[0])

    q["capture_decode"], _ = timed(capture_decode)
    rates["capture_decode_records_per_s"] = n_flows / q["capture_decode"]

    # ``queries``) since locally it measures per-file cost of the file system.
    headline = ["top_pairs", "full_spec_query", "source_lookup", "v5_decode"]
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(q[k] for k in headline), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in q.items()},
        "rates": {k: round(v) for k, v in rates.items()},
        "headline": headline,
        "rows": n_flows,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "timing": "queries: median of 3 runs after a warm-up; writes: 1 run after a warm-up",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
