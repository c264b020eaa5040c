"""Registered queries over the driver's tables, each paired with DuckDB oracle SQL.

Each query function takes ``(spark, sf_dir)`` and returns a DataFrame; names of computed
columns are the same as in the oracle SQL so results compare column by column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from flowbeam.functions.binary import be_uint
from flowbeam.functions.ip import bytes_to_ip, ip_to_bytes
from flowbeam.functions.once import computed_once
from flowbeam.functions.pairs import split_pair_key
from flowbeam.functions.protocol import resolve_protocol
from flowbeam.operators import aggregates, filters, project, spec, toptalk
from flowbeam.schema import FLOW_COLUMNS, FLOW_SCHEMA
from flowbeam.session import scratch_path
from flowbeam.sources.testviews import (
    ORDER_KEYS,
    SPEC_CHECK_SQL,
    SPECS_SQL,
    flows_view,
    specs_view,
    with_flows,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TOP_N = 10


def register(name: str, sql: str | None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return wrap


# -- A1, X10, T1, T2 -------------------------------------------------------------------------


@register(
    "top_pairs_by_bytes",
    with_flows(
        f"""
select least(src_addr, dst_addr) as addr_a, greatest(src_addr, dst_addr) as addr_b,
       cast(sum(bytes) as bigint) as bytes
from flows group by 1, 2
order by bytes desc, addr_a, addr_b limit {TOP_N}"""
    ),
)
def top_pairs_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toptalk.top_pairs(flows_view(spark, sf_dir), TOP_N)


@register(
    "pair_bytes_all",
    with_flows(
        """
select least(src_addr, dst_addr) as addr_a, greatest(src_addr, dst_addr) as addr_b,
       cast(sum(bytes) as bigint) as bytes
from flows group by 1, 2"""
    ),
)
def pair_bytes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toptalk.pair_bytes(flows_view(spark, sf_dir))


# -- W1, A2 ----------------------------------------------------------------------------------

_FLOW_COLS = "src_addr, dst_addr, src_port, dst_port, time_ms, duration_ms, protocol, bytes, packets"
_LATEST_ORDER = (
    "time_ms desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, "
    "src_port desc, dst_port desc, duration_ms desc, protocol desc, bytes desc, packets desc"
)
_LATEST_SQL = f"""
latest as (
  select {_FLOW_COLS} from (
    select *, row_number() over (partition by src_addr, dst_addr order by {_LATEST_ORDER}) as rn
    from flows) t
  where rn = 1)"""


@register("latest_per_pair", with_flows(f", {_LATEST_SQL}\nselect * from latest"))
def latest_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toptalk.latest_per_pair(flows_view(spark, sf_dir), tie_breakers=ORDER_KEYS)


@register(
    "top_pairs_latest",
    with_flows(
        f""", {_LATEST_SQL}
select least(src_addr, dst_addr) as addr_a, greatest(src_addr, dst_addr) as addr_b,
       cast(sum(bytes) as bigint) as bytes
from latest group by 1, 2
order by bytes desc, addr_a, addr_b limit {TOP_N}"""
    ),
)
def top_pairs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toptalk.top_pairs_latest(flows_view(spark, sf_dir), TOP_N, tie_breakers=ORDER_KEYS)


# -- F1..F7, P2, X7, X9, A3 ------------------------------------------------------------------

_DISPLAY_SQL = """src_addr as "srcAddress", dst_addr as "dstAddress", src_port as "srcPort",
  dst_port as "dstPort", strftime(epoch_ms(time_ms), '%Y-%m-%d-%H:%M:%S') as "time",
  duration_ms as "duration",
  case protocol when 1 then 'ICMP' when 2 then 'IGMP' when 6 then 'TCP' when 17 then 'UDP'
       else 'Unknown' end as "protocol",
  bytes as "bytes", packets as "packets"
"""

# Parameters of the registered single-spec queries (fixed inputs of the feature, not subsets).
RANGE_SPEC = {"start": "1996-03-01-00:00:00", "end": "1996-06-30-23:59:59"}
FULL_SPEC = {
    "start": "19960101000000",
    "end": "1997-12-31-23:59:59",
    "src_addr": "10.0.1.5",
    "dst_port": "80",
    "prot": "UDP",
}
COUNT_SPEC = {"start": "1995-06-01-00:00:00", "end": "1999-06-01-00:00:00", "dst_addr": "10.0.3.12"}
SRC_ADDR, DST_ADDR, SRC_PORT, DST_PORT, PROTOCOL = "10.0.1.5", "10.0.2.6", 1026, 443, "TCP"


def _ms(text: str) -> int:
    from flowbeam.functions.time import parse_time_literal

    return parse_time_literal(text)


@register(
    "flow_time_range",
    with_flows(
        f"select {_FLOW_COLS} from flows where time_ms between {_ms(RANGE_SPEC['start'])} "
        f"and {_ms(RANGE_SPEC['end'])}"
    ),
)
def flow_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spec.FlowSpec.from_params(RANGE_SPEC)
    return filters.in_time_range(flows_view(spark, sf_dir, keep_keys=False), s.start_ms, s.end_ms)


@register("flow_by_src", with_flows(f"select {_FLOW_COLS} from flows where src_addr = '{SRC_ADDR}'"))
def flow_by_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_source(flows_view(spark, sf_dir, keep_keys=False), SRC_ADDR)


@register("flow_by_dst", with_flows(f"select {_FLOW_COLS} from flows where dst_addr = '{DST_ADDR}'"))
def flow_by_dst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_destination(flows_view(spark, sf_dir, keep_keys=False), DST_ADDR)


@register("flow_by_src_port", with_flows(f"select {_FLOW_COLS} from flows where src_port = {SRC_PORT}"))
def flow_by_src_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_view(spark, sf_dir, keep_keys=False).filter(F.col("src_port") == SRC_PORT)


@register("flow_by_dst_port", with_flows(f"select {_FLOW_COLS} from flows where dst_port = {DST_PORT}"))
def flow_by_dst_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_view(spark, sf_dir, keep_keys=False).filter(F.col("dst_port") == DST_PORT)


@register(
    "flow_by_protocol",
    with_flows(f"select {_DISPLAY_SQL} from flows where protocol = {resolve_protocol(PROTOCOL)}"),
)
def flow_by_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = flows_view(spark, sf_dir, keep_keys=False)
    return project.to_display(flows.filter(F.col("protocol") == resolve_protocol(PROTOCOL)))


def _full_where() -> str:
    s = spec.FlowSpec.from_params(FULL_SPEC)
    return (
        f"time_ms between {s.start_ms} and {s.end_ms} and src_addr = '{s.src_addr}' "
        f"and dst_port = {s.dst_port} and protocol = {s.protocol}"
    )


@register("flow_query_full", with_flows(f"select {_DISPLAY_SQL} from flows where {_full_where()}"))
def flow_query_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spec.FlowSpec.from_params(FULL_SPEC)
    return project.to_display(filters.flow_query(flows_view(spark, sf_dir, keep_keys=False), s))


def _count_where() -> str:
    s = spec.FlowSpec.from_params(COUNT_SPEC)
    return f"time_ms between {s.start_ms} and {s.end_ms} and dst_addr = '{s.dst_addr}'"


@register("flow_query_count", with_flows(f"select count(*) as flows from flows where {_count_where()}"))
def flow_query_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spec.FlowSpec.from_params(COUNT_SPEC)
    return aggregates.row_count(filters.flow_query(flows_view(spark, sf_dir, keep_keys=False), s))


# -- X1, X2, X4 ------------------------------------------------------------------------------


def _ip_num_sql(col: str) -> str:
    parts = [f"cast(split_part({col}, '.', {i}) as bigint)" for i in range(1, 5)]
    return f"({parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]})"


def _ip_hex_sql(col: str) -> str:
    parts = ", ".join(f"cast(split_part({col}, '.', {i}) as integer)" for i in range(1, 5))
    return f"printf('%02X%02X%02X%02X', {parts})"


@register(
    "ip_round_trip",
    with_flows(
        f"""select src_addr, dst_addr, {_ip_hex_sql('src_addr')} as src_hex,
  {_ip_hex_sql('dst_addr')} as dst_hex, {_ip_num_sql('src_addr')} as src_num,
  {_ip_num_sql('dst_addr')} as dst_num, src_addr as src_back, dst_addr as dst_back from flows"""
    ),
)
def ip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = flows_view(spark, sf_dir, keep_keys=False)
    # columns of their own, which every output below reads
    flows = computed_once(flows.select("src_addr", "dst_addr"), sb=ip_to_bytes(F.col("src_addr")), db=ip_to_bytes(F.col("dst_addr")))
    sb, db = F.col("sb"), F.col("db")
    return flows.select(
        "src_addr",
        "dst_addr",
        F.hex(sb).alias("src_hex"),
        F.hex(db).alias("dst_hex"),
        be_uint(sb, 0, 4).alias("src_num"),
        be_uint(db, 0, 4).alias("dst_num"),
        bytes_to_ip(sb).alias("src_back"),
        bytes_to_ip(db).alias("dst_back"),
    )


# -- A5, X14 ---------------------------------------------------------------------------------


@register(
    "flows_per_day",
    with_flows(
        """select cast(year(epoch_ms(time_ms)) as integer) as year,
  cast(month(epoch_ms(time_ms)) as integer) as month, cast(day(epoch_ms(time_ms)) as integer) as day,
  count(*) as flows, cast(sum(bytes) as bigint) as bytes
from flows group by 1, 2, 3"""
    ),
)
def flows_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.flows_per_day(flows_view(spark, sf_dir, keep_keys=False))


# -- F12, X8, X15, X16 -----------------------------------------------------------------------


@register("spec_validation", SPEC_CHECK_SQL)
def spec_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec.parse_specs(spec.validate_specs(specs_view(spark, sf_dir))).drop("params")


# -- K1, S6, F1 (date-partitioned Parquet, pruned range read) -------------------------------


@register(
    "partitioned_range",
    with_flows(
        f"select {_FLOW_COLS} from flows where time_ms between {_ms(RANGE_SPEC['start'])} "
        f"and {_ms(RANGE_SPEC['end'])}"
    ),
)
def partitioned_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sinks.flows import write_partitioned
    from flowbeam.sources.flows import read_flows

    path = scratch_path(spark, "flows")
    write_partitioned(flows_view(spark, sf_dir, keep_keys=False), path)
    s = spec.FlowSpec.from_params(RANGE_SPEC)
    return filters.in_time_range(read_flows(spark, path), s.start_ms, s.end_ms).select(*FLOW_COLUMNS)


@register("stored_flow_query", ORACLE_SQL["flow_query_full"])
def stored_flow_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sinks.flows import write_partitioned
    from flowbeam.sources.flows import load_flows

    path = scratch_path(spark, "flows")
    write_partitioned(flows_view(spark, sf_dir, keep_keys=False), path)
    return project.to_display(filters.flow_query(load_flows(spark, path), spec.FlowSpec.from_params(FULL_SPEC)))


@register("stored_flow_by_dst", ORACLE_SQL["flow_by_dst"])
def stored_flow_by_dst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of one destination from a stored table along the curve of both addresses."""
    from flowbeam.sinks.flows import write_partitioned
    from flowbeam.sources.flows import read_flows

    path = scratch_path(spark, "flows")
    write_partitioned(flows_view(spark, sf_dir, keep_keys=False), path, by_curve=True)
    return filters.by_destination(read_flows(spark, path), DST_ADDR).select(*FLOW_COLUMNS)


# -- K2, S7, F10 (documents and a term lookup) -----------------------------------------------


@register("doc_term_lookup", with_flows(f"select {_DISPLAY_SQL} from flows where src_addr = '{SRC_ADDR}'"))
def doc_term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sinks.flows import write_documents
    from flowbeam.sources.documents import read_documents, term_query

    path = scratch_path(spark, "docs")
    write_documents(flows_view(spark, sf_dir, keep_keys=False), path)
    return term_query(read_documents(spark, path), "srcAddress", SRC_ADDR)


@register("indexed_doc_lookup", with_flows(f"select {_DISPLAY_SQL} from flows where dst_addr = '{DST_ADDR}'"))
def indexed_doc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two parts, indexed after each, and a lookup of a destination through the index."""
    from flowbeam.sinks.docindex import index_documents, indexed_term_query
    from flowbeam.sinks.flows import write_documents

    path, flows = scratch_path(spark, "docs"), flows_view(spark, sf_dir, keep_keys=False)
    for part in (0, 1):
        write_documents(flows.filter(F.col("src_port") % 2 == part), path)
        index_documents(spark, path)
    return indexed_term_query(spark, path, "dstAddress", DST_ADDR)


# -- P3, S7 (documents as text, rejects of unreadable ones) ----------------------------------


@register(
    "document_rejects",
    with_flows(
        """select case bytes % 7 when 0 then 'unreadable' when 1 then 'unreadable'
         when 2 then 'missing_field' else 'ok' end as outcome,
       count(*) as documents,
       cast(sum(case when bytes % 7 > 2 then bytes else 0 end) as bigint) as bytes
from flows group by 1"""
    ),
)
def document_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sources.documents import split_documents

    texts = project.to_document(project.to_display(flows_view(spark, sf_dir, keep_keys=False)), "bytes")
    rule = F.col("bytes") % 7
    damaged = (
        F.when(rule == 0, F.substring("value", 1, 20))
        .when(rule == 1, F.regexp_replace("value", '"bytes":[0-9]+', '"bytes":"many"'))
        .when(rule == 2, F.regexp_replace("value", '"time":"[^"]*",', ""))
        .otherwise(F.col("value"))
    )
    path = scratch_path(spark, "doc-text")
    texts.select(damaged.alias("value")).write.text(path)
    docs, rejects = split_documents(spark, path)
    judged = docs.select(F.lit("ok").alias("outcome"), "bytes").unionByName(
        rejects.select(F.col("reject_reason").alias("outcome"), F.lit(0).cast("long").alias("bytes"))
    )
    return judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"))


# -- K3, S8, F8 (keyed last-write-wins table, source lookup) ---------------------------------


@register(
    "keyed_src_lookup",
    with_flows(f", {_LATEST_SQL}\nselect * from latest where src_addr = '{SRC_ADDR}'"),
)
def keyed_src_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sinks.keyed import upsert_keyed
    from flowbeam.sources.keyed import source_lookup

    path = upsert_keyed(flows_view(spark, sf_dir), scratch_path(spark, "keyed"), tie_breakers=ORDER_KEYS)
    return source_lookup(spark, path, SRC_ADDR)


# Two writes to the keyed table: flows from 1998 on first, then the older flows (a backfill).
# A later write replaces the cells of the same pair even when its flow is older.
BACKFILL_SPLIT_MS = 883612800000  # 1998-01-01T00:00:00Z
_BACKFILL_ORDER = f"(time_ms < {BACKFILL_SPLIT_MS}) desc, " + _LATEST_ORDER


@register(
    "keyed_upsert_backfill",
    with_flows(
        f"""select {_FLOW_COLS} from (
  select *, row_number() over (partition by src_addr, dst_addr order by {_BACKFILL_ORDER}) as rn
  from flows) t where rn = 1"""
    ),
)
def keyed_upsert_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sinks.keyed import upsert_keyed
    from flowbeam.sources.keyed import read_keyed

    flows = flows_view(spark, sf_dir)
    first = flows.filter(F.col("time_ms") >= BACKFILL_SPLIT_MS)
    later = flows.filter(F.col("time_ms") < BACKFILL_SPLIT_MS)
    v1 = upsert_keyed(first, scratch_path(spark, "keyed-v1"), tie_breakers=ORDER_KEYS)
    v2 = upsert_keyed(later, scratch_path(spark, "keyed-v2"), previous_path=v1, tie_breakers=ORDER_KEYS)
    return read_keyed(spark, v2)


@register("keyed_ingest_twice", ORACLE_SQL["keyed_upsert_backfill"])
def keyed_ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sinks.keyed import update_keyed
    from flowbeam.sources.keyed import read_keyed

    flows, path = flows_view(spark, sf_dir), scratch_path(spark, "keyed-table")
    update_keyed(flows.filter(F.col("time_ms") >= BACKFILL_SPLIT_MS), path, tie_breakers=ORDER_KEYS)
    update_keyed(flows.filter(F.col("time_ms") < BACKFILL_SPLIT_MS), path, tie_breakers=ORDER_KEYS)
    return read_keyed(spark, path)


@register("keyed_compacted", ORACLE_SQL["keyed_upsert_backfill"])
def keyed_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named batches, the first offered again, merged into one version; then the second again."""
    from flowbeam.sinks.keyed import compact_keyed, drop_old_versions, update_keyed
    from flowbeam.sources.keyed import read_keyed

    flows, path = flows_view(spark, sf_dir), scratch_path(spark, "keyed-table")
    first, later = (flows.filter(F.col("time_ms") >= BACKFILL_SPLIT_MS), "new"), (flows.filter(F.col("time_ms") < BACKFILL_SPLIT_MS), "old")
    for batch, token in (first, later, first):
        update_keyed(batch, path, tie_breakers=ORDER_KEYS, token=token)
    compact_keyed(spark, path)
    drop_old_versions(spark, path)
    update_keyed(later[0], path, tie_breakers=ORDER_KEYS, token=later[1])
    return read_keyed(spark, path)


# -- K5, K6, S9, T3, A4 (stored result sets) -------------------------------------------------

PAGE_OFFSET, PAGE_LIMIT = 10, 25
_PAGE_ORDER_SQL = '"time", "srcAddress", "dstAddress", "srcPort", "dstPort", "protocol", "duration", "bytes", "packets"'


def _store_count_job(spark: SparkSession, sf_dir: str) -> str:
    from flowbeam.sinks.results import drop_results, write_results

    root = scratch_path(spark, "results")
    s = spec.FlowSpec.from_params(COUNT_SPEC)
    rows = project.to_display(filters.flow_query(flows_view(spark, sf_dir, keep_keys=False), s))
    write_results(rows, root, "job-count")
    # A second job written, dropped and written again without rows: the first rows must not survive.
    everything = project.to_display(flows_view(spark, sf_dir, keep_keys=False))
    write_results(everything, root, "job-empty")
    drop_results(spark, root, "job-empty")
    write_results(everything.filter(F.lit(False)), root, "job-empty")
    return root


@register(
    "result_page",
    with_flows(
        f"select {_DISPLAY_SQL} from flows where {_count_where()} "
        f"order by {_PAGE_ORDER_SQL} limit {PAGE_LIMIT} offset {PAGE_OFFSET}"
    ),
)
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sinks.results import results_page

    root = _store_count_job(spark, sf_dir)
    return results_page(spark, root, "job-count", PAGE_OFFSET, PAGE_LIMIT)


@register("result_rewrite", ORACLE_SQL["result_page"])
def result_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result whose rewrite fails half-way is still there."""
    from pyspark.errors import PySparkException

    from flowbeam.sinks.results import results_page, write_results

    root = _store_count_job(spark, sf_dir)
    rows = project.to_display(flows_view(spark, sf_dir, keep_keys=False))
    broken = F.when(F.col("bytes") > 0, F.raise_error(F.lit("broken off")).cast("long")).otherwise(F.col("bytes"))
    try:
        write_results(rows.withColumn("bytes", broken), root, "job-count")
    except PySparkException:
        pass
    return results_page(spark, root, "job-count", PAGE_OFFSET, PAGE_LIMIT)


_JSON_SQL = ", ".join(
    f"'{c}', \"{c}\"" for c in ("srcAddress", "dstAddress", "srcPort", "dstPort", "time", "duration", "protocol", "bytes", "packets")
)


@register(
    "page_json",
    with_flows(
        f"select cast(json_object({_JSON_SQL}) as varchar) as value from (select {_DISPLAY_SQL} from flows "
        f"where {_count_where()} order by {_PAGE_ORDER_SQL} limit {PAGE_LIMIT} offset {PAGE_OFFSET})"
    ),
)
def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sinks.results import page_as_json, results_page

    root = _store_count_job(spark, sf_dir)
    return page_as_json(results_page(spark, root, "job-count", PAGE_OFFSET, PAGE_LIMIT))


@register(
    "result_count",
    with_flows(
        f"select 'job-count' as job_id, count(*) as \"rows\" from flows where {_count_where()} "
        "union all select 'job-empty' as job_id, 0 as \"rows\""
    ),
)
def result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sinks.results import result_count as count_job

    root = _store_count_job(spark, sf_dir)
    return count_job(spark, root, "job-count").select(F.lit("job-count").alias("job_id"), "rows").unionByName(
        count_job(spark, root, "job-empty").select(F.lit("job-empty").alias("job_id"), "rows")
    )


# -- S3, S4, S5, P1, X3..X6 (v5 decode) ------------------------------------------------------


@register("v5_round_trip", with_flows(f"select {_FLOW_COLS} from flows"))
def v5_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.operators.decode import decode
    from flowbeam.operators.encode import encode_v5

    packets = encode_v5(flows_view(spark, sf_dir, keep_keys=False))
    flows, _ = decode(packets.select("payload"), "v5")
    return flows


# One packet per (order, day); every order's packets are damaged by a rule on the order key.
def _damage(p: Column, k: Column) -> Column:
    r = k % 11
    tail = lambda start: F.substring(p, start, F.lit(1 << 20))
    return (
        F.when(r == 0, F.expr("substring(payload, 1, length(payload) - 1)"))
        .when(r == 1, F.concat(F.unhex(F.lit("0009")), tail(3)))
        .when(r == 2, F.concat(F.substring(p, 1, 2), F.unhex(F.lit("0000")), tail(5)))
        .when(r == 3, F.concat(F.substring(p, 1, 2), F.unhex(F.lit("001F")), tail(5)))
        .when(r == 4, F.concat(F.substring(p, 1, 12), F.unhex(F.lit("3B9ACA00")), tail(17)))
        .when(r == 5, F.concat(p, F.unhex(F.lit("00" * 10))))
        .when(r == 6, F.substring(p, 1, 3))
        .when(r == 7, F.substring(p, 1, 1))
        .otherwise(p)
    )


@register(
    "v5_reject_counts",
    with_flows(
        """, pk as (select l_orderkey, time_ms // 86400000 as d, count(*) as n from flows group by 1, 2),
o as (select case l_orderkey % 11 when 0 then 'underflow' when 1 then 'bad_version'
        when 2 then 'bad_count' when 3 then 'bad_count' when 4 then 'bad_nanoseconds'
        when 6 then 'underflow' when 7 then 'underflow' else 'ok' end as outcome, n from pk)
select outcome, count(*) as packets,
       cast(sum(case when outcome = 'ok' then n else 0 end) as bigint) as records
from o group by 1"""
    ),
)
def v5_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.operators.decode import classify_v5, explode_v5
    from flowbeam.operators.encode import encode_v5

    flows = flows_view(spark, sf_dir).withColumn("_day", F.floor(F.col("time_ms") / 86400000))
    packets = encode_v5(flows, packet_by=["l_orderkey", "_day"])
    damaged = computed_once(packets.select("l_orderkey", "payload"), payload=_damage(F.col("payload"), F.col("l_orderkey")))
    classified = classify_v5(damaged)
    outcome = F.coalesce(F.col("reject_reason"), F.lit("ok")).alias("outcome")
    per_packet = classified.groupBy(outcome).agg(F.count(F.lit(1)).alias("packets"))
    records = explode_v5(classified, []).agg(F.count(F.lit(1)).alias("records"))
    return per_packet.join(records.withColumn("outcome", F.lit("ok")), "outcome", "left").select(
        "outcome", "packets", F.coalesce(F.col("records"), F.lit(0)).cast("long").alias("records")
    )


# -- S1, S2, K8, R1 (capture files, batch and streaming ingest) ------------------------------

# Capture files are built from the flows: one v5 packet per (order, day). Packets of flows
# that started on a Sunday (UTC) were exported over TCP and must be rejected as not UDP, so
# the expected flows are those of the other six weekdays (DuckDB: Sunday = 0).
_CAPTURE_SQL = with_flows(f"select {_FLOW_COLS} from flows where dayofweek(epoch_ms(time_ms)) <> 0")


def _capture_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One v5 packet (or more, over 30 flows) per (order, day); those of a Sunday travel by TCP."""
    from flowbeam.operators.encode import encode_v5

    flows = flows_view(spark, sf_dir).withColumn("_day", F.floor(F.col("time_ms") / 86400000))
    sunday = F.dayofweek(F.date_from_unix_date(F.col("_day").cast("int"))) == 1  # Spark: Sunday = 1
    return encode_v5(flows, packet_by=["l_orderkey", "_day"]).withColumn(
        "transport", F.when(sunday, "tcp").otherwise("udp")
    )


def _write_captures(spark: SparkSession, sf_dir: str, parts: int = 1) -> list[str]:
    """Landing folders of capture files; with ``parts`` the orders are dealt over several."""
    from flowbeam.sinks.capture import write_capture_files

    packets, landings = _capture_packets(spark, sf_dir), []
    for part in range(parts):
        landings.append(scratch_path(spark, "captures"))
        write_capture_files(packets.filter(F.col("l_orderkey") % parts == part), landings[-1])
    return landings


@register("capture_ingest", _CAPTURE_SQL)
def capture_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.plans.ingest import ingest_captures
    from flowbeam.sources.flows import read_flows

    landing, = _write_captures(spark, sf_dir)
    flows_path, rejects_path = scratch_path(spark, "ingest-flows"), scratch_path(spark, "ingest-rejects")
    ingest_captures(spark, landing, flows_path, rejects_path)
    return read_flows(spark, flows_path).select(*FLOW_COLUMNS)


@register(
    "capture_rejects",
    with_flows(
        """select 'not_udp' as reject_reason, count(*) as packets from (
  select distinct l_orderkey, time_ms // 86400000 as d from flows where dayofweek(epoch_ms(time_ms)) = 0)"""
    ),
)
def capture_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.plans.ingest import ingest_captures

    landing, = _write_captures(spark, sf_dir)
    flows_path, rejects_path = scratch_path(spark, "ingest-flows"), scratch_path(spark, "ingest-rejects")
    ingest_captures(spark, landing, flows_path, rejects_path)
    return spark.read.parquet(rejects_path).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("packets"))


@register("capture_ranges", _CAPTURE_SQL)
def capture_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large capture files, each read by many tasks in ranges of 64 KB."""
    from flowbeam.plans.ingest import decode_frames
    from flowbeam.sinks.capture import write_capture_files
    from flowbeam.sources.capture import frames_from_files, scan_files

    landing = scratch_path(spark, "large-captures")
    write_capture_files(_capture_packets(spark, sf_dir), landing, frames_per_file=1 << 30)
    flows, _ = decode_frames(frames_from_files(scan_files(spark, landing), range_bytes=1 << 16))
    return flows.select(*FLOW_COLUMNS)


_SPOILT = {0: "udp", 1: "tcp", 2: "ipv6", 3: "ip_header", 4: "fragment", 5: "cut"}


@register(
    "frame_rejects",
    with_flows(
        """, pk as (select l_orderkey % 7 as r, count(*) as n from (
  select distinct l_orderkey, time_ms // 86400000 as d from flows) group by 1)
select case r when 0 then 'ok' when 1 then 'not_udp' when 2 then 'not_ipv4' when 3 then 'bad_ip_header'
         when 4 then 'fragment' when 5 then 'truncated_frame' else 'unsupported_link' end as outcome,
       n as frames from pk"""
    ),
)
def frame_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames spoilt by the order's key in each way that the reader tells apart."""
    from flowbeam.sinks.capture import write_capture_files
    from flowbeam.sources.capture import frames_from_files, scan_files

    packets, rule, landing = _capture_packets(spark, sf_dir), F.col("l_orderkey") % 7, scratch_path(spark, "spoilt-captures")
    spoilt = F.element_at(F.create_map(*[F.lit(x) for pair in _SPOILT.items() for x in pair]), rule.cast("int"))
    write_capture_files(packets.filter(rule < 6).withColumn("transport", spoilt), f"{landing}/ethernet")
    write_capture_files(packets.filter(rule == 6).withColumn("transport", F.lit("udp")), f"{landing}/other", link_type=105)
    frames = frames_from_files(scan_files(spark, landing))
    return frames.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("frames"))


_CAPTURE_DISPLAY_SQL = with_flows(f"select {_DISPLAY_SQL} from flows where dayofweek(epoch_ms(time_ms)) <> 0")


@register("drop_folder_ingest", _CAPTURE_DISPLAY_SQL)
def drop_folder_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder, ingested; its files replaced by the next ones, ingested; and once more as it is."""
    from flowbeam.plans.ingest import ingest_captures
    from flowbeam.sinks.capture import write_capture_files
    from flowbeam.sources.documents import read_documents

    packets, landing = _capture_packets(spark, sf_dir), scratch_path(spark, "drop-folder")
    docs, rejects_path = scratch_path(spark, "drop-docs"), scratch_path(spark, "drop-rejects")
    for part in (0, 1):
        write_capture_files(packets.filter(F.col("l_orderkey") % 2 == part), landing)
        ingest_captures(spark, landing, docs, rejects_path, "documents")
    ingest_captures(spark, landing, docs, rejects_path, "documents")
    return read_documents(spark, docs)


@register(
    "stream_sinks",
    with_flows(
        """, f as (select * from flows where dayofweek(epoch_ms(time_ms)) <> 0)
select 'documents' as mode, count(*) as stored from f
union all select 'keyed', count(distinct (src_addr, dst_addr)) from f"""
    ),
)
def stream_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files streamed into documents and into a keyed table, each stream run twice."""
    from flowbeam.sources.documents import read_documents
    from flowbeam.sources.keyed import read_keyed

    landing, = _write_captures(spark, sf_dir)
    out = None
    for mode, read in (("documents", read_documents), ("keyed", read_keyed)):
        table, rejects_path = scratch_path(spark, f"stream-{mode}"), scratch_path(spark, "stream-rejects")
        for _ in range(2):
            _stream(spark, landing, table, rejects_path, mode)
        row = read(spark, table).agg(F.count(F.lit(1)).alias("stored")).select(F.lit(mode).alias("mode"), "stored")
        out = row if out is None else out.unionByName(row)
    return out


@register("compacted_flows", _CAPTURE_SQL)
def compacted_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of a flow table, rewritten as one that replaces them."""
    from flowbeam.plans.ingest import ingest_captures
    from flowbeam.sinks.flows import compact_flows, drop_replaced_batches
    from flowbeam.sources.flows import read_flows

    flows_path, rejects_path = scratch_path(spark, "compact-flows"), scratch_path(spark, "compact-rejects")
    for landing in _write_captures(spark, sf_dir, parts=2):
        ingest_captures(spark, landing, flows_path, rejects_path)
    compact_flows(spark, flows_path)
    drop_replaced_batches(spark, flows_path)
    return read_flows(spark, flows_path).select(*FLOW_COLUMNS)


def _stream(spark: SparkSession, landing: str, flows_path: str, rejects_path: str, mode: str = "parquet") -> None:
    from flowbeam.streaming.ingest import start_capture_ingest

    query = start_capture_ingest(spark, landing, flows_path, rejects_path, mode=mode)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@register("stream_restart_ingest", _CAPTURE_SQL)
def stream_restart_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders streamed into one table, the first one once more; no checkpoint is named."""
    from flowbeam.sources.flows import read_flows

    one, two = _write_captures(spark, sf_dir, parts=2)
    flows_path, rejects_path = scratch_path(spark, "stream-flows"), scratch_path(spark, "stream-rejects")
    for landing in (one, two, one):
        _stream(spark, landing, flows_path, rejects_path)
    return read_flows(spark, flows_path).select(*FLOW_COLUMNS)


@register("mixed_ingest", _CAPTURE_SQL)
def mixed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder by stream and one by batch (twice) into one table."""
    from flowbeam.plans.ingest import ingest_captures
    from flowbeam.sources.flows import read_flows

    one, two = _write_captures(spark, sf_dir, parts=2)
    flows_path, rejects_path = scratch_path(spark, "mixed-flows"), scratch_path(spark, "mixed-rejects")
    _stream(spark, one, flows_path, rejects_path)
    for _ in range(2):
        ingest_captures(spark, two, flows_path, rejects_path)
    return read_flows(spark, flows_path).select(*FLOW_COLUMNS)


@register("stream_ingest", _CAPTURE_SQL)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sources.flows import read_flows
    from flowbeam.streaming.ingest import start_capture_ingest

    landing, = _write_captures(spark, sf_dir)
    flows_path, rejects_path = scratch_path(spark, "stream-flows"), scratch_path(spark, "stream-rejects")
    query = start_capture_ingest(spark, landing, flows_path, rejects_path)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return read_flows(spark, flows_path).select(*FLOW_COLUMNS)


# -- K10, S10, T4 (stored specs, lookup by id) -----------------------------------------------


@register(
    "spec_lookup",
    f"""with s as ({SPECS_SQL})
select job_id, type, name, p_end as "end", false as refused from s where job_id = (select min(job_id) from s)
union all select 'new-job', 'FlowQuery', 'count', '{COUNT_SPEC["end"]}', true""",
)
def spec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived spec stored, one inserted twice (the second time refused), two looked up."""
    from flowbeam.sinks.specs import append_specs, find_spec, insert_spec, read_specs

    path = scratch_path(spark, "specs")
    append_specs(specs_view(spark, sf_dir), path)
    insert_spec(spark, path, "new-job", spec.FLOW_QUERY, "count", COUNT_SPEC)
    try:
        insert_spec(spark, path, "new-job", spec.FLOW_QUERY, "count", COUNT_SPEC)
        refused = False
    except ValueError:
        refused = True
    first = read_specs(spark, path).agg(F.min("job_id")).first()[0]
    found = [(find_spec(spark, path, first), False), (find_spec(spark, path, "new-job"), refused)]
    rows = [(s["job_id"], s["type"], s["name"], s["params"].get("end"), r) for s, r in found]
    return spark.createDataFrame(rows, "job_id string, type string, name string, end string, refused boolean")


@register(
    "spec_ids",
    f"""with s as ({SPECS_SQL})
select job_id, name, p_end as "end" from s""",
)
def spec_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived spec in two batches; batches with a taken or a doubled id are refused whole."""
    from flowbeam.sinks.specs import append_specs, read_specs

    specs, path = specs_view(spark, sf_dir), scratch_path(spark, "specs")
    half = F.pmod(F.xxhash64("job_id"), F.lit(2)) == 0
    append_specs(specs.filter(half), path)
    for refused in (specs, specs.filter(~half).unionAll(specs.filter(~half))):
        try:
            append_specs(refused, path)
        except ValueError:
            continue
        raise RuntimeError("a batch with a taken id was added")
    append_specs(specs.filter(~half), path)
    return read_specs(spark, path).select("job_id", "name", F.col("params")["end"].alias("end"))


# -- P3, P4, X17 (documents as text and back) ------------------------------------------------


@register("document_text", with_flows(f"select {_DISPLAY_SQL} from flows"))
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sources.documents import read_document_text

    path = scratch_path(spark, "doc-text")
    project.to_document(project.to_display(flows_view(spark, sf_dir, keep_keys=False))).write.text(path)
    return read_document_text(spark, path)


# -- X11 (pair keys as text) -----------------------------------------------------------------


@register(
    "pair_key_totals",
    with_flows(
        "select src_addr as addr_a, dst_addr as addr_b, cast(sum(bytes) as bigint) as bytes from flows group by 1, 2"
    ),
)
def pair_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(",", "src_addr", "dst_addr").alias("pair")
    totals = flows_view(spark, sf_dir, keep_keys=False).groupBy(key).agg(F.sum("bytes").alias("bytes"))
    return totals.select(*split_pair_key(F.col("pair")), "bytes")


# -- K8, K9 (sink by mode, counts) -----------------------------------------------------------


@register(
    "sink_modes",
    with_flows(
        """, n as (select count(*) as n, count(distinct (src_addr, dst_addr)) as pairs from flows)
select 'parquet' as mode, n as written, n as stored from n
union all select 'elastic', n, n from n union all select 'hbase', n, pairs from n"""
    ),
)
def sink_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sinks.flows import write_flows
    from flowbeam.sources.documents import read_documents
    from flowbeam.sources.flows import read_flows
    from flowbeam.sources.keyed import read_keyed

    flows, out = flows_view(spark, sf_dir, keep_keys=False), None
    for mode, read in (("parquet", read_flows), ("elastic", read_documents), ("hbase", read_keyed)):
        path = scratch_path(spark, f"sink-{mode}")
        written = int(write_flows(flows, path, mode).get["rows"])
        row = read(spark, path).agg(F.count(F.lit(1)).alias("stored"))
        row = row.select(F.lit(mode).alias("mode"), F.lit(written).cast("long").alias("written"), "stored")
        out = row if out is None else out.unionByName(row)
    return out


# -- U1, F13, U2 (other packet formats, other flow sources) ----------------------------------


def _decode_text(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One flow per packet, its fields as text between commas."""
    parts = payloads.select(F.split(F.col("payload").cast("string"), ",").alias("p"))
    whole = F.size("p") == len(FLOW_COLUMNS)
    fields = [F.col("p")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(FLOW_SCHEMA.fields)]
    return parts.filter(whole).select(*fields), parts.filter(~whole).select(F.lit("bad_field_count").alias("reject_reason"))


@register(
    "custom_decoder",
    with_flows(
        """select case when packets % 5 = 0 then 'bad_field_count' else 'ok' end as outcome, count(*) as flows,
       cast(sum(case when packets % 5 = 0 then 0 else bytes + time_ms % 1000 + src_port + protocol end) as bigint) as total
from flows group by 1"""
    ),
)
def custom_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.operators.decode import decode, register_decoder

    register_decoder("text", _decode_text)
    fields = [F.col(c).cast("string") for c in FLOW_COLUMNS]
    text = F.when(F.col("packets") % 5 == 0, F.concat_ws(",", *fields[:-1])).otherwise(F.concat_ws(",", *fields))
    flows, rejects = decode(flows_view(spark, sf_dir, keep_keys=False).select(text.cast("binary").alias("payload")), "text")
    total = F.col("bytes") + F.col("time_ms") % 1000 + F.col("src_port") + F.col("protocol")
    judged = flows.select(F.lit("ok").alias("outcome"), total.alias("total")).unionByName(
        rejects.select(F.col("reject_reason").alias("outcome"), F.lit(0).cast("long").alias("total"))
    )
    return judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("flows"), F.sum("total").alias("total"))


@register("custom_loader", with_flows(f"select {_FLOW_COLS} from flows"))
def custom_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.sources.flows import load_flows, register_loader

    register_loader("json", lambda session, path: session.read.schema(FLOW_SCHEMA).json(path))
    path = scratch_path(spark, "flows-json")
    flows_view(spark, sf_dir, keep_keys=False).write.json(path)
    return load_flows(spark, path, "json")


# -- J1 (many specs in one pass) -------------------------------------------------------------


@register(
    "multi_spec_query",
    with_flows(
        f""", specs as (select * from ({SPEC_CHECK_SQL}) v where validation_error is null and type = 'FlowQuery')
select s.job_id, f.src_addr, f.dst_addr, f.src_port, f.dst_port, f.time_ms, f.duration_ms, f.protocol,
       f.bytes, f.packets
from flows f join specs s
  on f.time_ms between s.start_ms and s.end_ms
 and (s.src_addr is null or f.src_addr = s.src_addr)
 and (s.dst_addr is null or f.dst_addr = s.dst_addr)
 and (s.src_port is null or f.src_port = s.src_port)
 and (s.dst_port is null or f.dst_port = s.dst_port)
 and (s.protocol is null or f.protocol = s.protocol)"""
    ),
)
def multi_spec_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.operators.multispec import multi_spec_query as run

    specs = spec.parse_specs(spec.validate_specs(specs_view(spark, sf_dir)))
    valid = F.col("validation_error").isNull() & (F.col("type") == spec.FLOW_QUERY)
    return run(flows_view(spark, sf_dir, keep_keys=False), specs, valid=valid)


@register("multi_spec_shuffled", ORACLE_SQL["multi_spec_query"])
def multi_spec_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same specs as if they were too many to broadcast."""
    from flowbeam.operators.multispec import multi_spec_query as run

    specs = spec.parse_specs(spec.validate_specs(specs_view(spark, sf_dir)))
    valid = F.col("validation_error").isNull() & (F.col("type") == spec.FLOW_QUERY)
    return run(flows_view(spark, sf_dir, keep_keys=False), specs, broadcast_bytes=0, valid=valid)


# The same specs without an end, over the stored table.
OPEN_END_MS = 253402300799000  # 9999-12-31T23:59:59Z


@register("multi_spec_open_range", ORACLE_SQL["multi_spec_query"].replace("s.end_ms", str(OPEN_END_MS)))
def multi_spec_open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowbeam.operators.multispec import multi_spec_query as run
    from flowbeam.sinks.flows import write_partitioned
    from flowbeam.sources.flows import read_flows

    path = scratch_path(spark, "flows")
    write_partitioned(flows_view(spark, sf_dir, keep_keys=False), path)
    specs = spec.parse_specs(spec.validate_specs(specs_view(spark, sf_dir)))
    valid = F.col("validation_error").isNull() & (F.col("type") == spec.FLOW_QUERY)
    return run(read_flows(spark, path), specs.withColumn("end_ms", F.lit(OPEN_END_MS)), valid=valid)
