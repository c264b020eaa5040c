"""The ``flows`` view over the driver's ``lineitem`` table.

The driver's tables hold no network flows, so both Spark and the DuckDB oracle derive the
same flow rows from ``lineitem`` with the rule below (every lineitem row is one flow). The
four lineitem keys are carried along: together with the flow columns they give a total
order for "latest flow" tie-breaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbeam.session import use_utc

ORDER_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _host(key):
    return F.concat(
        F.lit("10.0."), (key % 5).cast("string"), F.lit("."), (key % 16).cast("string")
    )


def flows_from_lineitem(lineitem: DataFrame, keep_keys: bool = True) -> DataFrame:
    li = lineitem
    ship_ms = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    cols = [
        _host(li.l_orderkey).alias("src_addr"),
        _host(li.l_partkey).alias("dst_addr"),
        (F.lit(1024) + li.l_suppkey % 4).cast("int").alias("src_port"),
        F.when(li.l_linenumber % 4 == 0, 53)
        .when(li.l_linenumber % 4 == 1, 80)
        .when(li.l_linenumber % 4 == 2, 443)
        .otherwise(6667)
        .cast("int")
        .alias("dst_port"),
        (ship_ms + (li.l_orderkey * 37 % 86400) * 1000 + li.l_partkey % 1000).alias("time_ms"),
        (li.l_partkey % 1000).cast("long").alias("duration_ms"),
        F.when(li.l_linenumber % 5 == 0, 6)
        .when(li.l_linenumber % 5 == 1, 17)
        .when(li.l_linenumber % 5 == 2, 1)
        .when(li.l_linenumber % 5 == 3, 2)
        .otherwise(47)
        .cast("int")
        .alias("protocol"),
        (li.l_quantity.cast("long") * 64 + li.l_linenumber).alias("bytes"),
        li.l_quantity.cast("long").alias("packets"),
    ]
    if keep_keys:
        cols += [li[k] for k in ORDER_KEYS]
    return li.select(*cols)


def flows_view(spark: SparkSession, sf_dir: str, keep_keys: bool = True) -> DataFrame:
    """Flow rows derived from ``{sf_dir}/lineitem.parquet`` (session pinned to UTC)."""
    use_utc(spark)
    return flows_from_lineitem(read_table(spark, sf_dir, "lineitem"), keep_keys)


# The same rule for DuckDB (``string`` -> ``varchar``; ``epoch_ms`` of the ship timestamp).
FLOWS_SQL = """
select concat('10.0.', cast(l_orderkey % 5 as varchar), '.', cast(l_orderkey % 16 as varchar)) as src_addr,
       concat('10.0.', cast(l_partkey % 5 as varchar), '.', cast(l_partkey % 16 as varchar)) as dst_addr,
       cast(1024 + l_suppkey % 4 as integer) as src_port,
       cast(case l_linenumber % 4 when 0 then 53 when 1 then 80 when 2 then 443 else 6667 end as integer) as dst_port,
       epoch_ms(l_shipdate) + (l_orderkey * 37 % 86400) * 1000 + l_partkey % 1000 as time_ms,
       cast(l_partkey % 1000 as bigint) as duration_ms,
       cast(case l_linenumber % 5 when 0 then 6 when 1 then 17 when 2 then 1 when 3 then 2 else 47 end as integer) as protocol,
       cast(l_quantity as bigint) * 64 + l_linenumber as bytes,
       cast(l_quantity as bigint) as packets,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
from lineitem
"""


def with_flows(sql: str) -> str:
    """Prefix an oracle query with the ``flows`` CTE."""
    return f"with flows as ({FLOWS_SQL})\n{sql}"


# -- query specs derived from ``orders`` ------------------------------------------------------
# Every order becomes one spec: a week of flows from the customer's host, with a rule-driven
# mix of optional parameters and of the validation failures a submitter can make.


def specs_from_orders(orders: DataFrame) -> DataFrame:
    """(job_id, type, name, params) - one query spec per order."""
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    host = lambda x, y: F.concat(F.lit("10.0."), x.cast("string"), F.lit("."), y.cast("string"))
    none = F.lit(None).cast("string")
    dashed = F.date_format(d, "yyyy-MM-dd-HH:mm:ss")
    compact = F.date_format(d, "yyyyMMddHHmmss")
    week_later = F.date_format(d + F.expr("INTERVAL 7 DAYS"), "yyyy-MM-dd-HH:mm:ss")
    params = {
        "start": F.when(k % 6 == 1, compact)
        .when(k % 6 == 2, none)
        .when(k % 6 == 3, F.lit("yesterday"))
        .otherwise(dashed),
        "end": F.when(k % 17 == 0, none)
        .when(k % 13 == 0, F.lit("2017-13-01-00:00:00"))
        .otherwise(week_later),
        "src_addr": F.when(c % 9 == 0, none)
        .when(c % 9 == 1, F.lit(""))
        .when(c % 9 == 2, host(c % 5, c % 16 + 256))
        .otherwise(host(c % 5, c % 16)),
        "dst_addr": F.when((k + c) % 5 == 0, host(k % 5, k % 16))
        .when((k + c) % 5 == 1, F.lit("host.example"))
        .otherwise(none),
        "src_port": F.when(k % 8 == 0, (c % 4 + 1024).cast("string"))
        .when(k % 8 == 1, F.lit("http"))
        .otherwise(none),
        "dst_port": F.when(k % 10 == 3, F.lit("80")).otherwise(none),
        "prot": F.when(k % 9 == 0, F.lit("TCP"))
        .when(k % 9 == 1, F.lit("17"))
        .when(k % 9 == 2, F.lit("tcp"))
        .when(k % 9 == 3, F.lit("300"))
        .otherwise(none),
        "tos": F.when(k % 19 == 0, F.lit("0")).otherwise(none),
    }
    entries = [x for name, v in params.items() for x in (F.lit(name), v)]
    return orders.select(
        F.concat(F.lit("job-"), k.cast("string")).alias("job_id"),
        F.when(k % 7 == 0, "Test").when(k % 7 == 1, "Bogus").otherwise("FlowQuery").alias("type"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("name"),
        F.map_filter(F.create_map(*entries), lambda _k, v: v.isNotNull()).alias("params"),
    )


def specs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    return specs_from_orders(read_table(spark, sf_dir, "orders"))


# The same derivation for DuckDB, with the parameters as plain columns (NULL = absent).
SPECS_SQL = """
select 'job-' || cast(o_orderkey as varchar) as job_id,
       case o_orderkey % 7 when 0 then 'Test' when 1 then 'Bogus' else 'FlowQuery' end as type,
       case when o_orderkey % 11 = 0 then '' else o_orderpriority end as name,
       case o_orderkey % 6 when 1 then strftime(o_orderdate, '%Y%m%d%H%M%S') when 2 then null
            when 3 then 'yesterday' else strftime(o_orderdate, '%Y-%m-%d-%H:%M:%S') end as p_start,
       case when o_orderkey % 17 = 0 then null when o_orderkey % 13 = 0 then '2017-13-01-00:00:00'
            else strftime(o_orderdate + interval 7 day, '%Y-%m-%d-%H:%M:%S') end as p_end,
       case o_custkey % 9 when 0 then null when 1 then ''
            when 2 then '10.0.' || cast(o_custkey % 5 as varchar) || '.' || cast(o_custkey % 16 + 256 as varchar)
            else '10.0.' || cast(o_custkey % 5 as varchar) || '.' || cast(o_custkey % 16 as varchar) end as p_src,
       case (o_orderkey + o_custkey) % 5
            when 0 then '10.0.' || cast(o_orderkey % 5 as varchar) || '.' || cast(o_orderkey % 16 as varchar)
            when 1 then 'host.example' else null end as p_dst,
       case o_orderkey % 8 when 0 then cast(o_custkey % 4 + 1024 as varchar) when 1 then 'http' else null end as p_sport,
       case when o_orderkey % 10 = 3 then '80' else null end as p_dport,
       case o_orderkey % 9 when 0 then 'TCP' when 1 then '17' when 2 then 'tcp' when 3 then '300' else null end as p_prot,
       case when o_orderkey % 19 = 0 then '0' else null end as p_tos
from orders
"""

_IPV4_SQL = r"'^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$'"


def _time_sql(x: str) -> str:
    return (
        f"epoch_ms(case when regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$') "
        f"then try_strptime({x}, '%Y-%m-%d-%H:%M:%S') "
        f"when regexp_matches({x}, '^[0-9]{{14}}$') then try_strptime({x}, '%Y%m%d%H%M%S') end)"
    )


def _port_sql(x: str) -> str:
    n = f"(case when regexp_matches({x}, '^[0-9]{{1,5}}$') then cast({x} as integer) end)"
    return f"(case when {n} between 0 and 65535 then {n} end)"


def _prot_sql(x: str) -> str:
    n = f"(case when regexp_matches({x}, '^[0-9]{{1,3}}$') then cast({x} as integer) end)"
    u = f"upper(trim({x}))"
    return (
        f"(case when {n} between 0 and 255 then {n} when {u} = 'ICMP' then 1 when {u} = 'IGMP' then 2 "
        f"when {u} = 'TCP' then 6 when {u} = 'UDP' then 17 end)"
    )


SPEC_CHECK_SQL = f"""
select job_id, type, name,
  {_time_sql('p_start')} as start_ms, {_time_sql('p_end')} as end_ms,
  p_src as src_addr, p_dst as dst_addr, {_port_sql('p_sport')} as src_port,
  {_port_sql('p_dport')} as dst_port, {_prot_sql('p_prot')} as protocol,
  case when name is null or name = '' then 'missing_name'
       when type is null or type not in ('Test', 'FlowQuery') then 'unknown_type'
       when type <> 'FlowQuery' then null
       when p_start is null or p_start = '' then 'missing_start'
       when {_time_sql('p_start')} is null then 'bad_start'
       when p_end is null or p_end = '' then 'missing_end'
       when {_time_sql('p_end')} is null then 'bad_end'
       when p_src is null and p_dst is null then 'missing_address'
       when p_src = '' then 'empty_src'
       when p_src is not null and not regexp_matches(p_src, {_IPV4_SQL}) then 'bad_src'
       when p_dst = '' then 'empty_dst'
       when p_dst is not null and not regexp_matches(p_dst, {_IPV4_SQL}) then 'bad_dst'
       when p_sport is not null and {_port_sql('p_sport')} is null then 'bad_src_port'
       when p_dport is not null and {_port_sql('p_dport')} is null then 'bad_dst_port'
       when p_prot is not null and {_prot_sql('p_prot')} is null then 'bad_protocol'
       when p_tos is not null then 'unknown_param'
  end as validation_error
from ({SPECS_SQL}) s
"""
