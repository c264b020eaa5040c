"""Flow files along a space-filling curve: lookups by either address skip row groups."""

import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowbeam.operators import filters
from flowbeam.operators.curve import interleave
from flowbeam.schema import FLOW_COLUMNS
from flowbeam.sinks.flows import write_partitioned
from flowbeam.sources.flows import read_flows
from tests.test_docindex import rows_read


def woven(x, y):
    return sum((x >> k & 1) << 2 * k + 1 | (y >> k & 1) << 2 * k for k in range(32))


def test_interleaved_bits(spark):
    rng = random.Random(2)
    pairs = [(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(200)] + [(0, 0), (2**32 - 1, 2**32 - 1), (1, 0), (2**31, 1)]
    df = spark.createDataFrame(pairs, "x long, y long").select("x", "y", interleave(F.col("x"), F.col("y")).alias("z"))
    rows = df.collect()
    # unsigned order: the sign bit is turned over
    assert all(r.z + 2**63 == woven(r.x, r.y) for r in rows)
    assert [(r.x, r.y) for r in df.orderBy("z").collect()] == sorted(pairs, key=lambda p: woven(*p))


def one_day(spark, n=120_000):
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(256))
    return spark.range(n).select(
        F.format_string("10.0.%d.%d", h(1), h(2)).alias("src_addr"), F.format_string("10.1.%d.%d", h(3), h(4)).alias("dst_addr"),
        F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"), (F.lit(1491040800000) + F.col("id")).alias("time_ms"),
        F.lit(5).cast("long").alias("duration_ms"), F.lit(6).alias("protocol"), F.col("id").alias("bytes"), F.lit(1).cast("long").alias("packets"))


@pytest.mark.parametrize("by_curve", [True, False])
def test_lookups_by_either_address(spark, tmp_dir, by_curve):
    path = os.path.join(tmp_dir, "flows")
    write_partitioned(one_day(spark), path, by_curve=by_curve, row_group_bytes=60_000)
    groups = sum(pq.ParquetFile(os.path.join(d, n)).num_row_groups for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))
    assert groups >= 20 or not by_curve
    stored = read_flows(spark, path)
    shares = {}
    for column, lookup in (("src_addr", filters.by_source), ("dst_addr", filters.by_destination)):
        value = stored.select(column).limit(1).first()[0]
        found = lookup(stored, value)
        shares[column] = rows_read(found) / 120_000
        wanted = one_day(spark).filter(F.col(column) == value)
        assert sorted(map(tuple, found.select(*FLOW_COLUMNS).collect())) == sorted(map(tuple, wanted.collect()))
    if by_curve:
        assert max(shares.values()) < 0.2, shares
