"""Keyed flow table: one row per directed (src, dst) pair, later writes replace earlier ones.

Row key = 4 source-address bytes || 4 destination-address bytes; value cells are big-endian
(``srcPort``, ``dstPort``, ``dur`` 4 bytes; ``time``, ``bytes``, ``packs`` 8 bytes; ``prot``
1 byte). Rows lie in ``bucket=<hash of the source>/version=<name of the write>``.

A write adds: its batch, reduced to one row per pair, becomes a version of its own, and one entry
of the table's commit log makes it count. It costs what the batch costs, whatever the table's
size, and a batch that names itself (``token``) is taken once however often it is repeated. A
reader takes, per key, the row of the latest entry. ``compact_keyed`` merges all versions into
one, with as many buckets as its bytes ask for; ``drop_old_versions`` then removes what no reader
needs. ``upsert_keyed`` writes a new table elsewhere.

Plan: both the batch's reduction and the merge of versions are ``max(struct(...))`` aggregates
with a map-side partial step (a hot pair is combined before the shuffle); the write is rebalanced
by bucket (AQE splits a large bucket over several files) and sorted by source and key, so a
source lookup reads one bucket and skips row groups by Parquet statistics.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbeam.functions.binary import uint_to_be
from flowbeam.functions.ip import ip_to_bytes
from flowbeam.operators.toptalk import latest_per_pair
from flowbeam.schema import FLOW_COLUMNS, KEYED_SCHEMA, STORED_KEYED_SCHEMA, SchemaError, require_columns
from flowbeam.sinks import log

KEY_COLUMNS = ["src_addr", "dst_addr"]
# File layout: source-address text first (what lookups filter on), then the 8-byte key,
# which splits one busy source across files by destination.
LAYOUT_COLUMNS = ["src_addr", "key"]
# Buckets of a new table; compaction gives a large one more.
KEY_BUCKETS = 64
BUCKET_BYTES = 1 << 30


def encode_keyed(flows: DataFrame) -> DataFrame:
    """Flow rows -> keyed rows (key + big-endian cells), one per input row."""
    require_columns(flows, FLOW_COLUMNS, "flows")
    src, dst = ip_to_bytes(F.col("src_addr")), ip_to_bytes(F.col("dst_addr"))
    no_key = F.raise_error(F.lit("a flow without IPv4 source and destination has no key")).cast("binary")
    return flows.select(
        F.coalesce(F.concat(src, dst), no_key).alias("key"),
        F.col("src_addr"),
        src.alias("src"),
        dst.alias("dst"),
        uint_to_be(F.col("src_port"), 4).alias("srcPort"),
        uint_to_be(F.col("dst_port"), 4).alias("dstPort"),
        uint_to_be(F.col("time_ms"), 8).alias("time"),
        uint_to_be(F.col("duration_ms"), 4).alias("dur"),
        uint_to_be(F.col("protocol"), 1).alias("prot"),
        uint_to_be(F.col("bytes"), 8).alias("bytes"),
        uint_to_be(F.col("packets"), 8).alias("packs"),
    )


def merge_versions(
    new_flows: DataFrame, previous: DataFrame | None = None, tie_breakers: Sequence[str] = ()
) -> DataFrame:
    """Winner per directed pair: the latest new flow; previous rows survive only for new-less keys."""
    from flowbeam.sources.keyed import decode_keyed

    batch = latest_per_pair(new_flows, tie_breakers=tie_breakers).withColumn("_version", F.lit(1))
    if previous is None:
        return batch.drop("_version")
    old = decode_keyed(previous).withColumn("_version", F.lit(0))
    return _newest_version(batch.unionByName(old))


def _newest_version(both: DataFrame) -> DataFrame:
    """Per key, the row of the highest ``_version`` (partial aggregate before the shuffle)."""
    rest = [c for c in FLOW_COLUMNS if c not in KEY_COLUMNS]
    winner = F.max(F.struct(F.col("_version"), *[F.col(c) for c in rest])).alias("_w")
    return both.groupBy(*KEY_COLUMNS).agg(winner).select(
        *KEY_COLUMNS, *[F.col(f"_w.{c}").alias(c) for c in rest]
    )


def source_bucket(src_addr: Column, buckets: int = KEY_BUCKETS) -> Column:
    return F.pmod(F.crc32(src_addr.cast("binary")), F.lit(buckets)).cast("int")


def source_bucket_literal(src_addr: str, buckets: int = KEY_BUCKETS) -> int:
    return zlib.crc32(src_addr.encode()) % buckets


class _Versions:
    """The versions that count, in their order, from the entries of a table's commit log."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = log.CommitLog(spark, path)
        self.entries = self.log.entries()
        self.last = max(self.entries, default=0)
        merged = [n for n, e in self.entries.items() if "covers" in e]
        base = max(merged, default=None)
        covers = self.entries[base]["covers"] if base else 0
        #: version -> (place in the order, number of buckets); a merged one stands where it ends
        self.live = {e["version"]: (n, e["buckets"]) for n, e in self.entries.items() if n > covers and "covers" not in e}
        if base:
            self.live[self.entries[base]["version"]] = (covers, self.entries[base]["buckets"])

    def buckets(self) -> int:
        return max(self.live.values())[1] if self.live else KEY_BUCKETS

    def has(self, version: str) -> bool:
        return any(e["version"] == version for e in self.entries.values())


def _write(rows: DataFrame, path: str, version: str, buckets: int) -> None:
    (
        rows.withColumn("bucket", source_bucket(F.col("src_addr"), buckets))
        .withColumn("version", F.lit(version))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", *LAYOUT_COLUMNS)
        .write.mode("overwrite")
        # a version that broke off is replaced; no other is touched
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "version")
        .parquet(path)
    )


def upsert_keyed(
    flows: DataFrame, path: str, previous_path: str | None = None, tie_breakers: Sequence[str] = ()
) -> str:
    """Write a new keyed table at ``path``: ``previous_path`` (if any) updated by ``flows``."""
    spark = flows.sparkSession
    if log.exists(spark, path):
        raise ValueError(f"{path} exists")
    previous = read_keyed_raw(spark, previous_path) if previous_path else None
    _write(encode_keyed(merge_versions(flows, previous, tie_breakers)), path, "first", KEY_BUCKETS)
    log.CommitLog(spark, path).commit({"version": "first", "buckets": KEY_BUCKETS})
    return path


def update_keyed(flows: DataFrame, path: str, tie_breakers: Sequence[str] = (), token: str | None = None) -> bool:
    """Update the keyed table at ``path`` (created when absent) by ``flows``.

    The same flows written again change nothing but add a version; with a ``token`` (letters,
    digits, ``-_.``) a batch that is already in the table is left out, and False is returned.
    """
    spark = flows.sparkSession
    versions, version = _Versions(spark, path), token or f"v-{uuid.uuid4().hex[:16]}"
    if versions.has(version):
        return False
    buckets = versions.buckets()
    _write(encode_keyed(merge_versions(flows, None, tie_breakers)), path, version, buckets)
    versions.log.commit({"version": version, "buckets": buckets})
    return True


def compact_keyed(spark: SparkSession, path: str, bucket_bytes: int = BUCKET_BYTES) -> bool:
    """Merge all versions into one; False if another writer came in between (nothing is lost)."""
    versions = _Versions(spark, path)
    buckets = KEY_BUCKETS
    while buckets * bucket_bytes < log.size_of(spark, path):
        buckets *= 2
    version = f"merged-{uuid.uuid4().hex[:16]}"
    _write(read_keyed_raw(spark, path).drop("bucket"), path, version, buckets)
    entry = {"version": version, "buckets": buckets, "covers": versions.last}
    return versions.log.commit(entry, versions.last + 1) is not None


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Remove directories of versions that count no more; run it when no reader is under way."""
    versions, dropped = _Versions(spark, path), 0
    for bucket in log.names(spark, path):
        if bucket.startswith("bucket="):
            for name in log.names(spark, f"{path}/{bucket}"):
                version = name.removeprefix("version=")
                if versions.has(version) and version not in versions.live:
                    dropped += log.remove(spark, f"{path}/{bucket}/{name}")
    return dropped


def read_keyed_raw(spark: SparkSession, path: str, src_addr: str | None = None) -> DataFrame:
    """Newest keyed rows with their bucket; SchemaError when ``path`` is no keyed table.

    With ``src_addr`` only that source's rows, from its bucket of each version.
    """
    versions = _Versions(spark, path)
    if not versions.live:
        raise SchemaError(f"{path} is no keyed table: nothing is committed there")
    rows = spark.read.schema(STORED_KEYED_SCHEMA).parquet(path)
    if src_addr is None:
        rows = rows.filter(F.col("version").isin(sorted(versions.live)))
    else:
        wanted = F.lit(False)
        for buckets in {b for _, b in versions.live.values()}:
            these = sorted(v for v, (_, b) in versions.live.items() if b == buckets)
            wanted |= (F.col("bucket") == source_bucket_literal(src_addr, buckets)) & F.col("version").isin(these)
        rows = rows.filter(wanted).filter(F.col("src_addr") == F.lit(src_addr))
    columns = [*KEYED_SCHEMA.fieldNames(), "bucket"]
    if len(versions.live) == 1:
        return rows.select(*columns)
    order = F.create_map(*[F.lit(x) for v, (n, _) in versions.live.items() for x in (v, n)])
    rest = [c for c in columns if c != "key"]
    newest = F.max(F.struct(order[F.col("version")].alias("n"), *rest)).alias("w")
    return rows.groupBy("key").agg(newest).select("key", *[F.col(f"w.{c}").alias(c) for c in rest])
