"""Keyed flow table scans: decode the 8-byte key and the big-endian cells; source lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbeam.functions.binary import be_int32, be_int64, be_uint
from flowbeam.functions.ip import bytes_to_ip, ip_literal_bytes
from flowbeam.sinks.keyed import read_keyed_raw


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """Keyed rows at ``path`` decoded to flow rows."""
    return decode_keyed(read_keyed_raw(spark, path))


def decode_keyed(rows: DataFrame) -> DataFrame:
    key = F.col("key")
    return rows.select(
        bytes_to_ip(F.substring(key, 1, 4)).alias("src_addr"),
        bytes_to_ip(F.substring(key, 5, 4)).alias("dst_addr"),
        be_int32(F.col("srcPort")).cast("int").alias("src_port"),
        be_int32(F.col("dstPort")).cast("int").alias("dst_port"),
        be_int64(F.col("time")).alias("time_ms"),
        be_int32(F.col("dur")).alias("duration_ms"),
        be_uint(F.col("prot"), 0, 1).cast("int").alias("protocol"),
        be_int64(F.col("bytes")).alias("bytes"),
        be_int64(F.col("packs")).alias("packets"),
    )


def source_lookup(spark: SparkSession, path: str, src_addr: str, use_store_filter: bool = True) -> DataFrame:
    """Flows of the keyed table whose source is ``src_addr``.

    With ``use_store_filter`` only the source's bucket directories are read and the stored
    ``src_addr`` column is compared in the Parquet scan (row-group pruning). Either
    way the key's first four bytes are re-checked, as a store-side filter would be.
    """
    raw = read_keyed_raw(spark, path, src_addr if use_store_filter else None)
    raw = raw.filter(F.substring(F.col("key"), 1, 4) == F.lit(ip_literal_bytes(src_addr)))
    return decode_keyed(raw)
