"""Flow rows -> NetFlow v5 packets (the decoder's inverse), for round trips and fixtures.

Packets are bounded groups: at most 30 records, all starting on the same UTC day (the day
is always part of the packet key). The header clock is the end of that day, so each record's
``first``/``last`` uptime offsets depend only on the record itself and are encoded before
grouping; the group only joins the record texts (no higher-order function, so the plan
stays in whole-stage codegen). An uptime of 4,000,000,000 ms covers the day with room to
spare. Without ``packet_by`` the records are packed in the order of each input partition
(``sortWithinPartitions`` by time, then runs of 30); with it, a key's records are numbered in
time order and cut into runs of 30. No group ever grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbeam.functions.ip import ip_to_bytes
from flowbeam.functions.once import computed_once
from flowbeam.functions.time import MS_PER_DAY
from flowbeam.operators.decode import V5_MAX_COUNT, V5_VERSION
from flowbeam.schema import FLOW_COLUMNS, require_columns

DEFAULT_UPTIME_MS = 4_000_000_000


def _hx(x: Column, width: int) -> Column:
    """Big-endian hex text of ``x`` modulo 2^(8*width)."""
    return F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << (8 * width)))), 2 * width, "0")


def _word(*fields: tuple[Column, int]) -> Column:
    """Hex text of one 64-bit word of (value, bytes) fields, each modulo its size."""
    word, left = F.lit(0).cast("long"), 64
    for x, width in fields:
        left -= 8 * width
        word = word.bitwiseOR(F.shiftleft(x.cast("long").bitwiseAND(F.lit((1 << 8 * width) - 1)), left))
    return F.lpad(F.hex(word), 16, "0")


def _zeros(width: int) -> Column:
    return F.lit("00" * width)


def encode_v5(
    flows: DataFrame, packet_by: Sequence[str] | None = None, uptime_ms: int = DEFAULT_UPTIME_MS
) -> DataFrame:
    """One row per packet: the packet key columns, ``count`` and ``payload`` (binary)."""
    require_columns(flows, FLOW_COLUMNS, "flows")
    day = F.floor(F.col("time_ms") / F.lit(MS_PER_DAY))
    if packet_by is None:
        keyed = (
            flows.sortWithinPartitions("time_ms")
            .withColumn("_part", F.spark_partition_id())
            .withColumn("_run", F.floor(F.monotonically_increasing_id() / F.lit(V5_MAX_COUNT)))
        )
        keys = ["_part", "_run", "_day"]
    else:
        keyed = flows
        keys = [*packet_by, "_day"] if "_day" not in packet_by else list(packet_by)
    hdr_ms = (F.col("_day") + 1) * F.lit(MS_PER_DAY)  # end of the packet's UTC day
    first = F.lit(uptime_ms) - ((day + 1) * F.lit(MS_PER_DAY) - F.col("time_ms"))
    last = first + F.col("duration_ms")
    rec = F.concat(
        F.hex(ip_to_bytes(F.col("src_addr"))),
        F.hex(ip_to_bytes(F.col("dst_addr"))),
        _zeros(8),  # next hop, input and output interfaces
        _word((F.col("packets"), 4), (F.col("bytes"), 4)),
        _word((first, 4), (last, 4)),
        # pad1 and tcp_flags after the ports, tos after the protocol
        _word((F.col("src_port"), 2), (F.col("dst_port"), 2), (F.lit(0), 2), (F.col("protocol"), 1), (F.lit(0), 1)),
        _zeros(8),  # src_as, dst_as, masks, pad2
    )
    # a column before the shuffle: an aggregate evaluates what it collects without generated code
    records = computed_once(keyed.withColumn("_day", day), _rec=rec)
    if packet_by is not None:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("time_ms")) - 1
        records = records.withColumn("_run", F.floor(place / F.lit(V5_MAX_COUNT)))
        keys = [*keys, "_run"]
    packets = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.collect_list("_rec").alias("_recs"))
    header = F.concat(
        _hx(F.lit(V5_VERSION), 2),
        _hx(F.col("count"), 2),
        _hx(F.lit(uptime_ms), 4),
        _hx(F.floor(hdr_ms / 1000), 4),
        _hx(F.pmod(hdr_ms, F.lit(1000)) * 1_000_000, 4),
        _zeros(8),  # flow sequence, engine type and id, sampling
    )
    payload = F.unhex(F.concat(header, F.array_join("_recs", "")))
    packets = packets.select(*keys, "_recs", F.col("count").cast("int").alias("count"))
    return computed_once(packets, payload=payload).drop("_recs")
