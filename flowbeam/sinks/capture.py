"""Capture-file writer: v5 packets -> Ethernet/IPv4/UDP frames -> pcap files (test fixtures).

Frames are built with native columns; files are bounded runs of ``frames_per_file`` frames
per input partition; the task that built them appends them to its files through ``pyarrow.fs``
(local paths, HDFS or object stores alike), without a shuffle and without a file in one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbeam.functions.binary import be_uint
from flowbeam.session import ship_package

# Big-endian pcap global header (magic a1b2c3d4, v2.4, snaplen 65535; the link type
# follows, 1 for Ethernet).
PCAP_HEADER_HEX = "A1B2C3D4" + "00020004" + "00000000" + "00000000" + "0000FFFF"
ETH_ADDRESSES_HEX = "000000000002" + "000000000001"
# How a frame may be spoilt, beside being "udp" (whole) or "tcp".
TRANSPORTS = ("udp", "tcp", "ipv6", "ip_header", "fragment", "cut")
NETFLOW_PORT = 2055


def _hx(x: Column, width: int) -> Column:
    return F.lpad(F.hex(x.cast("long")), 2 * width, "0")


def frame_bytes(payload: Column, transport: Column, ts_sec: Column) -> Column:
    """One pcap record (16-byte record header + frame) carrying ``payload``; NULL without a payload.

    ``transport`` is one of TRANSPORTS: ``ipv6`` has another ethertype, ``ip_header`` too short a
    header length, ``fragment`` the more-fragments flag, and ``cut`` lacks its last byte. Only the
    headers are built as hex text.
    """
    n = F.length(payload)
    tcp = transport == "tcp"
    l4_len = F.when(tcp, F.lit(20)).otherwise(F.lit(8))
    ip_total = n + l4_len + 20
    ethertype = F.when(transport == "ipv6", F.lit("86DD")).otherwise(F.lit("0800"))
    ip = F.concat(
        F.when(transport == "ip_header", F.lit("4400")).otherwise(F.lit("4500")), _hx(ip_total, 2), F.lit("0000"),
        F.when(transport == "fragment", F.lit("2000")).otherwise(F.lit("0000")), F.lit("40"),
        F.when(tcp, F.lit("06")).otherwise(F.lit("11")), F.lit("0000"),
        F.lit("0A000001"), F.lit("0A000002"),
    )
    l4 = F.when(
        tcp, F.concat(_hx(F.lit(40000), 2), _hx(F.lit(NETFLOW_PORT), 2), F.lit("0" * 16), F.lit("50000000"), F.lit("0" * 8))
    ).otherwise(F.concat(_hx(F.lit(40000), 2), _hx(F.lit(NETFLOW_PORT), 2), _hx(n + 8, 2), F.lit("0000")))
    kept = ip_total + 14 - F.when(transport == "cut", F.lit(1)).otherwise(F.lit(0))
    rec_header = F.concat(_hx(ts_sec, 4), F.lit("00000000"), _hx(kept, 4), _hx(ip_total + 14, 4))
    headers = F.unhex(F.concat(rec_header, F.lit(ETH_ADDRESSES_HEX), ethertype, ip, l4))
    return F.substring(F.concat(headers, payload), F.lit(1), kept + 16)


def _slices(frames: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each value of an Arrow binary array ends within its bytes, after where the first begins."""
    wide = pa.types.is_large_binary(frames.type)
    ends = np.frombuffer(frames.buffers()[1], np.int64 if wide else np.int32)
    data = frames.buffers()[2]
    return ends[frames.offset : frames.offset + len(frames) + 1], memoryview(data if data is not None else b"")


def _writer(out_dir: str, frames_per_file: int, header: bytes):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        filesystem, base = fs.FileSystem.from_uri(out_dir)
        filesystem.create_dir(base, recursive=True)
        part, names, out, seen = TaskContext.get().partitionId(), [], None, 0
        try:
            for batch in batches:
                ends, data = _slices(batch.column(0))
                at = 0
                while at < batch.num_rows:
                    run, place = divmod(seen, frames_per_file)
                    if place == 0:
                        if out is not None:
                            out.close()
                        names.append(f"capture-{part:05d}-{run:012d}.pcap")
                        out = filesystem.open_output_stream(f"{base}/{names[-1]}")
                        out.write(header)
                    stop = min(batch.num_rows, at + frames_per_file - place)
                    out.write(data[ends[at] : ends[stop]])
                    seen, at = seen + stop - at, stop
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    return write


def write_capture_files(packets: DataFrame, out_dir: str, frames_per_file: int = 1000, link_type: int = 1) -> int:
    """Write ``packets`` (payload [, transport]) as pcap files; returns the file count.

    A task writes its partition's frames as they come, with no more than a batch of them in memory.
    Files of the same name in ``out_dir`` are replaced.
    """
    transport = F.col("transport") if "transport" in packets.columns else F.lit("udp")
    ts = F.coalesce(be_uint(F.col("payload"), 8, 4), F.lit(0))
    header = bytes.fromhex(PCAP_HEADER_HEX + f"{link_type:08X}")
    ship_package(packets.sparkSession)
    frames = packets.select(frame_bytes(F.col("payload"), transport, ts).alias("frame"))
    return frames.mapInArrow(_writer(out_dir, frames_per_file, header), "name string").count()
