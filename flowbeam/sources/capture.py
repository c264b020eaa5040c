"""Capture (pcap) files -> frames -> UDP payloads, ready for the packet decoder.

Files are read in byte ranges, many tasks to a file, so a file may be of any size and a task holds
one block of it. Spark lists the files (names, lengths and times only); a range is one row of a
DataFrame, and the tasks open their file, seek and read.

A range starts in the middle of some record, and only the record before it tells where the next
one begins. So files of several ranges get an index first: every range guesses its first record (a
header of plausible length and time, with plausible headers after it), walks the headers and tells
where the first record beyond its end begins. Where no range's guess is that place, the range that
holds it is walked again from there, until every range begins where the one before it ends. The
result never depends on a guess, and it gives each frame its number within its file. Files of one
range need no index.

Frames of a block are taken apart as numpy arrays: link header (Ethernet with at most one 802.1Q
tag, or raw IP), IPv4 header (options allowed; fragments rejected) and UDP header are compared for
all frames at once; the payloads leave as one Arrow binary array. Decoding above stays native.

Tasks open files with ``pyarrow.fs`` (local, HDFS, S3, GCS, Azure). Files in a store that only
Spark's readers open are taken whole from ``binaryFile`` rows (under 2 GB each).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowbeam.session import scratch_path, ship_package

# Pcap magic numbers (byte order, nanosecond resolution) and link types.
PCAP_MAGIC = {
    b"\xa1\xb2\xc3\xd4": (">", False),
    b"\xd4\xc3\xb2\xa1": ("<", False),
    b"\xa1\xb2\x3c\x4d": (">", True),
    b"\x4d\x3c\xb2\xa1": ("<", True),
}
FILE_HEADER_BYTES = 24
RECORD_HEADER_BYTES = 16
LINKTYPE_ETHERNET = 1
LINKTYPE_RAW = (101, 228)  # raw IP; raw IPv4
ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_VLAN = 0x8100
IPPROTO_UDP = 17

FRAME_SCHEMA = "path string, frame_no bigint, ts_ms bigint, payload binary, reject_reason string"
# Reject reasons: file level, then per frame in the order they are checked.
FILE_REJECTS = ("truncated_header", "bad_magic")
FRAME_REJECTS = (
    "truncated_frame",
    "unsupported_link",
    "not_ipv4",
    "bad_ip_header",
    "fragment",
    "not_udp",
)

#: Bytes of a file read by one task, and of it held at a time.
RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
#: A record's header, its frame's headers and the longest datagram: all that is read of a frame.
DECIDING_BYTES = 16 + 128 + (1 << 16)
#: What opening a file counts for when small files are dealt over tasks.
OPEN_COST_BYTES = 4 << 20
#: The same for a file's further ranges.
REOPEN_COST_BYTES = 1 << 18
#: Longest frame that a guess takes for plausible, and headers in a row that must be.
GUESS_FRAME_BYTES = 1 << 18
GUESS_HEADERS = 6
GUESS_WINDOW = 1 << 16
GUESS_SECONDS = 400 * 86_400
#: Ranges that are walked one after another at most, where there is no right guess.
MOST_REACH = 1 << 12

RANGE_SCHEMA = "path string, length bigint, range_no bigint, start bigint, stop bigint, begin bigint, first_frame bigint"
INDEX_SCHEMA = "path string, length bigint, range_no bigint, start bigint, stop bigint, begin bigint, beyond bigint, frames bigint"
CHAIN_SCHEMA = RANGE_SCHEMA + ", settled boolean"

#: Reads ``size`` bytes (fewer at the file's end) at an offset.
Fetch = Callable[[int, int], bytes]


# -- one file: header, records, frames (numpy, in tasks) --------------------------------------


class CaptureHeader:
    """Byte order, time resolution and link type of a capture file."""

    def __init__(self, head: bytes):
        self.reject = None
        if len(head) < FILE_HEADER_BYTES:
            self.reject = "truncated_header"
        elif bytes(head[:4]) not in PCAP_MAGIC:
            self.reject = "bad_magic"
        else:
            self.order, self.nanos = PCAP_MAGIC[bytes(head[:4])]
            self.link_type = struct.unpack_from(self.order + "I", head, 20)[0]


def _be16(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return buf[at].astype(np.int64) << 8 | buf[at + 1]


def _word32(buf: np.ndarray, at: np.ndarray, order: str) -> np.ndarray:
    parts = [buf[at + k].astype(np.int64) for k in (range(4) if order == ">" else range(3, -1, -1))]
    return parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]


def udp_payloads_of(buf: np.ndarray, at: np.ndarray, size: np.ndarray, link_type: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reason, payload start, payload length) of frames at ``at`` of ``size`` bytes in ``buf``.

    ``reason`` is an index into FRAME_REJECTS, or -1 for a whole UDP datagram. ``buf`` has at
    least 128 more bytes than its last frame, so that no comparison needs a bound.
    """
    n = len(at)
    reason = np.full(n, -1, np.int64)

    def reject(where: np.ndarray, name: str) -> None:
        reason[(reason < 0) & where] = FRAME_REJECTS.index(name)

    ip = at.copy()
    if link_type == LINKTYPE_ETHERNET:
        kind = _be16(buf, at + 12)
        tagged = kind == ETHERTYPE_VLAN
        reject(size < np.where(tagged & (size >= 14), 18, 14), "truncated_frame")
        reject(np.where(tagged, _be16(buf, at + 16), kind) != ETHERTYPE_IPV4, "not_ipv4")
        ip += np.where(tagged, 18, 14)
    elif link_type not in LINKTYPE_RAW:
        reject(np.ones(n, bool), "unsupported_link")
    left = size - (ip - at)
    reject(left < 20, "truncated_frame")
    reject(buf[ip] >> 4 != 4, "not_ipv4")
    header = (buf[ip] & 15).astype(np.int64) * 4
    reject(header < 20, "bad_ip_header")
    reject(_be16(buf, ip + 6) & 0x3FFF != 0, "fragment")
    reject(buf[ip + 9] != IPPROTO_UDP, "not_udp")
    reject(left < header + 8, "truncated_frame")
    length = _be16(buf, ip + header + 4)
    reject((length < 8) | (left < header + length), "truncated_frame")
    return reason, ip + header + 8, np.where(reason < 0, length - 8, 0)


def binary_array(buf: np.ndarray, start: np.ndarray, size: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Arrow binary values cut out of ``buf``; null where not ``valid``."""
    size = np.where(valid, size, 0)
    ends = np.cumsum(size)
    place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    mask = np.packbits(valid, bitorder="little")
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(size), [pa.py_buffer(mask.tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf[place].tobytes())]
    )


class Records:
    """Walks the records of one file from ``begin`` on, a block of bytes at a time.

    Records beginning before ``stop`` are given; ``beyond`` is then where the first one not given
    begins (the file's end after a record that the file cuts off).
    """

    def __init__(self, fetch: Fetch, length: int, header: CaptureHeader, begin: int, stop: int, block: int = BLOCK_BYTES):
        self.fetch, self.length, self.stop, self.block = fetch, length, min(stop, length), block
        self.sizes = struct.Struct(header.order + "I").unpack_from
        self.beyond, self.cut = begin, None

    def blocks(self) -> Iterator[tuple[int, bytes, list[int]]]:
        """(offset of the block, its bytes, offsets of whole records within them)."""
        while self.beyond < self.stop and self.cut is None:
            base = self.beyond
            # no more than decides on the records that begin before ``stop``
            want = min(self.block, self.stop - base + DECIDING_BYTES)
            data = self.fetch(base, want)
            at, records = 0, []
            while base + at < self.stop:
                if at + RECORD_HEADER_BYTES > len(data):
                    if base + at + RECORD_HEADER_BYTES > self.length:
                        self.cut = (base + at, None)
                    break
                end = at + RECORD_HEADER_BYTES + self.sizes(data, at + 8)[0]
                if end > len(data):
                    if base + end > self.length:
                        self.cut = (base + at, data[at : at + RECORD_HEADER_BYTES])
                        break
                    if at + DECIDING_BYTES > len(data):
                        if not records:  # a record longer than a block: what decides on it
                            data = self.fetch(base, min(end, DECIDING_BYTES))
                            if end > len(data):
                                records.append(at)
                                at = end
                            else:
                                continue
                        break
                records.append(at)
                at = end
            self.beyond = base + at
            if records:
                yield base, data, records
        if self.cut is not None:
            self.beyond = self.length


def guess_record(data: bytes, base: int, length: int, header: CaptureHeader, first_second: int | None) -> int | None:
    """First offset in ``data`` that looks like a record header, with more of them after it.

    ``base`` is the offset of ``data`` in the file, ``first_second`` the time of its first record.
    Times need not be in order or near each other: a range without a guess waits for the one before
    it, and many of those in a file would be a turn each.
    """
    buf = np.frombuffer(data, np.uint8)
    n = len(buf) - RECORD_HEADER_BYTES + 1
    if n <= 0:
        return None
    at = np.arange(n)
    kept, full = _word32(buf, at + 8, header.order), _word32(buf, at + 12, header.order)
    good = (kept <= GUESS_FRAME_BYTES) & (full >= kept) & (full <= 4 * GUESS_FRAME_BYTES)
    good &= _word32(buf, at + 4, header.order) < (1_000_000_000 if header.nanos else 1_000_000)
    # empty records are plausible near the file's first one only: zeros look like a row of them
    second = _word32(buf, at, header.order)
    whole = (kept > 0) & (second > 0)
    good &= whole if first_second is None else whole | (np.abs(second - first_second) < GUESS_SECONDS)
    good &= base + at + RECORD_HEADER_BYTES + kept <= length
    for start in np.flatnonzero(good).tolist():
        place, seen = start, 0
        while seen <= GUESS_HEADERS and place < n and good[place]:
            place += RECORD_HEADER_BYTES + int(kept[place])
            seen += 1
        # headers up to the end of the data or of the file are enough when there is more than one
        if seen > GUESS_HEADERS or base + place == length or (place >= n and seen > 1):
            return base + start
    return None


def _frame_batches(path: str, records: Records, header: CaptureHeader, first_frame: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    names = pa.array([*FRAME_REJECTS])
    number = first_frame
    for _, data, offsets in records.blocks():
        # room for header fields of a short last frame, never read as its own
        buf = np.frombuffer(data + bytes(128), np.uint8)
        at = np.array(offsets, np.int64)
        size = _word32(buf, at + 8, header.order)
        fraction = _word32(buf, at + 4, header.order) // (1_000_000 if header.nanos else 1_000)
        times = _word32(buf, at, header.order) * 1000 + fraction
        reason, start, length = udp_payloads_of(buf, at + RECORD_HEADER_BYTES, size, header.link_type)
        good = reason < 0
        columns = [
            pa.repeat(pa.scalar(path), len(at)),
            pa.array(np.arange(number, number + len(at))),
            pa.array(times),
            binary_array(buf, start, length, good),
            names.take(pa.array(reason, mask=good)),
        ]
        number += len(at)
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)
    if records.cut is not None:
        head = records.cut[1]
        when = None
        if head is not None:
            second, fraction = struct.unpack_from(header.order + "II", head)
            when = second * 1000 + fraction // (1_000_000 if header.nanos else 1_000)
        yield _one_row(arrow, path, number, when, "truncated_frame")


def _one_row(arrow: pa.Schema, path: str, number: int, when: int | None, reason: str) -> pa.RecordBatch:
    row = (path, number, when, None, reason)
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)


# -- ranges of files (DataFrames) --------------------------------------------------------------


def open_capture(path: str):
    """A random-access file for a URI or local path, opened without Spark."""
    from pyarrow import fs

    if ":/" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    uri = "s3" + path[3:] if path.startswith(("s3a://", "s3n://")) else path
    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri[5:].lstrip("/"))
    filesystem, name = fs.FileSystem.from_uri(uri)
    return filesystem.open_input_file(name)


def _fetcher(handle) -> Fetch:
    def fetch(offset: int, size: int) -> bytes:
        handle.seek(offset)
        return handle.read(size)

    return fetch


def tasks_can_open(path: str) -> bool:
    """Whether tasks can open this URI themselves (its scheme is one of ``pyarrow.fs``)."""
    return "://" not in path or path.split("://")[0] in ("file", "hdfs", "s3", "s3a", "s3n", "gs", "abfs", "abfss")


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified_ms) of every capture file under ``path``, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.unix_millis("modificationTime").alias("modified_ms"))


def file_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of (path, length) rows; only those at a file's start know where they begin."""
    last = F.greatest(F.floor((F.col("length") - 1) / range_bytes), F.lit(0))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("range_no"))
    start = F.col("range_no") * range_bytes
    at_start = F.col("range_no") == 0
    return ranges.select(
        "path", "length", "range_no", start.alias("start"), F.least(start + range_bytes, F.col("length")).alias("stop"),
        F.when(at_start, F.lit(FILE_HEADER_BYTES)).cast("long").alias("begin"),
        F.when(at_start, F.lit(0)).cast("long").alias("first_frame"),
    )


def _dealt(ranges: DataFrame, range_bytes: int) -> DataFrame:
    """Ranges over as many tasks as their bytes fill; small ranges share tasks, as small files do."""
    size = F.sum(F.col("stop") - F.col("start") + F.when(F.col("range_no") == 0, OPEN_COST_BYTES).otherwise(REOPEN_COST_BYTES))
    found = ranges.agg(size.alias("bytes"), F.count(F.lit(1)).alias("ranges")).first()
    least = min(found["ranges"], 4 * ranges.sparkSession.sparkContext.defaultParallelism)
    full = max(range_bytes, RANGE_BYTES) + OPEN_COST_BYTES
    return ranges.repartition(max(1, least, -(-(found["bytes"] or 0) // full)))


def _map_ranges(ranges: DataFrame, work, schema: str) -> DataFrame:
    """``work(row, fetch, header)`` gives Arrow batches for every range row, in its own task."""
    ship_package(ranges.sparkSession)
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_capture(row["path"]) as handle:
                    fetch = _fetcher(handle)
                    yield from work(row, fetch, CaptureHeader(fetch(0, FILE_HEADER_BYTES)), arrow)

    return ranges.mapInArrow(run, out)


def _index_work(range_bytes: int, block: int):
    """Walks of a range, or of ``reach`` of them one after another, from ``begin`` or a guess."""

    def work(row: dict, fetch: Fetch, header: CaptureHeader, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        begin, number, length, walks = row["begin"], row["range_no"], row["length"], []
        if header.reject is not None:
            walks = [{**row, "beyond": length, "frames": 0}] if number == 0 else []
        else:
            if begin is None:
                first = fetch(FILE_HEADER_BYTES, 4)
                second = struct.unpack(header.order + "I", first)[0] if len(first) == 4 else None
                at = row["start"]
                while begin is None and at < row["stop"]:
                    # a short look is enough for short frames, a longer one for the longest
                    for look in (GUESS_WINDOW, GUESS_WINDOW + 2 * GUESS_FRAME_BYTES):
                        if begin is None:
                            begin = guess_record(fetch(at, look), at, length, header, second)
                    at += GUESS_WINDOW
                if begin is None or begin >= row["stop"]:
                    return
            while len(walks) < row["reach"] and (begin < length or not walks):
                number = number if not walks else begin // range_bytes
                start, stop = number * range_bytes, min((number + 1) * range_bytes, length)
                records = Records(fetch, length, header, begin, stop, block)
                frames = sum(len(offsets) for _, _, offsets in records.blocks())
                walks.append({**row, "range_no": number, "start": start, "stop": stop, "begin": begin, "beyond": records.beyond, "frames": frames})
                begin = records.beyond
        yield pa.RecordBatch.from_pylist([{k: w[k] for k in arrow.names} for w in walks], schema=arrow)

    return work


def _chain(walks: DataFrame, range_bytes: int) -> DataFrame:
    """The walks that follow one another from the file's first record on (CHAIN_SCHEMA).

    Where a file's chain breaks off for want of a walk, a row not ``settled`` tells where. One pass
    over walks in the order of their places, whatever the number of them.
    """
    out = T._parse_datatype_string(CHAIN_SCHEMA)
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, length, due, number, rows = None, 0, None, 0, []

        def broken() -> list[tuple]:
            start = due // range_bytes * range_bytes
            return [(path, length, start // range_bytes, start, min(start + range_bytes, length), due, number, False)]

        for batch in batches:
            for w in batch.to_pylist():
                if w["path"] != path:
                    if due is not None and due < length:
                        rows += broken()
                    path, length, due, number = w["path"], w["length"], None, 0
                if w["range_no"] == 0 if due is None else w["begin"] == due and w["begin"] < w["stop"]:
                    rows.append((path, length, w["range_no"], w["start"], w["stop"], w["begin"], number, True))
                    due, number = w["beyond"], number + w["frames"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            rows = []
        if due is not None and due < length:
            rows = broken()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return walks.repartition("path").sortWithinPartitions("path", "range_no", "begin").mapInArrow(run, out)


def index_ranges(ranges: DataFrame, range_bytes: int = RANGE_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """Ranges of files of several ranges, with ``begin`` and ``first_frame`` settled.

    All walks are kept, whether their guess was right or not, so a wrong one spoils no range but
    its own. A turn walks from every place that a walk ends at and none begins at: the places where
    chains break off, and those after other wrong guesses. Turns end when no chain is broken; from
    where one broke off a turn goes on through twice as many ranges as the turn before.
    """
    spark = ranges.sparkSession
    columns = T._parse_datatype_string(INDEX_SCHEMA).names
    path, turn = scratch_path(spark, "capture-index"), 0
    again = ranges.select("path", "length", "range_no", "start", "stop", "begin", F.lit(1).alias("reach"))
    while True:
        _map_ranges(_dealt(again, range_bytes), _index_work(range_bytes, block), INDEX_SCHEMA).write.mode("append").parquet(path)
        walks = spark.read.schema(INDEX_SCHEMA).parquet(path).select(*columns)
        chain_path = scratch_path(spark, "capture-chain")
        _chain(walks, range_bytes).write.parquet(chain_path)
        chain = spark.read.schema(CHAIN_SCHEMA).parquet(chain_path)
        broken = chain.filter(~F.col("settled")).select("path", F.col("begin").alias("due"))
        if broken.isEmpty():
            break
        known = walks.filter("begin < stop").select("path", F.col("begin").alias("beyond"))
        ends = walks.join(broken, "path").filter("beyond >= due and beyond < length").select("path", "length", "beyond", "due")
        start = F.col("range_no") * range_bytes
        again = ends.distinct().join(known, ["path", "beyond"], "left_anti").withColumn("range_no", F.floor(F.col("beyond") / range_bytes)).select(
            "path", "length", "range_no", start.alias("start"), F.least(start + range_bytes, F.col("length")).alias("stop"),
            F.col("beyond").alias("begin"), F.when(F.col("beyond") == F.col("due"), min(1 << turn, MOST_REACH)).otherwise(1).alias("reach"),
        )
        turn += 1
    return chain.filter((F.col("begin") < F.col("stop")) | (F.col("range_no") == 0)).select(
        "path", "length", "range_no", "start", "stop", "begin", "first_frame"
    )


def _frame_work(block: int):
    def work(row: dict, fetch: Fetch, header: CaptureHeader, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        if row["length"] == 0:
            return
        if header.reject is not None:
            if row["range_no"] == 0:
                yield _one_row(arrow, row["path"], 0, None, header.reject)
            return
        records = Records(fetch, row["length"], header, row["begin"], row["stop"], block)
        yield from _frame_batches(row["path"], records, header, row["first_frame"], arrow)

    return work


def frames_by_range(files: DataFrame, range_bytes: int = RANGE_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """Frames (FRAME_SCHEMA) of the capture files listed as (path, length, ...) rows.

    A damaged file ends with one reject row (``truncated_frame``); an unreadable file header gives
    a single ``truncated_header`` or ``bad_magic`` row; an empty file gives none.
    """
    ranges = file_ranges(files.select("path", "length"), range_bytes)
    if files.filter(F.col("length") > range_bytes).isEmpty():
        return _map_ranges(_dealt(ranges, range_bytes), _frame_work(block), FRAME_SCHEMA)
    several = F.col("length") > range_bytes
    settled = ranges.filter(~several).unionByName(index_ranges(ranges.filter(several), range_bytes, block))
    return _map_ranges(_dealt(settled, range_bytes), _frame_work(block), FRAME_SCHEMA)


def frames_of_contents(files: DataFrame) -> DataFrame:
    """Frames of whole files given as (path, content) rows, for stores that only Spark opens."""
    ship_package(files.sparkSession)
    out = T._parse_datatype_string(FRAME_SCHEMA)
    arrow = to_arrow_schema(out)
    work = _frame_work(BLOCK_BYTES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_buffer()
                if content is None:
                    continue
                fetch = lambda offset, size, data=memoryview(content): bytes(data[offset : offset + size])
                length = len(memoryview(content))
                row = {"path": path, "length": length, "range_no": 0, "begin": FILE_HEADER_BYTES, "stop": length, "first_frame": 0}
                yield from work(row, fetch, CaptureHeader(fetch(0, FILE_HEADER_BYTES)), arrow)

    return files.select("path", "content").mapInArrow(run, out)


def frames_from_files(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of listed files, by ranges where tasks can open them, else by whole contents."""
    spark, one = files.sparkSession, files.select("path").first()
    if one is None or tasks_can_open(one["path"]):
        return frames_by_range(files, range_bytes)
    paths = [r["path"] for r in files.select("path").toLocalIterator()]
    return frames_of_contents(spark.read.format("binaryFile").load(paths))


def udp_payloads(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads: path, frame_no, ts_ms, payload; rejects: path, frame_no, reject_reason)."""
    good = frames.filter(F.col("reject_reason").isNull()).select("path", "frame_no", "ts_ms", "payload")
    bad = frames.filter(F.col("reject_reason").isNotNull()).select("path", "frame_no", "reject_reason")
    return good, bad


def read_capture(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """UDP payloads and frame rejects of every capture file under ``path``."""
    return udp_payloads(frames_from_files(scan_files(spark, path), range_bytes))
