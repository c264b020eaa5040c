"""Schemas of the flow data model and early column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Canonical flow row: one NetFlow record, start time in epoch ms (UTC).
FLOW_SCHEMA = T.StructType(
    [
        T.StructField("src_addr", T.StringType()),
        T.StructField("dst_addr", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("time_ms", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("packets", T.LongType()),
    ]
)
FLOW_COLUMNS = [f.name for f in FLOW_SCHEMA.fields]

# Date partition columns of the stored flow table (1-based month, UTC calendar).
PARTITION_COLUMNS = ["year", "month", "day"]

STORED_FLOW_SCHEMA = T.StructType(
    FLOW_SCHEMA.fields + [T.StructField(c, T.IntegerType()) for c in PARTITION_COLUMNS]
)

# Display row / search document: addresses, time and protocol as text.
DISPLAY_SCHEMA = T.StructType(
    [
        T.StructField("srcAddress", T.StringType()),
        T.StructField("dstAddress", T.StringType()),
        T.StructField("srcPort", T.IntegerType()),
        T.StructField("dstPort", T.IntegerType()),
        T.StructField("time", T.StringType()),
        T.StructField("duration", T.LongType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("packets", T.LongType()),
    ]
)
DISPLAY_COLUMNS = [f.name for f in DISPLAY_SCHEMA.fields]

# Keyed row: 8-byte key (source address bytes || destination address bytes) plus
# big-endian value cells; ``src_addr`` is kept as its own column for scan pruning.
KEYED_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("src_addr", T.StringType()),
        T.StructField("src", T.BinaryType()),
        T.StructField("dst", T.BinaryType()),
        T.StructField("srcPort", T.BinaryType()),
        T.StructField("dstPort", T.BinaryType()),
        T.StructField("time", T.BinaryType()),
        T.StructField("dur", T.BinaryType()),
        T.StructField("prot", T.BinaryType()),
        T.StructField("bytes", T.BinaryType()),
        T.StructField("packs", T.BinaryType()),
    ]
)

# The stored keyed table is partitioned by a hash bucket of the source address and by write.
STORED_KEYED_SCHEMA = T.StructType(
    KEYED_SCHEMA.fields + [T.StructField("bucket", T.IntegerType()), T.StructField("version", T.StringType())]
)

# Query spec ("job document"): parameters as a string map.
SPEC_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Raw v5 packet input to the decoder.
PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("frame_no", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

REJECT_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("frame_no", T.LongType()),
        T.StructField("reject_reason", T.StringType()),
    ]
)


class SchemaError(ValueError):
    """Raised when an input DataFrame lacks a required column or has the wrong type."""


def require_columns(df: DataFrame, schema: T.StructType | list[str], what: str = "input") -> None:
    """Fail early (on the driver, before any job runs) when required columns are missing.

    With a StructType the column types are checked as well.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(schema, T.StructType):
        wanted = [(f.name, f.dataType) for f in schema.fields]
    else:
        wanted = [(name, None) for name in schema]
    missing = [name for name, _ in wanted if name not in present]
    if missing:
        raise SchemaError(f"{what} is missing column(s) {missing}; has {sorted(present)}")
    wrong = [
        f"{name}: {present[name].simpleString()} (want {dtype.simpleString()})"
        for name, dtype in wanted
        if dtype is not None and present[name] != dtype
    ]
    if wrong:
        raise SchemaError(f"{what} has column(s) of the wrong type: {wrong}")
