"""flowbeam: network-flow analytics as Spark DataFrame jobs.

Layers:

* ``functions``  - Column expressions (addresses, big-endian fields, times, protocols).
* ``sources``    - readers: flow tables, documents, keyed tables, capture files, results.
* ``operators``  - DataFrame -> DataFrame operators (decode, filters, top pairs, ...).
* ``sinks``      - writers: partitioned Parquet, documents, keyed upserts, result sets.
* ``plans``      - end-to-end jobs composed from the above (ingest, flow query, top pairs).
* ``streaming``  - Structured Streaming ingest of arriving capture files.
"""

from flowbeam.schema import DISPLAY_SCHEMA, FLOW_COLUMNS, FLOW_SCHEMA
from flowbeam.session import get_session, scratch_path, use_utc

__all__ = [
    "DISPLAY_SCHEMA",
    "FLOW_COLUMNS",
    "FLOW_SCHEMA",
    "get_session",
    "scratch_path",
    "use_utc",
]
