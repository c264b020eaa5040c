"""Column functions (all JVM-side built-ins; no Python UDFs)."""

from flowbeam.functions.binary import be_uint, uint_to_be
from flowbeam.functions.ip import bytes_to_ip, ip_to_bytes, is_ipv4
from flowbeam.functions.pairs import pair_columns
from flowbeam.functions.protocol import protocol_name, protocol_number, resolve_protocol
from flowbeam.functions.time import (
    date_parts,
    format_time,
    parse_time,
    parse_time_literal,
    signed32_diff,
    start_time_ms,
)

__all__ = [
    "be_uint",
    "bytes_to_ip",
    "date_parts",
    "format_time",
    "ip_to_bytes",
    "is_ipv4",
    "pair_columns",
    "parse_time",
    "parse_time_literal",
    "protocol_name",
    "protocol_number",
    "resolve_protocol",
    "signed32_diff",
    "start_time_ms",
    "uint_to_be",
]
