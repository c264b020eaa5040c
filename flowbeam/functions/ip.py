"""IPv4 address text <-> 4-byte binary, as Column expressions, plus a driver-side check."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a dotted quad of decimal octets 0..255 without leading zeros (no host names, no IPv6).
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
IPV4_REGEX = rf"\A{_IPV4}\z"
_IPV4_RE = re.compile(_IPV4)


def is_ipv4(text: Column) -> Column:
    """True for a dotted-quad IPv4 address, NULL for NULL."""
    return text.rlike(IPV4_REGEX)


def ip_to_bytes(text: Column) -> Column:
    """Dotted quad -> 4 bytes; NULL when the text is not a valid address."""
    # no branch around the parts: they are split once a row, not once an octet
    parts = F.split(F.when(is_ipv4(text), text), r"\.")
    octets = [F.lpad(F.hex(parts.getItem(i).cast("int")), 2, "0") for i in range(4)]
    return F.unhex(F.concat(*octets))


def bytes_to_ip(b: Column) -> Column:
    """4 bytes -> dotted quad; NULL unless exactly 4 bytes."""
    # one number, read once a row; NULL for another length, and so is the text
    u32 = F.conv(F.hex(F.when(F.length(b) == 4, b)), 16, 10).cast("long")
    octets = [F.shiftright(u32, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat(octets[0], F.lit("."), octets[1], F.lit("."), octets[2], F.lit("."), octets[3])


def check_ipv4(text: str) -> str:
    """Driver-side validation of one address parameter; returns it unchanged or raises."""
    if not isinstance(text, str) or not _IPV4_RE.fullmatch(text):
        raise ValueError(f"not a dotted-quad IPv4 address: {text!r}")
    return text


def ip_literal_bytes(text: str) -> bytes:
    """Driver-side 4-byte form of a checked address (for literal filters)."""
    return ipaddress.IPv4Address(check_ipv4(text)).packed
