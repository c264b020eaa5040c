"""IP protocol numbers and the names shown in display rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol number -> display name; every other number shows as "Unknown".
PROTOCOL_NAMES = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP"}
UNKNOWN_PROTOCOL = "Unknown"

_NUMBER_BY_NAME = {name: number for number, name in PROTOCOL_NAMES.items()}


def protocol_name(number: Column) -> Column:
    """Protocol number (0..255) -> display name."""
    expr = None
    for num, name in PROTOCOL_NAMES.items():
        expr = (F.when if expr is None else expr.when)(number == num, F.lit(name))
    return expr.otherwise(F.lit(UNKNOWN_PROTOCOL))


def protocol_number(text: Column) -> Column:
    """Protocol parameter text (a number 0..255 or a known name, any case) -> int; NULL if neither."""
    upper = F.upper(F.trim(text))
    numeric = F.when(text.rlike(r"\A[0-9]{1,3}\z"), text.cast("int"))
    expr = F.when(numeric.between(0, 255), numeric)
    for name, num in _NUMBER_BY_NAME.items():
        expr = expr.when(upper == name, F.lit(num))
    return expr


def resolve_protocol(text: str | int) -> int:
    """Driver-side: the protocol parameter of one spec as a number, or ValueError."""
    if isinstance(text, int):
        number = text
    else:
        value = str(text)
        name = value.strip(" ").upper()
        if name in _NUMBER_BY_NAME:
            return _NUMBER_BY_NAME[name]
        if not re.fullmatch(r"[0-9]{1,3}", value):
            raise ValueError(f"unknown protocol: {text!r}")
        number = int(value)
    if not 0 <= number <= 255:
        raise ValueError(f"protocol out of range 0..255: {text!r}")
    return number
