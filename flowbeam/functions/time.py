"""Flow times: v5 start-time arithmetic, text formats, UTC calendar parts."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The display / parameter time format, and the compact parameter format.
TIME_FORMAT = "yyyy-MM-dd-HH:mm:ss"
COMPACT_TIME_FORMAT = "yyyyMMddHHmmss"
_DASHED_RE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]{2}:[0-9]{2}:[0-9]{2}"
_COMPACT_RE = r"[0-9]{14}"

MS_PER_DAY = 86_400_000
_2_31 = 1 << 31
_2_32 = 1 << 32


def _idiv(x: Column, n: int) -> Column:
    return F.floor(x / F.lit(n)).cast("long")


def start_time_ms(secs: Column, nsecs: Column, uptime: Column, first: Column) -> Column:
    """Flow start in epoch ms from the packet header clock and the record's ``first`` uptime.

    All inputs are unsigned 32-bit values widened to bigint. ``age = uptime - first``;
    when the device uptime wrapped after the flow began the difference is below -2^31 and
    2^32 is added back.
    """
    age = uptime - first
    age = F.when(age < F.lit(-_2_31), age + F.lit(_2_32)).otherwise(age)
    return secs * F.lit(1000) + _idiv(nsecs, 1_000_000) - age


def signed32_diff(last: Column, first: Column) -> Column:
    """``last - first`` in signed 32-bit arithmetic (wraps like an int subtraction)."""
    return F.pmod(last - first + F.lit(_2_31), F.lit(_2_32)) - F.lit(_2_31)


def format_time(ms: Column) -> Column:
    """Epoch ms -> ``yyyy-MM-dd-HH:mm:ss`` in UTC, whatever the session time zone."""
    second = _idiv(F.pmod(ms, F.lit(MS_PER_DAY)), 1000)
    parts = (_idiv(second, 3600), _idiv(F.pmod(second, F.lit(3600)), 60), F.pmod(second, F.lit(60)))
    clock = F.concat_ws(":", *(F.lpad(p.cast("string"), 2, "0") for p in parts))
    return F.concat(utc_date(ms).cast("string"), F.lit("-"), clock)


def parse_time(text: Column) -> Column:
    """Time parameter text (dashed or compact form, strictly zero-padded) -> epoch ms, read as
    UTC whatever the session time zone; NULL if bad."""
    shaped = text.rlike(rf"\A(?:{_DASHED_RE}|{_COMPACT_RE})\z")
    # read only where the text has the shape: it is matched once a row, not once a part
    digits = F.translate(text, "-:", "")
    day = F.unix_date(F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd"))
    hour, minute, second = (F.substring(digits, at, 2).cast("int") for at in (9, 11, 13))
    ms = (day.cast("long") * 86_400 + hour * 3600 + minute * 60 + second) * 1000
    sound = (hour < 24) & (minute < 60) & (second < 60) & (F.substring(digits, 1, 4) != "0000")
    return F.when(shaped & sound, ms)


def parse_time_literal(text: str) -> int:
    """Driver-side twin of ``parse_time`` for one spec: epoch ms (UTC), or ValueError."""
    if not isinstance(text, str):
        raise ValueError(f"time must be text: {text!r}")
    if re.fullmatch(_DASHED_RE, text):
        fmt = "%Y-%m-%d-%H:%M:%S"
    elif re.fullmatch(_COMPACT_RE, text):
        fmt = "%Y%m%d%H%M%S"
    else:
        raise ValueError(f"bad time {text!r}; want yyyy-MM-dd-HH:mm:ss or yyyyMMddHHmmss")
    try:
        parsed = _dt.datetime.strptime(text, fmt).replace(tzinfo=_dt.timezone.utc)
    except ValueError as exc:
        raise ValueError(f"bad time {text!r}: {exc}") from None
    return int(parsed.timestamp()) * 1000


def utc_date(ms: Column) -> Column:
    """Calendar date (UTC) of epoch ms, independent of the session time zone."""
    return F.date_from_unix_date(_idiv(ms, MS_PER_DAY).cast("int"))


def date_parts(ms: Column) -> list[Column]:
    """[year, month (1-based), day] of epoch ms in UTC, as int columns named for partitioning."""
    d = utc_date(ms)
    return [
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
    ]
