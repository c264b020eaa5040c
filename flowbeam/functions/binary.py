"""Big-endian fixed-width fields in binary columns, and the inverse encoding.

``conv(hex(...), 16, 10)`` reads the bytes as an unsigned number, so unsigned widening of
u8/u16/u32 comes for free and everything stays in Catalyst expressions (codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_uint(b: Column, offset: int, width: int) -> Column:
    """Unsigned big-endian integer of ``width`` bytes at 0-based ``offset`` of ``b``, as bigint."""
    return F.conv(F.hex(F.substring(b, offset + 1, width)), 16, 10).cast("long")


def uint_to_be(x: Column, width: int) -> Column:
    """Two's-complement big-endian bytes of ``x`` modulo 2^(8*width).

    ``pmod`` first: ``lpad`` keeps the *left* part of an over-long string, so a value with
    too many hex digits must be reduced before padding.
    """
    x = x.cast("long")
    if width < 8:
        x = F.pmod(x, F.lit(1 << (8 * width)))
    return F.unhex(F.lpad(F.hex(x), 2 * width, "0"))


def be_int32(b: Column, offset: int = 0) -> Column:
    """Signed 32-bit big-endian integer (two's complement) at ``offset``."""
    u = be_uint(b, offset, 4)
    return F.when(u >= F.lit(1 << 31), u - F.lit(1 << 32)).otherwise(u)


def be_int64(b: Column, offset: int = 0) -> Column:
    """Signed 64-bit big-endian integer at ``offset`` (``conv`` to a negative base keeps the sign)."""
    return F.conv(F.hex(F.substring(b, offset + 1, 8)), 16, -10).cast("long")


def hex_field(h: Column, offset, width: int) -> Column:
    """Unsigned field read from the *hex text* ``h`` of a binary (one ``hex`` per row, many fields).

    ``offset`` is a byte offset (int or Column).
    """
    if isinstance(offset, int):
        return F.conv(F.substring(h, 2 * offset + 1, 2 * width), 16, 10).cast("long")
    return F.conv(h.substr(offset * 2 + 1, F.lit(2 * width)), 16, 10).cast("long")


def field_of(word: Column, offset: int, width: int) -> Column:
    """Unsigned field of ``width`` bytes at byte ``offset`` (0..7) inside a 64-bit word."""
    shift = 8 * (8 - offset - width)
    shifted = F.shiftrightunsigned(word, shift) if shift else word
    return shifted.bitwiseAND(F.lit((1 << (8 * width)) - 1))


def ipv4_text(u32: Column) -> Column:
    """Dotted quad of an unsigned 32-bit address value."""
    return F.concat_ws(
        ".", *[F.shiftright(u32, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    )
