"""Order of flows along a space-filling (Z-order) curve of their two addresses.

Rows near each other on the curve are near in source and in destination, so a run of rows (a
Parquet row group) covers a small rectangle of addresses and a lookup by either end skips most.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowbeam.functions.binary import be_uint
from flowbeam.functions.ip import ip_to_bytes

# The bits of each byte value on the even places of 16.
_SPREAD = [sum((b >> k & 1) << 2 * k for k in range(8)) for b in range(256)]


def _spread(x: Column) -> Column:
    """32 bits on the even places of 64, a byte at a time; each byte is looked up, not computed
    from copies of copies of ``x``."""
    table, out = F.lit(_SPREAD), F.lit(0).cast("long")
    for byte in range(4):
        wide = F.get(table, F.shiftright(x, 8 * byte).bitwiseAND(F.lit(255)).cast("int")).cast("long")
        out = out.bitwiseOR(F.shiftleft(wide, 16 * byte))
    return out


def interleave(x: Column, y: Column) -> Column:
    """The bits of two unsigned 32-bit values in turn, ``x`` first, in the order of signed longs."""
    woven = F.shiftleft(_spread(x), 1).bitwiseOR(_spread(y))
    return woven.bitwiseXOR(F.lit(-(1 << 63)))


def address_number(address: Column) -> Column:
    """An IPv4 text as an unsigned 32-bit number; 0 for other texts."""
    return F.coalesce(be_uint(ip_to_bytes(address), 0, 4), F.lit(0)).cast("long")


def address_curve(src: Column, dst: Column) -> Column:
    """Place of a pair of addresses on the curve."""
    return interleave(address_number(src), address_number(dst))
