"""Unordered host-pair key: the smaller address text first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_columns(src: Column, dst: Column) -> tuple[Column, Column]:
    """(addr_a, addr_b) with addr_a <= addr_b in text order; both directions map to one pair."""
    return F.least(src, dst).alias("addr_a"), F.greatest(src, dst).alias("addr_b")


def split_pair_key(key: Column, sep: str = ",") -> tuple[Column, Column]:
    """For text keys ``"a,b"`` written by other tools: the two addresses as columns."""
    parts = F.split(key, sep)
    return parts.getItem(0).alias("addr_a"), parts.getItem(1).alias("addr_b")
