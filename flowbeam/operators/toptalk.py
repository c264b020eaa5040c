"""Host-pair traffic: bytes per unordered pair, top talkers, latest flow per directed pair.

Scale notes
* ``pair_bytes`` is a hash aggregate with a map-side partial sum, so a pair holding a third
  of all rows is reduced to one row per map task before the shuffle (no skewed reducer).
* ``top_pairs`` is ``orderBy(...).limit(n)``, planned as ``TakeOrderedAndProject``: each task
  keeps only its n best rows; no global sort of all pairs.
* ``latest_per_pair`` is a ``max(struct(order..., row...))`` aggregate, not a row_number
  window: the window would sort a hot pair inside a single task, the aggregate combines it
  map-side like any other sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbeam.functions.pairs import pair_columns
from flowbeam.schema import FLOW_COLUMNS, require_columns

PAIR_KEYS = ["src_addr", "dst_addr"]


def pair_bytes(flows: DataFrame) -> DataFrame:
    """(addr_a, addr_b, bytes): total bytes of each unordered host pair, every flow counted."""
    require_columns(flows, ["src_addr", "dst_addr", "bytes"], "flows")
    a, b = pair_columns(F.col("src_addr"), F.col("dst_addr"))
    return flows.groupBy(a, b).agg(F.sum(F.col("bytes").cast("long")).alias("bytes"))


def order_pairs(pairs: DataFrame) -> DataFrame:
    """Descending bytes; equal sums ordered by the two addresses."""
    return pairs.orderBy(F.desc("bytes"), F.asc("addr_a"), F.asc("addr_b"))


def top_pairs(flows: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` unordered host pairs exchanging the most bytes."""
    if n < 0:
        raise ValueError(f"top-n must be >= 0, got {n}")
    return order_pairs(pair_bytes(flows)).limit(n)


def latest_per_pair(
    flows: DataFrame,
    keys: Sequence[str] = PAIR_KEYS,
    tie_breakers: Sequence[str] = (),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The last flow of each directed (src, dst) pair: what a last-write-wins keyed store holds.

    "Last" is the greatest ``time_ms``; ties go to the greatest ``tie_breakers`` and then to
    the remaining flow columns, so the choice is a total order (rows still tied are equal).
    ``keep`` names the output columns (default: the flow columns).
    """
    require_columns(flows, list(keys) + ["time_ms"], "flows")
    keep = list(keep) if keep is not None else [c for c in FLOW_COLUMNS if c in flows.columns]
    order = ["time_ms", *tie_breakers]
    rest = [c for c in flows.columns if c not in order and c not in keys]
    latest = F.max(F.struct(*[F.col(c) for c in order + rest])).alias("_latest")
    out = flows.groupBy(*keys).agg(latest)
    return out.select(
        *[F.col(k) if k in keys else F.col(f"_latest.{k}").alias(k) for k in keep]
    )


def top_pairs_latest(
    flows: DataFrame, n: int = 10, tie_breakers: Sequence[str] = ()
) -> DataFrame:
    """Top pairs counting only the latest flow of each directed pair (keyed-store semantics)."""
    latest = latest_per_pair(flows, tie_breakers=tie_breakers, keep=["src_addr", "dst_addr", "bytes"])
    return top_pairs(latest, n)
