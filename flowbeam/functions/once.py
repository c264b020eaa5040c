"""Costly expressions that several later columns or filters read.

The optimizer moves filters below the projections that they read, with a copy of every expression
in them, and copies multiply from one projection to the next: a plan of two or three steps
recomputes the first one dozens of times a row, or outgrows generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns added (or replaced) that are computed once a row, whoever reads them.

    A projection, where expressions share what they have in common, under a generator of one row:
    nothing above that is merged with or moved below it.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    made = df.select(*kept, *[c.alias(name) for name, c in columns.items()])
    return made.select(*kept, F.inline(F.array(F.struct(*columns))))
