"""Connected components of an edge table by alternating star contractions.

Each round replaces every edge set by edges to the smallest neighbour (first for larger
neighbours, then for smaller ones) until nothing changes; every component is then a star
around its smallest node. Rounds grow with the logarithm of the component's diameter. The
smallest neighbour is a map-side aggregate joined back, so a node with very many edges is
never gathered in one group. Every round is written to the shared scratch folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbeam.llm.frames import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def connected_components(edges: DataFrame, store: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """(node, label): every node of an edge, labelled by the smallest node of its component.

    ``edges`` has two columns of one integer type; loops and repeated edges do no harm, edges
    with a null end are ignored. ``store`` keeps the tables of the rounds.
    """
    a, b = edges.columns
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    loops = now.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    now = store(now.filter("a <> b").distinct(), "edges")
    digest = None
    while True:
        now = store(_small_star(_large_star(now)).distinct(), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == digest or not seen[0]:
            break
        digest = seen
    members = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return members.union(centres).union(loops).groupBy("node").agg(F.min("label").alias("label"))
