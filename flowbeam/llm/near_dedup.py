"""Near-duplicate groups by b-bit MinHash.

1. One pass over the texts gives every document's distinct shingles, their count, a hash of
   the set, and ``BANDS * ROWS`` minima. Of each minimum the lowest four bits are kept,
   packed 16 to a long; the full minima serve only to build the band keys.
2. Documents with equal sets become one node, so exact copies are never compared or joined.
3. Nodes that share a band key are tied to that bucket's pivot (a map-side minimum joined
   back: a bucket yields as many rows as it has nodes, not pairs). For a bucket of two, the
   pair itself is judged by its bit counts: with r of 16 values a random low-bits collision
   has chance 1/16, so the similarity is (matches - 1/16) / (1 - 1/16). The ties' connected
   components are clusters that hold every candidate link.
4. Links are confirmed on the full sets inside clusters, in blocks: a cluster's nodes are
   dealt to blocks of bounded rows and shingles by hash, and query nodes meet every block. First a few pivots per cluster
   are the queries; nodes that they do not reach are the queries of a second pass. A pair is
   intersected when its bit counts allow a link (five standard deviations below the
   threshold) and its ends are not yet connected. So every candidate pair between different
   components is judged, and copies of one text cost one comparison each.
5. Components of the confirmed links give ``component_id``.

At a similarity of 0.8 a link misses all 32 bands of 5 rows with probability 3e-6.
Shingles and sets are held as 64-bit hashes (a false match has probability about 1e-13 for a
pair of long documents). Null, empty or blank texts have no shingles and are linked with
nothing. A null ``doc_id`` takes part; it is never the smallest id of a group that has another.
Rows that repeat a ``doc_id`` are each a row of the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbeam.llm.components import connected_components
from flowbeam.llm.frames import Scratch, map_rows, stored
from flowbeam.llm.text import mix64, shingle_set
from flowbeam.session import ship_package

BANDS, ROWS, BITS = 32, 5, 4
HASHES = BANDS * ROWS
PER_LONG = 64 // BITS
WORDS = HASHES // PER_LONG
#: Pivots of a cluster that all its nodes are compared with in the first pass.
PIVOTS = 8
#: Shingles of a block (8 bytes each); blocks of a cluster are compared in separate tasks.
BLOCK_SHINGLES = 400_000
#: Members, and queries, of a block, however small their sets are.
BLOCK_ROWS = 500
#: Rows up to which the map of clustered documents (24 bytes each) is broadcast.
BROADCAST_ROWS = 1_000_000

_SEEDS = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEEDS[:HASHES], _SEEDS[HASHES:] | np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set of shingle hashes."""
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 512):
        block = (shingles[at : at + 512, None] ^ _XOR) * _MUL
        np.minimum(least, block.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 63-bit key per band, distinct between bands."""
    rows = least.reshape(BANDS, ROWS)
    acc = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        acc = mix64(acc ^ rows[:, j])
    return (acc >> np.uint64(1)).astype(np.int64)


def pack_low_bits(least: np.ndarray) -> np.ndarray:
    """The lowest bits of each minimum (of a mixed value: products have weak low bits), packed."""
    low = (mix64(least) & np.uint64((1 << BITS) - 1)).reshape(WORDS, PER_LONG)
    shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low << shifts, axis=1).astype(np.int64)


def estimated_similarity(matches):
    """Jaccard similarity from the number of equal packed values, corrected for collisions."""
    chance = 1.0 / (1 << BITS)
    return (matches / HASHES - chance) / (1 - chance)


def slack_threshold(threshold: float) -> float:
    """Estimate that a pair at ``threshold`` falls below with probability under 1e-6."""
    return threshold - 5 * (threshold * (1 - threshold) / HASHES) ** 0.5 - 0.02


def _node_of(shingles: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1 if len(shingles) else None


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, n_shingles, bands, bits) per row; node is null without shingles."""

    def make():
        def row(doc_id, text):
            s = shingle_set(text, words)
            if not len(s):
                return (doc_id, None, 0, [], [])
            least = minima(s)
            return (doc_id, _node_of(s), len(s), band_keys(least), pack_low_bits(least))

        return row

    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, node long, n_shingles long, bands array<long>, bits array<long>", )


def _matches(x: Column, y: Column) -> Column:
    """Equal 4-bit values of two packed signatures."""
    total = F.lit(0)
    for i in range(WORDS):
        d = x[i].bitwiseXOR(y[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + (PER_LONG - F.bit_count(d))
    return total


def _ties(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): node and pivot of each bucket that can hold a link."""
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    # the pivot is the least of a hash; six orders, so that a node meets several pivots
    rank = F.struct(F.xxhash64("node", F.col("band") % 6).alias("h"), F.col("node").alias("pivot"))
    buckets = keyed.groupBy("key").agg(F.min(rank).alias("least"), F.count("*").alias("n")).filter("n > 1")
    pairs = (
        keyed.join(buckets.select("key", "least.pivot", "n"), "key").filter("node <> pivot")
        .groupBy("node", "pivot").agg(F.max("n").alias("n"))
    )
    sure = pairs.filter("n > 2").select("node", "pivot")
    single = (
        pairs.filter("n = 2")
        .join(nodes.select("node", F.col("bits").alias("x")), "node")
        .join(nodes.select(F.col("node").alias("pivot"), F.col("bits").alias("y")), "pivot")
    )
    likely = single.filter(estimated_similarity(_matches(F.col("x"), F.col("y"))) >= slack_threshold(threshold))
    return sure.union(likely.select("node", "pivot"))


def _equal_values(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    d = x ^ rows
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return HASHES - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1).astype(np.int64)


def confirm_block(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) between the queries and the members of one block, by full set comparison.

    Pairs whose components are already joined (before, or by a link found here) are skipped:
    a further link would not change the components.
    """
    queries = block[block["role"] == 0].sort_values("node")
    members = block[block["role"] == 1]
    if queries.empty or members.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    ids, comps, sizes = (members[c].to_numpy() for c in ("node", "label", "n_shingles"))
    bits = np.stack([np.asarray(b, np.int64) for b in members["bits"]]).view(np.uint64)
    sets = [np.frombuffer(s, "<u8") for s in members["shingles"]]
    least = slack_threshold(percent / 100)
    links = []
    for q in queries.itertuples(index=False):
        estimate = estimated_similarity(_equal_values(np.asarray(q.bits, np.int64).view(np.uint64), bits))
        small, large = np.minimum(sizes, q.n_shingles), np.maximum(sizes, q.n_shingles)
        may = np.flatnonzero((estimate >= least) & (100 * small >= percent * large) & (ids != q.node))
        own = np.frombuffer(q.shingles, "<u8")
        for i in may[np.argsort(-estimate[may], kind="stable")]:
            x, y = find(q.label), find(int(comps[i]))
            if x == y:
                continue
            at = np.searchsorted(own, sets[i])
            at[at == len(own)] = 0
            both = int((own[at] == sets[i]).sum())
            if 100 * both >= percent * (len(own) + len(sets[i]) - both):
                parent[max(x, y)] = min(x, y)
                links.append((q.node, int(ids[i])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _confirmed(members: DataFrame, queries: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between the query nodes and all members of their clusters."""
    columns = ["cluster", "node", "label", "n_shingles", "bits", "shingles"]
    blocks = queries.groupBy("cluster").agg(F.sum("n_shingles").alias("q_size"), F.count("*").alias("q_rows"))
    load = members.groupBy("cluster").agg(F.sum("n_shingles").alias("m_size"), F.count("*").alias("m_rows"))
    plan = scratch.store(load.join(blocks, "cluster").select(
        "cluster",
        F.ceil(F.greatest(F.col("m_size") / BLOCK_SHINGLES, F.col("m_rows") / BLOCK_ROWS)).cast("int").alias("m_blocks"),
        F.ceil(F.greatest(F.col("q_size") / BLOCK_SHINGLES, F.col("q_rows") / BLOCK_ROWS)).cast("int").alias("q_blocks"),
    ), "dedup-blocks")

    def dealt(df: DataFrame, own: str, other: str, role: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("node"), F.col(f"{own}_blocks")).cast("int")
        rows = df.join(plan, "cluster").select(*columns, mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other))
        return rows.select("cluster", "m", "q", *columns[1:], F.lit(role).alias("role"))

    both = dealt(queries.select(*columns), "q", "m", 0).unionByName(dealt(members.select(*columns), "m", "q", 1))
    return both.groupBy("cluster", "m", "q").applyInPandas(lambda pdf: confirm_block(pdf, percent), "a long, b long")


def _clustered_sets(docs: DataFrame, clusters: DataFrame, words: int) -> DataFrame:
    """(cluster, node, n_shingles, bits, shingles) of every node in a cluster, from the texts again."""
    small = clusters.count() <= BROADCAST_ROWS
    wanted = clusters.select(F.col("rep").alias("rep_"), F.col("node").alias("node_"), "cluster", "bits")
    picked = docs.select("doc_id", "text").join(
        F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("rep_")))

    def make():
        def row(node, cluster, bits, text):
            s = shingle_set(text, words)
            # a repeated id may stand at another text
            return [(cluster, node, len(s), bits, s.astype("<u8").tobytes())] if _node_of(s) == node else []

        return row

    return map_rows(picked, ["node_", "cluster", "bits", "text"], make,
                    "cluster long, node long, n_shingles long, bits array<long>, shingles binary", many=True)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id, kept; links at ``percent`` similarity.

    ``component_id`` is the smallest id of the component (null if it has only null ids);
    ``kept`` marks the rows whose id it is. An integer ``doc_id`` and a ``text`` are used, any
    other columns are ignored.
    """
    ship_package(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_near_duplicates(docs, words, percent, scratch), "near-duplicates")


def _near_duplicates(docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    sig = scratch.store(signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words), "dedup-signatures")
    own = sig.filter("node is not null")
    ids = own.groupBy("node").agg(F.min("doc_id").alias("rep"))
    # any row of a node has the same bands and bits: the smallest id's row stands for it
    nodes = scratch.store(
        own.join(ids, "node").filter(F.col("doc_id").eqNullSafe(F.col("rep")))
        .select("node", "rep", "bands", "bits").dropDuplicates(["node"]), "dedup-nodes")
    clusters = scratch.store(
        connected_components(_ties(nodes, percent / 100), scratch.store).withColumnRenamed("label", "cluster")
        .join(nodes.select("node", "rep", "bits"), "node"), "dedup-clusters")
    members = scratch.store(_clustered_sets(docs, clusters, words).dropDuplicates(["node"]), "dedup-members")

    pivots = _pivots(members)
    first = scratch.store(_confirmed(members.withColumn("label", F.col("node")), pivots, percent, scratch), "dedup-links")
    label = scratch.store(connected_components(first, scratch.store), "dedup-components")
    labelled = scratch.store(
        members.select("cluster", "node").join(label, "node", "left")
        .withColumn("label", F.coalesce("label", "node")), "dedup-labels")
    sizes = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", F.col("label").alias("main"))).alias("top"), F.count("*").alias("parts"))
    open_ = main.filter("parts > 1").select("cluster", "top.main")
    rest = members.join(labelled.drop("cluster"), "node").join(open_, "cluster")
    asked = rest.filter("label <> main").join(pivots.select("node"), "node", "left_anti")
    second = scratch.store(_confirmed(rest, asked, percent, scratch), "dedup-links")
    final = label if second.isEmpty() else connected_components(first.union(second), scratch.store)

    named = ids.join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.filter("rep is not null").groupBy("label").agg(F.min("rep").alias("component_id"))
    of_node = named.join(least, "label", "left").select("node", "component_id")
    out = sig.select("doc_id", "node", "n_shingles").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def _pivots(members: DataFrame) -> DataFrame:
    """Up to ``PIVOTS`` nodes of each cluster, one of each residue of a hash of the node.

    The least hash per (cluster, residue) is a map-side aggregate; no cluster is sorted whole.
    """
    h = F.xxhash64("node", F.lit(7))
    chosen = (
        members.groupBy("cluster", F.pmod(h, F.lit(PIVOTS)).alias("residue"))
        .agg(F.min(F.struct(h.alias("h"), F.col("node").alias("node"))).alias("least")).select(F.col("least.node").alias("node"))
    )
    return members.join(chosen, "node").withColumn("label", F.col("node"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group (the smallest id), all columns unchanged.

    Further rows with a kept id and the same text are dropped as copies; rows whose text has
    no words are all kept, as are rows of groups without any id.
    """
    verdict = near_duplicates(docs, words, percent)
    gone = verdict.groupBy("doc_id").agg(F.max("kept").alias("any")).filter("not any").select(F.col("doc_id").alias("gone_id"))
    rows = docs.select(F.struct("*").alias("row"))
    left = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    twice = verdict.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select(F.col("doc_id").alias("twice_id"))
    again = stored(twice, "dedup-repeated-ids")
    if again.isEmpty():
        return left.select("row.*")
    single = left.join(again, F.col("row.doc_id").eqNullSafe(F.col("twice_id")), "left_anti")
    repeated = left.join(again, F.col("row.doc_id").eqNullSafe(F.col("twice_id")), "left_semi").dropDuplicates(["row"])
    return single.unionByName(repeated).select("row.*")
