"""Benchmark decontamination: MinHash containment search for short items inside long documents.

Items are partitioned by size: an item of n shingles belongs to the class with upper bound
u = the next power of two. For a class, a document's shingle sequence is cut into windows of
2u shingles that start every u, so that a passage of an item's length lies whole in one of
them and a long document does not dilute it. Window and item are sketched by one-permutation
MinHash with a number of bins that grows with u; one equal bin minimum makes the item a
candidate. Candidates are verified by exact containment: the share of the item's distinct
shingles found anywhere in the document.

Only windows with a shingle that is some item's minimum can produce a candidate, so windows
without one (nearly all) are passed over; a bitmap decides that per shingle. Items are held by
the tasks in blocks of at most ``BLOCK_SHINGLES`` shingles, one pass over the documents per
block; the documents are never shuffled and no rows but matches are produced.

An item with fewer words than a shingle is one shingle, as is such a document. Items or
documents that are null, empty or blank match nothing. Every document row is judged by itself
(null and repeated ids included); repeated item rows give repeated matches.
With items of 16 shingles and more, a contained item at 80 % is missed with probability
below 1e-6; smaller items are found exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbeam.llm.frames import add_columns, empty, map_rows
from flowbeam.llm.text import hash_words, lower_words, mix64, shingle_sequence
from flowbeam.session import ship_package

#: Item shingles held by a task at a time (8 bytes each, and as much again for the sketches).
BLOCK_SHINGLES = 2_000_000
_SALT = np.uint64(0xD6E8FEB86659FD93)


def size_class(n: int) -> int:
    """Upper bound of the size class of an item with ``n`` shingles."""
    return 1 << max(0, int(n - 1).bit_length())


def bins_of(bound: int) -> int:
    """MinHash bins of a size class; for tiny items every shingle has a bin of its own."""
    return 1 << 20 if bound <= 16 else max(256, 4 * bound)


def bin_minima(values: np.ndarray, bins: int) -> np.ndarray:
    """The smallest mixed shingle hash in each non-empty bin (bin = low bits)."""
    values = np.sort(values)
    _, first = np.unique(values & np.uint64(bins - 1), return_index=True)
    return values[first]


class ItemBlock:
    """Some items: their shingle sets, and per size class the minima that lead to them."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        self.classes: dict[int, dict[int, list[int]]] = {}
        for k, (_, s) in enumerate(items):
            bound = size_class(len(s))
            table = self.classes.setdefault(bound, {})
            for v in bin_minima(mix64(s ^ _SALT), bins_of(bound)).tolist():
                table.setdefault(v, []).append(k)
        self.minima = np.unique(np.array([v for t in self.classes.values() for v in t], np.uint64))
        self.mask = np.uint64((1 << max(16, 4 + len(self.minima).bit_length())) - 1)
        self.bitmap = np.zeros(int(self.mask) + 1, bool)
        self.bitmap[(self.minima & self.mask).astype(np.int64)] = True

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, int, int]]:
        """(item index, item shingles, of these in the text) of every contained item."""
        sequence = shingle_sequence(hash_words(lower_words(text)), 5)
        values = mix64(sequence ^ _SALT)
        at = np.flatnonzero(self.bitmap[(values & self.mask).astype(np.int64)])
        if not len(at):
            return []
        slot = np.searchsorted(self.minima, values[at])
        slot[slot == len(self.minima)] = 0
        at = at[self.minima[slot] == values[at]]
        if not len(at):
            return []
        found: set[int] = set()
        for bound, table in self.classes.items():
            here = [i for i in at.tolist() if int(values[i]) in table]
            for w in sorted({max(0, x) for i in here for x in (i // bound, i // bound - 1)}):
                for v in bin_minima(values[w * bound : (w + 2) * bound], bins_of(bound)).tolist():
                    found.update(table.get(v, ()))
        out = []
        distinct = np.unique(sequence)
        for k in sorted(found):
            s = self.sets[k]
            slot = np.searchsorted(distinct, s)
            slot[slot == len(distinct)] = 0
            common = int((distinct[slot] == s).sum())
            if common >= threshold * len(s) - 1e-9:
                out.append((k, len(s), common))
        return out


def _item_sets(items: DataFrame) -> DataFrame:
    def make():
        def row(item_id, text):
            s = np.unique(shingle_sequence(hash_words(lower_words(text)), 5))
            return [(item_id, s.astype("<u8").tobytes())] if len(s) else []

        return row

    kind = items.schema["item_id"].dataType.simpleString()
    return map_rows(items, ["item_id", "text"], make, f"item_id {kind}, shingles binary", many=True)


def item_blocks(items: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> Iterator[ItemBlock]:
    """The items in blocks of bounded size, read partition by partition."""
    block, held = [], 0
    for r in _item_sets(items).toLocalIterator():
        s = np.frombuffer(r["shingles"], "<u8").astype(np.uint64)
        if block and held + len(s) > block_shingles:
            yield ItemBlock(block)
            block, held = [], 0
        block.append((r["item_id"], s))
        held += len(s)
    if block:
        yield ItemBlock(block)


def find_contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """(doc_id, item_id, n_item, n_common): items with ``threshold`` of their shingles in a document."""
    spark = docs.sparkSession
    ship_package(spark)
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_item long, n_common long"
    out = None
    for block in item_blocks(items, block_shingles):
        held = spark.sparkContext.broadcast(block)

        def make(held=held):
            items_ = held.value
            return lambda doc_id, text: [(doc_id, items_.ids[k], n, c) for k, n, c in items_.matches(text, threshold)]

        part = map_rows(docs, ["doc_id", "text"], make, schema, many=True)
        out = part if out is None else out.unionByName(part)
    return empty(spark, schema) if out is None else out


def decontaminate(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """The documents that contain no item, all their columns unchanged."""
    spark = docs.sparkSession
    ship_package(spark)
    for block in item_blocks(items, block_shingles):
        held = spark.sparkContext.broadcast(block)

        def make(held=held):
            items_ = held.value
            return lambda text: (len(items_.matches(text, threshold)),)

        docs = add_columns(docs, "text", make, "hits long").filter(F.col("hits") == 0).select("row.*")
    return docs
