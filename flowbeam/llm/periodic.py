"""Runs (maximal periodic stretches) of words in every document, by an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q and length of at least
``max(least, 2 * q)`` that no neighbouring word extends keeping period q. In each task documents
are put together up to ``TOGETHER`` words (a longer one is alone) and handled as numpy arrays:

1. Suffix array by prefix doubling, only groups that are still equal being sorted again. A word's
   first rank includes its document, so suffixes of different documents never meet. Ranks of every
   doubling are kept: equal ranks are equal stretches of 2**k words.
2. LCP values of neighbouring suffixes, from those ranks.
3. LCP intervals by nearest smaller values on both sides, with their child intervals as index
   ranges; there are no tree nodes.
4. For each interval of depth d, every suffix i of all children but the largest looks up
   ISA[i + d] and ISA[i - d]: one that falls into the interval, but not into i's own child, gives a
   branching square of root length d, which no word extends to the right.
5. A branching square is rotated to the left as far as words stay equal at distance d; equal
   stretches of several root lengths are one run, of the least length as its period.

Work grows with n log n in a document's words (each suffix is in a smaller child at most log n
times); memory with its words times the doublings that its longest repeat needs.

Null, empty and blank texts have no words and no runs. Repeated rows are separate rows with the
same result; documents without ``doc_id`` are handled like others. Of ``find_runs`` only ``doc_id``
and ``text`` are looked at; ``collapse_runs`` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowbeam.session import ship_package

#: Words handled as one array.
TOGETHER = 200_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def doubled_ranks(keys: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ.

    ``keys`` differ between documents; ``ends`` is the end of each position's document. Each array
    has one more entry, -1, for the place after the last word.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[heads, n])
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.repeat(heads, sizes)
    levels = [rank.astype(np.int32)]
    active = order[np.repeat(sizes > 1, sizes)]
    step = 1
    while len(active):
        after = active + step
        second = np.where(after < ends[active], rank[np.minimum(after, n)], -1)
        pair = rank[active] * (n + 2) + second + 1
        order = np.argsort(pair, kind="stable")
        active, pair = active[order], pair[order]
        old = rank[active]
        place = np.arange(len(active))
        first = lambda new: np.maximum.accumulate(np.where(np.r_[True, new], place, 0))
        parted = np.r_[True, pair[1:] != pair[:-1]]
        rank[active] = old + first(parted[1:]) - first(old[1:] != old[:-1])
        levels.append(rank.astype(np.int32))
        heads = np.flatnonzero(parted)
        sizes = np.diff(np.r_[heads, len(active)])
        active = active[np.repeat(sizes > 1, sizes)]
        step *= 2
    return levels


def neighbour_lcp(levels: list[np.ndarray], suffixes: np.ndarray) -> np.ndarray:
    """lcp[p]: words that suffixes p - 1 and p of the suffix array have in common (0 for p = 0)."""
    lcp = np.zeros(len(suffixes) + 1, np.int64)
    left, right = suffixes[:-1], suffixes[1:]
    alike, pairs = [], np.arange(len(right))
    for ranks in levels:
        pairs = pairs[ranks[left[pairs]] == ranks[right[pairs]]]
        alike.append(pairs)
    common = np.zeros(len(right), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p = alike[k]
        at = common[p]
        same = levels[k][left[p] + at] == levels[k][right[p] + at]
        common[p[same]] += 1 << k
    lcp[1:-1] = common
    return lcp


def _nearest(values: np.ndarray, at: np.ndarray, pointer: np.ndarray, strict: bool) -> np.ndarray:
    """Follow ``pointer`` from every place in ``at`` to the nearest smaller value (or equal one, unless ``strict``).

    Between a place and its pointer there are only larger values (equal ones too if strict), so a
    pointer may be replaced by its target's pointer at any time.
    """
    pointer = pointer.copy()
    open_ = at
    while len(open_):
        target = pointer[open_]
        open_ = open_[values[target] >= values[open_] if strict else values[target] > values[open_]]
        pointer[open_] = pointer[pointer[open_]]
    return pointer


def branching_squares(suffixes: np.ndarray, inverse: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of every square that no further word extends to the right.

    ``lcp`` ends with a 0 after the last suffix; ``inverse`` with -1 after the last word.
    """
    at = np.flatnonzero(lcp)  # every one is a border between two children of an interval
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before, after = np.arange(-1, len(lcp) - 1), np.arange(1, len(lcp) + 1)
    equal_left = _nearest(lcp, at, before, strict=False)
    low = _nearest(lcp, at, equal_left, strict=True)
    equal_right = _nearest(lcp, at, after, strict=False)
    high = _nearest(lcp, at, equal_right, strict=True)
    # an interval is known by its first border
    is_first = equal_left[at] == low[at]
    first = np.arange(len(lcp))
    rest = at[~is_first]
    first[rest] = equal_left[rest]
    while len(rest):
        further = first[first[rest]]
        moved = further != first[rest]
        first[rest] = further
        rest = rest[moved]
    firsts = at[is_first]
    # children: right of each border, and left of each interval's first border
    border = np.r_[at, firsts]
    start = np.r_[at, low[firsts]]
    stop = np.r_[equal_right[at], firsts]
    size, interval = stop - start, first[border]
    largest = np.zeros(len(lcp), np.int64)
    np.maximum.at(largest, interval, size)
    left_out = np.full(len(lcp), -1, np.int64)
    big = np.flatnonzero(size == largest[interval])
    left_out[interval[big]] = big
    small = np.flatnonzero(left_out[interval] != np.arange(len(border)))
    size, start, stop, border = size[small], start[small], stop[small], border[small]
    which = np.repeat(np.arange(len(small)), size)
    place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which]
    i, depth = suffixes[place], lcp[border][which]
    lo, hi, own, own_end = low[border][which], high[border][which], start[which], stop[which]
    starts, roots = [], []
    for other, begin in ((i + depth, i), (i - depth, i - depth)):
        rank = inverse[np.maximum(other, -1)]  # place -1 is the entry after the last word
        hit = (rank >= lo) & (rank < hi) & ((rank < own) | (rank >= own_end))
        starts.append(begin[hit])
        roots.append(depth[hit])
    return np.concatenate(starts), np.concatenate(roots)


def rotate_left(levels: list[np.ndarray], starts: np.ndarray, roots: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """How many words before each square equal the words ``root`` later, within the document."""
    moved = np.zeros(len(starts), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        there = starts - moved - (1 << k)
        can = np.flatnonzero(there >= firsts)
        same = can[levels[k][there[can]] == levels[k][there[can] + roots[can]]]
        moved[same] += 1 << k
    return moved


def runs_of(words: np.ndarray, lengths: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (document, start, length, period), sorted, of documents laid end to end.

    ``words`` are word numbers, ``lengths`` the number of words of each document.
    """
    n = len(words)
    if not n:
        return np.empty((0, 4), np.int64)
    ends = np.cumsum(lengths)
    document = np.repeat(np.arange(len(lengths)), lengths)
    levels = doubled_ranks(document * (int(words.max()) + 1) + words, ends[document])
    inverse = levels[-1].astype(np.int64)
    suffixes = np.empty(n, np.int64)
    suffixes[inverse[:-1]] = np.arange(n)
    starts, roots = branching_squares(suffixes, inverse, neighbour_lcp(levels, suffixes))
    firsts = (ends - lengths)[document[starts]]
    stop = starts + 2 * roots
    starts = starts - rotate_left(levels, starts, roots, firsts)
    order = np.lexsort((roots, stop, starts))
    starts, stop, roots, firsts = starts[order], stop[order], roots[order], firsts[order]
    new = np.r_[True, (starts[1:] != starts[:-1]) | (stop[1:] != stop[:-1])][: len(starts)]
    new &= stop - starts >= least
    starts, stop, roots, firsts = starts[new], stop[new], roots[new], firsts[new]
    order = np.lexsort((roots, starts))
    return np.column_stack([document[starts], starts - firsts, stop - starts, roots])[order]


def runs_of_texts(texts: list[str | None], least: int = 12) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """(number of words, runs, collapsed text) of each text."""
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(lengths.sum()))
    found = runs_of(words, lengths, least)
    bounds = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    for k, ws in enumerate(split):
        runs = found[bounds[k] : bounds[k + 1], 1:]
        kept = ws
        if len(runs):
            change = np.zeros(len(ws) + 1, np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            kept = [ws[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        yield len(ws), list(map(tuple, runs.tolist())), b" ".join(kept).decode("utf-8", "surrogatepass")


def _mapped(docs: DataFrame, carried: Column, least: int) -> DataFrame:
    """(row, n_words, runs, collapsed) of every document; ``row`` is the carried struct."""
    ship_package(docs.sparkSession)
    rows = docs.select(carried.alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(f"n_words bigint, runs {RUNS}, collapsed string")])
    arrow = to_arrow_schema(schema)

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # about four bytes a word
        bytes_ = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
        at = size = 0
        for end, some in enumerate(bytes_.tolist()):
            if size and size + some // 4 > TOGETHER:
                yield batch.slice(at, end - at)
                at, size = end, 0
            size += some // 4
        if at < batch.num_rows:
            yield batch.slice(at)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                made = list(zip(*runs_of_texts(part.column("text").to_pylist(), least)))
                columns = [pa.array(c, type=f.type) for c, f in zip(made, list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays([part.column("row").cast(arrow.field(0).type), *columns], schema=arrow)

    return rows.mapInArrow(run, schema)


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document.

    ``runs`` is an array of (start, length, period), by start, then period. ``collapsed`` has the
    words joined by one space, without those that a run contains after its first ``period`` words.
    """
    return _mapped(docs, F.struct("doc_id"), least).select("row.doc_id", "n_words", "runs", "collapsed")


def collapse_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """``docs`` with the collapsed words as ``text``, in its own columns."""
    made = _mapped(docs, F.struct("*"), least)
    return made.select(*[F.col("collapsed").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def longest_run(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period); null for none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def runs_text(runs: Column) -> Column:
    """``start,length,period`` and a line end for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
