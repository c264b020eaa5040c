"""Interpolated modified Kneser-Ney language model of any order, counted in Spark.

Counting: a first pass counts the words and numbers them, frequent ones first. In the second every task counts its n-grams (sorted
runs of bounded size) and sends each shard one compressed block per run. A shard is chosen by
the inner words of an n-gram (those but the first and the last), so one task has all n-grams
of a context and all left neighbours of the next shorter n-grams: it writes the arrays of two
orders, and only counts by the order below them are shuffled again. Inner words that are more
than half a shard by the first pass's counts are dealt over as many shards as that makes, by
the outer words; what they add to a context or a shorter n-gram is merged in the next round.

Storing and scoring: the arrays lie in the shared folder as files that scoring tasks map into
memory; a batch's distinct n-grams are looked up in sorted order, so pages are read in
sequence and shared by the workers of a machine. An entry is 48 bits of its hash and one byte:
its place in the shard's table of the most frequent values, or a mark that the value is in a
list of its own. Shards have about ``SHARD_TOKENS`` tokens at any size of the corpus, so of a
billion lookups of missing n-grams a few find another's entry. Where the shared folder is not
a mounted file system, a task fetches a file once, maps the copy and unlinks it at once.

Words are lower-cased (A-Z) and followed by an end token; contexts before the first word are
padded. Padding counts as a word when distinct left neighbours are counted. Unknown words
share one uniform share, 1 / (vocabulary + 1). Null texts are empty: one end token. N-grams
are known by their words' numbers while they are counted; counts are exact up to 2**53. Every
input row is scored; a null id counts as the empty string for the split.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbeam.llm.frames import ROWS_AT_ONCE, Scratch
from flowbeam.llm.text import hash_words, lower_words, mix64
from flowbeam.session import scratch_path, ship_package

END, PAD = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)
#: Numbers of padding and of words that training did not see.
PAD_ID, UNKNOWN = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
#: Tokens that a task counts at a time, and that are looked up at a time.
COUNT_TOKENS, SCORE_TOKENS = 3_000_000, 1_000_000
#: Tokens of a shard.
SHARD_TOKENS = 1_000_000
#: Entries' values that have a code of one byte; the last code marks a value outside the table.
TABLE, OUTSIDE = 255, 255
_BLOCK = "kind string, level int, shard int, columns binary, counts binary"


# -- files ---------------------------------------------------------------------------------


def _posix(uri: str) -> str | None:
    """The path of a local or mounted folder, None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def write_table(folder: str, name: str, keys: np.ndarray, values: np.ndarray, ranks: np.ndarray | None = None) -> None:
    """One file of sorted keys with a row of values each, and a rank. Repeated attempts of a task leave the same file."""
    short = keys >> np.uint64(16)
    order = np.argsort(short, kind="stable")
    short, values = short[order], values[order].astype("<u8")
    width = values.shape[1]
    small = (values < 1 << 16).all(axis=1)
    shifts = np.arange(width, dtype="<u8") * np.uint64(16)
    rows, place, n = np.unique((values[small] << shifts).sum(axis=1, dtype="<u8"), return_inverse=True, return_counts=True)
    kept = np.argsort(-n, kind="stable")[:TABLE]
    of_row = np.full(len(rows), OUTSIDE, "u1")
    of_row[kept] = np.arange(len(kept))
    code = np.full(len(short), OUTSIDE, "u1")
    code[small] = of_row[place]
    outside = np.flatnonzero(code == OUTSIDE)
    known = (rows[kept][:, None] >> shifts) & np.uint64(0xFFFF)
    data = [np.array([len(short), len(kept), len(outside), width, ranks is not None], "<i8"), known.astype("<f8"), values[outside].astype("<f8"),
            outside.astype("<u4"), *([] if ranks is None else [ranks[order].astype("<u4")]), (short >> np.uint64(16)).astype("<u4"), (short & np.uint64(0xFFFF)).astype("<u2"), code]
    path = _posix(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for a in data:
                f.write(np.ascontiguousarray(a).data)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/{name}") as f:
        for a in data:
            f.write(np.ascontiguousarray(a).data)


class MappedTable:
    """A file of ``write_table``, mapped into memory."""

    def __init__(self, data: np.ndarray):
        n, kept, outside, width, ranked = data[:40].view("<i8").tolist()
        at, parts = 40, []
        for kind, size in (("<f8", kept * width), ("<f8", outside * width), ("<u4", outside), ("<u4", n * ranked), ("<u4", n), ("<u2", n), ("u1", n)):
            end = at + np.dtype(kind).itemsize * size
            parts.append(data[at:end].view(kind))
            at = end
        self.rows, self.others, self.at, self.ranks, self.high, self.low, self.code = parts
        self.rows, self.others = self.rows.reshape(kept, width), self.others.reshape(outside, width)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is missing."""
        out = np.full(len(keys), -1)
        high, low = (keys >> np.uint64(32)).astype("<u4"), ((keys >> np.uint64(16)) & np.uint64(0xFFFF)).astype("<u2")
        todo, slot = np.arange(len(keys)), np.searchsorted(self.high, high)
        while len(todo):  # entries that share the upper half follow one another
            inside = slot < len(self.high)
            todo, slot = todo[inside], slot[inside]
            same = self.high[slot] == high[todo]
            todo, slot = todo[same], slot[same]
            hit = self.low[slot] == low[todo]
            out[todo[hit]] = slot[hit]
            todo, slot = todo[~hit], slot[~hit] + 1
        return out

    def values(self, slots: np.ndarray) -> np.ndarray:
        """A row of values per place; zeros for -1."""
        out = np.zeros((len(slots), self.rows.shape[1]))
        found = np.flatnonzero(slots >= 0)
        code = self.code[slots[found]]
        known = code != OUTSIDE
        out[found[known]] = self.rows[code[known]]
        out[found[~known]] = self.others[np.searchsorted(self.at, slots[found[~known]])]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A row of values per key; zeros where a key is missing."""
        return self.values(self.slots(keys))


def map_table(folder: str, name: str) -> MappedTable | None:
    """The table of a file, None if there is no such file."""
    path = _posix(folder)
    if path is not None:
        if not os.path.exists(f"{path}/{name}"):
            return None
        return MappedTable(np.asarray(np.memmap(f"{path}/{name}", np.uint8, "r")))
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
        return None
    with tempfile.NamedTemporaryFile() as copy:
        with store.open_input_stream(f"{root}/{name}") as f:
            while chunk := f.read(1 << 24):
                copy.write(chunk)
        copy.flush()
        return MappedTable(np.asarray(np.memmap(copy.name, np.uint8, "r")))


# -- counting ------------------------------------------------------------------------------


def in_training(doc_id) -> bool:
    """The default split: crc32 of the id's text, mod 5, is not 1."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given as one array per word; the same as ngram_hashes of the sequence."""
    acc = columns[0]
    for c in columns[1:]:
        acc = (acc ^ (acc >> np.uint64(30))) * np.uint64(0x9E3779B97F4A7C15) + c
    return mix64(acc)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of words, contexts or n-grams by their hash."""
    return (mix64(keys ^ np.uint64(5)) % np.uint64(shards)).astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Which shard holds an n-gram: by its inner words, and by its outer words where those are frequent.

    ``words`` are the frequent words in order, ``salts`` the number of shards that each is dealt over.
    """

    order: int
    shards: int
    words: np.ndarray
    salts: np.ndarray

    def inner(self, level: int, columns: list[np.ndarray]) -> list[np.ndarray]:
        """The words that choose the shard of n-grams of ``level``, of which the last word need not be given."""
        return columns[1 : level - 1] if level > 2 and (self.order - level) % 2 == 0 else columns[: max(level - 1, 1)]

    def spread(self, inner: list[np.ndarray]) -> np.ndarray:
        """Number of shards, by the inner word that is the least frequent."""
        out = np.full(len(inner[0]), np.iinfo(np.int64).max)
        for c in inner:
            at = np.minimum(np.searchsorted(self.words, c), max(len(self.words) - 1, 0))
            out = np.minimum(out, np.where(self.words[at] == c, self.salts[at], 1) if len(self.words) else 1)
        return out

    def shard(self, inner: list[np.ndarray], spread: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        salt = _key([first, last]) % spread.astype(np.uint64)
        return ((mix64(_key(inner) ^ np.uint64(7)) % np.uint64(self.shards) + salt) % np.uint64(self.shards)).astype(np.int64)

    def top(self, level: int) -> bool:
        """Whether n-grams of a level are sent to their shards (not derived there)."""
        return level == self.order or (self.order - level) % 2 == 0 or level == 1


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """Places of n-grams in order of their words: as many columns as fit are sorted as one number of 64 bits."""
    packed, room = [], 0
    for c in columns:
        bits = max(1, int(c.max(initial=0)).bit_length())
        if bits > room:
            packed, room = [*packed, c], 64 - bits
        else:
            packed[-1], room = (packed[-1] << np.uint64(bits)) | c, room - bits
    return np.argsort(packed[0]) if len(packed) == 1 else np.lexsort(packed[::-1])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and where each key went (np.unique's places are the first ones; it sorts slower)."""
    bits = np.uint64(len(keys).bit_length())  # hashes seldom share their upper bits: they are sorted with places in the lower ones
    order = np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64))
    order = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(keys)
        ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


def _grouped(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order of their words, with summed counts."""
    order = _order(columns)
    columns, counts = [c[order] for c in columns], counts[order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(counts, at) if len(at) else counts


def _blocks(kind: str, level: int, columns, counts, shard: np.ndarray) -> Iterator[tuple]:
    """One row per shard: its part of the columns (one after another) and of the counts."""
    order = np.argsort(shard, kind="stable")
    names, starts = np.unique(shard[order], return_index=True)
    for s, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
        at = order[a:b]
        yield (kind, level, int(s), _encode([c[at] for c in columns]), _pack(counts[at]))


def _encode(columns: list[np.ndarray]) -> bytes:
    """Packed columns, byte by byte: numbers of words are small where words are frequent."""
    width = max(1, (max(int(c.max(initial=0)) for c in columns).bit_length() + 7) // 8)
    parts = [_pack(np.ascontiguousarray(c, "<u8").view("u1").reshape(-1, 8)[:, :width].T) for c in columns]
    return bytes([width]) + b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _columns(data: bytes) -> list[np.ndarray]:
    width, at, out = data[0], 1, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        planes = _unpack(data[at + 8 : at + 8 + n], "u1").reshape(width, -1)
        column = np.zeros((planes.shape[1], 8), "u1")
        column[:, :width] = planes.T
        out.append(column.reshape(-1).view("<u8"))
        at += 8 + n
    return out


def token_sequence(text: str | None, order: int) -> np.ndarray:
    """Padding, word hashes, end."""
    return np.concatenate([np.full(order - 1, PAD), hash_words(lower_words(text)), [END]]).astype(np.uint64)


def _send(level: int, columns: list[np.ndarray], counts: np.ndarray, layout: Layout) -> Iterator[tuple]:
    """Blocks of n-grams for their shards, in the order given."""
    if level == 1:
        yield from _blocks("gram", 1, columns, counts, _shard(columns[0], layout.shards))
        return
    inner = layout.inner(level, columns)
    yield from _blocks("gram", level, columns, counts, layout.shard(inner, layout.spread(inner), columns[0], columns[-1]))


def _count_words(sequences: list[np.ndarray], order: int, shards: int) -> Iterator[tuple]:
    words, counts = np.unique(np.concatenate([s[order - 1 :] for s in sequences]), return_counts=True)
    yield from _blocks("raw", 0, [words], counts.astype("<i8"), _shard(words, shards))


@dataclass
class Words:
    """Where the word counts lie."""

    folder: str
    shards: int
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and training counts of word hashes."""
        distinct, _, back = _distinct(words)
        numbers, counts, shard = np.full(len(distinct), UNKNOWN), np.zeros(len(distinct)), _shard(distinct, self.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            if k not in self._open:
                self._open[k] = map_table(self.folder, f"R-{k}")
            table, at = self._open[k], order[cuts[k] : cuts[k + 1]]
            if table is not None:
                slots = table.slots(distinct[at])
                counts[at] = table.values(slots)[:, 0]
                known = slots >= 0
                numbers[at[known]] = table.ranks[slots[known]].astype("<u8") * np.uint64(self.shards) + np.uint64(k + 1)
        numbers[distinct == PAD] = PAD_ID
        return numbers[back], counts[back]

    def columns(self, sequences: list[np.ndarray], order: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The n-grams of texts, one array of word numbers per place, and the counts of their last words."""
        tokens = np.concatenate(sequences)
        numbers, counts = self.find(tokens)
        sizes = np.array([len(s) for s in sequences])
        ends = np.cumsum(sizes)
        first = np.ones(len(tokens), bool)  # tokens that begin an n-gram
        for k in range(1, order):
            first[ends - k] = False
        at = np.flatnonzero(first)
        return [numbers[at + k] for k in range(order)], counts[at + order - 1]


def _count_grams(sequences: list[np.ndarray], words: Words, layout: Layout) -> Iterator[tuple]:
    columns, _ = words.columns(sequences, layout.order)
    places = [*range(1, layout.order - 1), 0, layout.order - 1][-layout.order :]  # sorted by inner words, to be packed well
    grouped, counts = _grouped([columns[k] for k in places], np.ones(len(columns[0]), np.int64))
    yield from _send(layout.order, [grouped[places.index(k)] for k in range(layout.order)], counts, layout)


def _batches(rows: Iterable[tuple], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)


_ARROW = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("shard", pa.int32()), ("columns", pa.binary()), ("counts", pa.binary())])


def _totals(context: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context hash: tokens, n-grams seen once, twice, more often."""
    names, _, at = _distinct(_key(context))
    sums = np.bincount(at * 4 + np.minimum(counts, 3), minlength=4 * len(names)).reshape(-1, 4)
    sums[:, 0] = np.bincount(at, counts, len(names))
    return names, sums


def _facts(kind: str, level: int, shard: int, counts: np.ndarray) -> tuple:
    facts = [len(counts), counts.sum(), *((counts == c).sum() for c in (1, 2, 3, 4)), (counts > 2).sum()]
    return (f"facts-{kind}", level, shard, b"", np.array(facts, "<i8").tobytes())


def _merge_words(pdf: pd.DataFrame, words: Words, order: int, most: int) -> pd.DataFrame:
    """Word counts of a shard: stored with ranks, totalled, and the numbers of words seen more than ``most`` times."""
    shard = int(pdf["shard"].iloc[0])
    (found,), counts = _grouped([np.concatenate([_columns(c)[0] for c in pdf["columns"]])], np.concatenate([_unpack(c, "<i8") for c in pdf["counts"]]))
    ranks = np.empty(len(found), np.int64)
    ranks[np.argsort(-counts, kind="stable")] = np.arange(len(found))
    write_table(words.folder, f"R-{shard}", found, counts[:, None], ranks)
    numbers = ranks.astype("<u8") * np.uint64(words.shards) + np.uint64(shard + 1)
    if END in found:  # one end and up to order - 1 times padding a text
        numbers, seen = np.append(numbers, PAD_ID), np.append(counts, counts[found == END] * (order - 1))
    else:
        seen = counts
    often = seen > most
    rows = [_facts("raw", 0, shard, counts), ("often", 0, shard, numbers[often].astype("<u8").tobytes(), seen[often].astype("<i8").tobytes())]
    return pd.DataFrame(rows, columns=["kind", "level", "shard", "columns", "counts"])


def _merge(pdf: pd.DataFrame, folder: str, layout: Layout) -> pd.DataFrame:
    """Merge one shard's blocks, write its arrays, and return parts of what follows from them.

    ``gram`` blocks are n-grams of a level that is sent (Layout.top), ``part`` blocks n-grams whose
    left neighbours were counted in several shards, ``context`` blocks totals from several shards.
    """
    kind, level, shard = pdf["kind"].iloc[0], int(pdf["level"].iloc[0]), int(pdf["shard"].iloc[0])
    parts = [_columns(c) for c in pdf["columns"]]
    columns = [np.concatenate(c) for c in zip(*parts)]
    counts = np.concatenate([_unpack(c, "<i8").reshape(-1, 4 if kind == "context" else 1) for c in pdf["counts"]])
    del parts, pdf
    rows: list[tuple] = []

    def lower(columns, counts):
        """What n-grams that are complete here add to the next shorter ones."""
        suffix, left = _grouped(columns[1:], np.ones(len(counts), np.int64))
        rows.extend(_send(len(suffix), suffix, left, layout))

    def by_spread(level, columns, counts):
        """Totals of contexts that lie in one shard are stored, those of others sent on."""
        many = layout.spread(layout.inner(level, columns)) > 1
        if not many.all():
            names, sums = _totals([c[~many] for c in columns[:-1]], counts[~many])
            write_table(folder, f"C{level}-{shard}", names, sums)
        if many.any():
            names, sums = _totals([c[many] for c in columns[:-1]], counts[many])
            rows.extend(_blocks("context", level, [names], sums, _shard(names, layout.shards)))
        return many

    if kind == "context":
        names, at = np.unique(columns[0], return_inverse=True)
        sums = np.zeros((len(names), 4), np.int64)
        np.add.at(sums, at, counts)
        write_table(folder, f"D{level}-{shard}", names, sums)
        return pd.DataFrame(rows, columns=["kind", "level", "shard", "columns", "counts"])
    columns, counts = _grouped(columns, counts[:, 0])
    write_table(folder, f"{'P' if kind == 'part' else 'L'}{level}-{shard}", _key(columns), counts[:, None])
    rows.append(_facts("gram", level, shard, counts))
    if kind == "part":
        names, sums = _totals(columns[:-1], counts)
        rows.extend(_blocks("context", level, [names], sums, _shard(names, layout.shards)))
        lower(columns, counts)
    elif level == 2:
        by_spread(2, columns, counts)
        lower(columns, counts)
    elif level > 2:
        many = by_spread(level, columns, counts)
        suffix, left = _grouped([c[~many] for c in columns[1:]], np.ones(int((~many).sum()), np.int64))
        if len(left):  # the inner words of these are their context, so all is here
            write_table(folder, f"L{level - 1}-{shard}", _key(suffix), left[:, None])
            rows.append(_facts("gram", level - 1, shard, left))
            names, sums = _totals(suffix[:-1], left)
            write_table(folder, f"C{level - 1}-{shard}", names, sums)
            lower(suffix, left)
        if many.any():
            suffix, left = _grouped([c[many] for c in columns[1:]], np.ones(int(many.sum()), np.int64))
            rows.extend(_blocks("part", level - 1, suffix, left, _shard(_key(suffix), layout.shards)))
    return pd.DataFrame(rows, columns=["kind", "level", "shard", "columns", "counts"])


@dataclass
class KneserNey:
    """Where the arrays of a model lie, and its few global numbers."""

    folder: str
    layout: Layout
    numbers: Words
    tokens: int  # N of the training texts
    words: int  # V, distinct tokens
    discounts: dict[int, list[float]]  # level -> D1, D2, D3+
    lowest: list[float]  # level 1: total, words seen once, twice, more often
    _open: dict = field(default_factory=dict, repr=False)

    @property
    def order(self) -> int:
        return self.layout.order

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def _lookup(self, name: str, keys: np.ndarray, shard: np.ndarray, width: int = 1) -> np.ndarray:
        """Rows of values for sorted keys; 0 where a key is missing."""
        order = np.argsort(shard.astype(np.uint16 if self.layout.shards <= 1 << 16 else np.uint32), kind="stable")
        out = np.zeros((len(keys), width))
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            file = f"{name}-{shard[order[a]]}"
            if file not in self._open:
                self._open[file] = map_table(self.folder, file)
            if self._open[file] is not None:
                at = order[a:b]
                out[at] = self._open[file].find(keys[at])
        return out

    def _spread_lookup(self, one: str, many: str, keys: np.ndarray, shard: np.ndarray, spread: np.ndarray, width: int) -> np.ndarray:
        """Values from file ``one`` by shard, or ``many`` by hash where inner words are dealt over shards."""
        out, several = np.zeros((len(keys), width)), spread > 1
        out[~several] = self._lookup(one, keys[~several], shard[~several], width)
        out[several] = self._lookup(many, keys[several], _shard(keys[several], self.layout.shards), width)
        return out

    def _freed(self, level: int, seen):
        """What discounting takes from n-grams of contexts, by how many were seen once, twice, more often."""
        return seen[0] * self.discounts[level][0] + seen[1] * self.discounts[level][1] + seen[2] * self.discounts[level][2]

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """Probability of the last of ``order`` columns after the ones before it."""
        p = np.full(len(columns[-1]), 1.0 / (self.words + 1))
        for level in range(1, self.order + 1):
            part = columns[self.order - level :]
            keys = _key(part)
            distinct, first, back = _distinct(keys)
            grams = [c[first] for c in part]
            if level == 1:
                total, freed = (np.full(len(distinct), x) for x in (self.lowest[0], self._freed(1, self.lowest[1:])))
                count = self._lookup("L1", distinct, _shard(grams[0], self.layout.shards))[:, 0]
            else:
                inner = self.layout.inner(level, grams)
                spread = self.layout.spread(inner)
                plain = self.layout.shard(inner, np.ones(len(spread), np.int64), grams[0], grams[-1])
                names, at, of = _distinct(_key(grams[:-1]))
                stats = self._spread_lookup(f"C{level}", f"D{level}", names, plain[at], spread[at], 4)
                total, freed = stats[:, 0][of], self._freed(level, stats.T[1:])[of]
                if self.layout.top(level):
                    count = self._lookup(f"L{level}", distinct, self.layout.shard(inner, spread, grams[0], grams[-1]))[:, 0]
                else:
                    count = self._spread_lookup(f"L{level}", f"P{level}", distinct, plain, spread, 1)[:, 0]
            d = np.array([0.0, *self.discounts[level]])
            kept = np.maximum(count - d[np.minimum(count, 3).astype(np.int64)], 0)
            known = total > 0  # after contexts that are not, the shorter one's share is kept
            safe = np.where(known, total, 1)
            p = np.where(known, kept / safe, 0)[back] + np.where(known, freed / safe, 1)[back] * p
        return p


def _discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """D1, D2, D3+ by the counts of counts; where these are too few, 0.5, 1 and 1.5."""
    if min(n1, n2, n3, n4) <= 0:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1)]


def train(docs: DataFrame, order: int = 2, training=in_training) -> KneserNey:
    """Count the documents (doc_id, text) that ``training(doc_id)`` picks and store the model."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = scratch_path(spark, "language-model")
    texts = docs.select("doc_id", "text")
    numbers = Words(folder, max(4, 1 << max(0, texts.rdd.getNumPartitions() - 1).bit_length()))

    def counted(count) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                held, size = [], 0
                for batch in batches:
                    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                        part = batch.slice(at, ROWS_AT_ONCE)
                        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                            if training(doc_id):
                                held.append(token_sequence(text, order))
                                size += len(held[-1])
                        if size >= COUNT_TOKENS:
                            yield from count(held)
                            held, size = [], 0
                if held:
                    yield from count(held)

            yield from _batches(rows(), _ARROW)

        return texts.mapInArrow(run, _BLOCK)

    most, none = max(SHARD_TOKENS // 2, 1), np.zeros(7, np.int64)
    facts: dict[tuple[str, int], np.ndarray] = {}

    def merged(todo: DataFrame, merge, scratch: Scratch) -> DataFrame:
        """One round: a shard's blocks merged by one task, the facts (seven numbers a shard) added up."""
        done = scratch.store(todo.groupBy("kind", "level", "shard").applyInPandas(merge, _BLOCK), "lm-parts")
        for r in done.filter(F.col("kind").startswith("facts")).select("kind", "level", "counts").toLocalIterator():
            key = (r["kind"], r["level"])
            facts[key] = facts.get(key, 0) + np.frombuffer(r["counts"], "<i8")
        return done.filter(~F.col("kind").startswith("facts"))

    with Scratch(spark) as scratch:
        often = merged(counted(lambda held: _count_words(held, order, numbers.shards)),
                       lambda pdf: _merge_words(pdf, numbers, order, most), scratch)
        raw = facts.get(("facts-raw", 0), none)
        words, counts = [np.array([], "<u8")], [np.array([], "<i8")]
        for r in often.select("columns", "counts").toLocalIterator():  # words of over half a shard: at most twice as many as shards
            words.append(np.frombuffer(r["columns"], "<u8"))
            counts.append(np.frombuffer(r["counts"], "<i8"))
        words, counts = np.concatenate(words), np.concatenate(counts)
        by_word, shards = np.argsort(words), max(4, -(-int(raw[1]) // SHARD_TOKENS))
        layout = Layout(order, shards, words[by_word], np.minimum(-(-counts[by_word] // most), shards))
        todo = counted(lambda held: _count_grams(held, numbers, layout))
        held = [merged(todo, lambda pdf: _merge(pdf, folder, layout), scratch)]
        # the longest n-grams first, then all that adds to the shorter ones is known; contexts once their n-grams are done
        while kinds := {(r["kind"], r["level"]) for df in held for r in df.select("kind", "level").distinct().collect()}:
            level = max((k for kind, k in kinds if kind != "context"), default=0)
            now = F.when(F.col("kind") == "context", F.col("level") > level).otherwise(F.col("level") == level)
            todo = reduce(DataFrame.unionByName, [df.filter(now) for df in held])
            held = [df.filter(~now) for df in held] + [merged(todo, lambda pdf: _merge(pdf, folder, layout), scratch)]
    low = facts.get(("facts-gram", 1), none)
    return KneserNey(
        folder, layout, numbers, int(raw[1]), int(raw[0]),
        {k: _discounts(*map(float, facts.get(("facts-gram", k), none)[2:6])) for k in range(1, order + 1)},
        [float(low[1]), float(low[2]), float(low[3]), float(low[6])],
    )


_MODELS: dict[str, KneserNey] = {}  # the model that this worker process has open


def score(docs: DataFrame, model: KneserNey, training=in_training) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    ship_package(docs.sparkSession)
    order = model.order

    def rate(sequences: list[np.ndarray]):
        sizes = np.array([len(s) - order + 1 for s in sequences])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        held = _MODELS[model.folder]
        columns, count = held.numbers.columns(sequences, order)
        base = np.log10((count + 0.5) / (held.tokens + 0.5 * (held.words + 1)))
        full = np.log10(held.probabilities(columns))
        return sizes, np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(full, starts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _MODELS:
            _MODELS.clear()
            _MODELS[model.folder] = model
        for batch in batches:
            ids, held, size = [], [], 0
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids += part.column(0).to_pylist()
                for text in part.column(1).to_pylist():
                    held.append(token_sequence(text, order))
                    size += len(held[-1])
                if size >= SCORE_TOKENS or at + ROWS_AT_ONCE >= batch.num_rows:
                    n, known, base, full = rate(held)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, part.column(0).type), pa.array([not training(i) for i in ids]), pa.array(n), pa.array(known),
                         pa.array(np.full(len(ids), model.tokens)), pa.array(base), pa.array(full)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )
                    ids, held, size = [], [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per row of ``score``'s result."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
