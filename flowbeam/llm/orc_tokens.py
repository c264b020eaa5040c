"""Token ids of documents in ORC files, in ascending ``doc_id`` order.

Rows are range-partitioned and sorted by ``doc_id`` before encoding (the text is smaller than
its ids), so files and stripes hold disjoint, ascending id ranges: stripe statistics and row
indexes prune by range, a Bloom filter on ``doc_id`` prunes within. Ids are integers in ORC's
run-length encoding; Spark reads stripes in parallel. ``row_no`` orders rows over all files
(its upper bits number the files), so the ids before a document follow from one total per file
and a running sum within the file; only narrow columns take part in that.

The tokenizer splits at white space, and no merge or normalisation crosses it, so a text's ids
are its words' ids in order. A few megabytes of text at a time are split into words and these
numbered (in Arrow), each distinct word is looked up once, and the ids are gathered by position.
Words are encoded by the library once and remembered; letters followed by punctuation are the
letters' ids and the punctuation's. Texts that may hold special tokens are encoded whole, as all
texts are where a probe shows that words cannot be taken one by one.

Null and empty texts have only the end id. Null ids come first. Rows that repeat an id are
kept, ordered by text among themselves.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbeam.session import ship_package

END_ID = 2
#: Distinct words whose ids a worker remembers in each of two generations (about 200 bytes each).
REMEMBERED_WORDS = 250_000
#: Bytes of text encoded at a time.
TEXT_BYTES = 3 << 20
#: Bytes of input for each file, beyond as many files as there are shuffle partitions.
FILE_BYTES = 256 << 20
#: ASCII punctuation that ends a run of letters and is one run itself (an apostrophe may not).
_TAIL = string.punctuation.replace("'", "")
#: Letters below U+0130, which stay one letter each when lower-cased (digits and the like are none).
_LETTERS = re.compile("[^\\W\\d_\u00b2\u00b3\u00b9\u00bc-\u00be\u0130-\U0010ffff]+").fullmatch


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``flat[start : start + size]`` one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class WordIds:
    """Words with their ids: places in a dict, ids one after another in one array."""

    def __init__(self, dtype: np.dtype):
        self.places: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, dtype), 0
        self.bounds = np.zeros(1 << 12, np.int64)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember new words, whose ids lie one after another in ``ids``."""
        n, used = len(self.places), self.used + len(ids)
        self.places.update(zip(words, range(n, n + len(words))))
        if used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * used)
        if n + len(words) >= len(self.bounds):
            self.bounds = np.resize(self.bounds, 2 * (n + len(words) + 1))
        self.flat[self.used : used] = ids
        self.bounds[n + 1 : n + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.used = used

    def find(self, words: list[str]) -> np.ndarray:
        """The words' places, -1 for those not known."""
        return np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many of each) of places."""
        starts = self.bounds[places]
        sizes = self.bounds[places + 1] - starts
        return gathered(self.flat, starts, sizes), sizes


class TextEncoder:
    """Ids of whole texts by a tokenizer file of the ``tokenizers`` library."""

    def __init__(self, path: str, limit: int = REMEMBERED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = limit
        self.known = WordIds(self.dtype)
        self.older = WordIds(self.dtype)  # the generation before; words in use move up
        self.ascii_words = self._ascii_word_tokenizer()
        self.by_word = self._splits_at_space()

    def _ascii_word_tokenizer(self):
        """The model behind a plain split at white space: lower-case ASCII words need no more."""
        from tokenizers import Tokenizer, pre_tokenizers

        short = Tokenizer(self.tokenizer.model)
        short.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probe = [" ".join(w for w in self.tokenizer.get_vocab() if w.isascii() and w.isalpha() and w.islower())]
        a, b = (t.encode_batch_fast(probe, add_special_tokens=False)[0].ids for t in (short, self.tokenizer))
        return short if a == b else self.tokenizer

    def _splits_at_space(self) -> bool:
        """Whether lower-cased words can be encoded one by one (the tokenizer drops white space and case)."""
        probe = ["one two", "one\n two,", "É a\tb.", "Hello World AB c", f"a{_TAIL} é{_TAIL} b"]
        lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
        return bool(self.ends.any()) and all(
            self._direct([p])[0].tolist() == np.concatenate(self._direct(p.translate(lower).replace(_TAIL, f" {_TAIL}").split())).tolist()
            for p in probe)

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Remember words that are in neither generation."""
        ascii_runs, runs, odd = {}, {}, []  # dicts as ordered sets
        tailed, stems, tails = [], [], []
        known = self.known.places
        for w in words:
            run = w.rstrip(_TAIL)
            # one run of letters, one end of word
            if not _LETTERS(run):
                odd.append(w)
                continue
            if len(run) != len(w):
                tailed.append(w)
                stems.append(run)
                tails.append(w[len(run) :])
                if run in known:
                    continue
            (ascii_runs if run.isascii() else runs)[run] = None
        self._learn_runs(list(ascii_runs), self.ascii_words)
        self._learn_runs(list(runs), self.tokenizer)
        found = self._direct(odd)
        self.known.add(odd, np.concatenate([np.empty(0, self.dtype), *found]), np.array([len(x) for x in found], np.int64))
        if tailed:
            stem_ids, stem_sizes = self.known.ids(self.known.find(stems))
            ends = {t: k for k, t in enumerate(dict.fromkeys(tails))}
            tail_ids = self._direct(list(ends))
            sizes = np.array([len(x) for x in tail_ids], np.int64)
            which = np.array([ends[t] for t in tails])
            tail_sizes = sizes[which]
            # stem, tail, stem, tail, ...
            both = np.column_stack([stem_sizes, tail_sizes]).ravel()
            of_stem = np.repeat(np.tile([True, False], len(tailed)), both)
            ids = np.empty(len(of_stem), self.dtype)
            ids[of_stem] = stem_ids
            ids[~of_stem] = gathered(np.concatenate(tail_ids), (np.cumsum(sizes) - sizes)[which], tail_sizes)
            self.known.add(tailed, ids, stem_sizes + tail_sizes)

    def _learn_runs(self, runs: list[str], tokenizer) -> None:
        """Words of letters only, many at a time; each one's last id is an end of word."""
        for at in range(0, len(runs), 1000):
            part = runs[at : at + 1000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("the tokenizer does not end every word")
            self.known.add(part, ids, np.diff(cuts, prepend=0))

    def _places(self, words: list[str]) -> np.ndarray:
        """Places of distinct words in the present generation, which learns those it lacks."""
        if len(self.known.places) > self.limit:
            self.older, self.known = self.known, WordIds(self.dtype)
        places = self.known.find(words)
        late = np.flatnonzero(places < 0)
        if len(late):
            missing = [words[k] for k in late.tolist()]
            before = self.older.find(missing)
            again = [w for w, k in zip(missing, before.tolist()) if k >= 0]
            self.known.add(again, *self.older.ids(before[before >= 0]))
            unseen = [w for w, k in zip(missing, before.tolist()) if k < 0]
            # a stem that an earlier generation knows is simply learnt again
            self._learn(unseen)
            places[late] = self.known.find(missing)
        return places

    def known_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words one after another, number of ids of each)."""
        places = self._places(words)
        return self.known.ids(places) if words else (np.empty(0, self.dtype), np.empty(0, np.int64))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); null is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        whole = np.full(len(texts), not self.by_word)
        for token in self.special:
            whole |= pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(whole), "", texts)))
        words = lists.flatten().dictionary_encode()
        # empty strings beside white space at a text's ends have no ids
        distinct = words.dictionary.to_pylist()
        real = np.array([bool(w) for w in distinct], bool)
        found, some = self.known_ids([w for w in distinct if w])
        width, sizes = self.dtype.itemsize, np.zeros(len(distinct) + 1, np.int32)
        sizes[1:][real] = some * width
        table = pa.BinaryArray.from_buffers(pa.binary(), len(distinct), [None, pa.py_buffer(np.cumsum(sizes, dtype=np.int32)), pa.py_buffer(found)])
        taken = table.take(words.indices)
        bounds = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1] // width
        ids = np.frombuffer(taken.buffers()[2] or b"", self.dtype)[: bounds[-1]] if len(taken) else np.empty(0, self.dtype)
        ends = bounds[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(taken) else np.zeros(len(texts) + 1, np.int32)
        counts = np.diff(ends).astype(np.int64)
        if whole.any():
            parts = np.split(ids, ends[1:-1])
            for k in np.flatnonzero(whole).tolist():
                parts[k] = self._direct([texts[k].as_py()])[0]
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids (``dtype``) of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


_ENCODERS: dict[str, TextEncoder] = {}  # one per worker process and file


def _encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about ``most`` bytes of text, a longer text alone."""
    sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    at = held = 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Columns of ``docs`` but ``text``, then ``n_tokens`` and ``ids``; rows and order unchanged."""
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for part in _pieces(batch, TEXT_BYTES):
                ids, counts = encoder.encode_column(part.column("text"))
                # the end id behind each text's ids
                ends = np.cumsum(counts + 1)
                values = np.full(int(ends[-1]), end_id, np.int32)
                own = np.ones(len(values), bool)
                own[ends - 1] = False
                values[own] = ids
                made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
                columns = [part.column(f.name) for f in rest] + [pa.array(counts + 1), made]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in rest] + ["n_tokens", "ids"])
        pa.default_memory_pool().release_unused()

    schema = T.StructType(list(rest)).add("n_tokens", T.LongType()).add("ids", T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(run, schema)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC files under ``path``, ascending by ``doc_id``."""
    ship_package(docs.sparkSession)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size < 1 << 60:  # larger: Spark knows no size
        parts = max(parts, -(-size // FILE_BYTES))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .withColumn("row_no", F.monotonically_increasing_id())
    )
    (
        encode_documents(ordered, tokenizer_path, end_id).write
        .option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(16 << 20))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, row_no, n_tokens, ids) of files written by ``write_tokens``."""
    return spark.read.schema("doc_id long, row_no long, n_tokens long, ids array<int>").orc(path)


def with_starts(narrow: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Adds ``start``, the number of ids before each row, to columns row_no and n_tokens.

    ``counts`` has the same two columns where they can be read more cheaply (from the files
    without their ids); the files' totals are taken from it.
    """
    part = F.shiftright("row_no", 33)
    totals = (narrow if counts is None else counts).groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("tokens"))
    # one row per file
    before = totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    inside = Window.partitionBy("part").orderBy("row_no")
    return (
        narrow.withColumn("part", part)
        .withColumn("within", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
        .join(before, "part").withColumn("start", F.col("before") + F.col("within"))
        .drop("part", "within", "before")
    )


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, row_no, n_tokens, ids_crc32), counted and summed from the ids themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            data = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_no"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "row_no", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "row_no", "ids").mapInArrow(run, "doc_id long, row_no long, n_tokens long, ids_crc32 long")
