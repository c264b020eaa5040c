"""Line deduplication over whole documents, returned as keep bitmaps.

A line's key is the line stripped of space and U+0009-U+000D at both ends, with A-Z
lower-cased; lines end at ``\\n``. A key of at least ``min_chars`` code points that occurs in
several documents loses all its lines except those of the smallest ``doc_id`` that holds it.

Every step is a DataFrame function:

1. Lines become (document, position, 128-bit key hash), about 40 bytes each; no text moves.
2. Counts and smallest documents by hash come from a map-side aggregate. A hash on more than
   ``HOT_LINES`` lines is settled by that alone, so no group of the next step is larger.
3. All other hashes are range-partitioned and sorted by (hash, document, position); a window
   over each range streams by and compares every line with the first occurrence of its hash.
4. Dropped positions become 64-line words per document, then one compressed bitmap: a list of
   (``skip``, ``bits``), where ``skip`` words of only kept lines come first and bit b of ``bits``
   is 1 when line b of the next word is kept. All lines after the last word are kept.

Nulls, repeats and ties: a null or empty text is one empty line. Rows of one ``doc_id`` are one
document, each row with its own bitmap (rows are told apart by a hash of their text); a line
repeated inside its first document stays. Rows without ``doc_id`` are left whole and take no
part. An empty table gives an empty result. Other columns are never looked at, whatever their
names; ``drop_repeated_lines`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowbeam.llm.frames import Scratch

#: Lines of one hash in one window group at most; commoner ones are settled by the aggregate.
HOT_LINES = 1_000

_BLANKS = " \t\n\v\f\r"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _lines() -> Column:
    return F.split(_text(), "\n")


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased and nothing else."""
    key = F.btrim(line, F.lit(_BLANKS))
    # lower() also changes letters outside A-Z, so it serves ASCII lines only
    ascii_only = F.octet_length(key) == F.length(key)
    return F.when(ascii_only, F.lower(key)).otherwise(F.translate(key, _AZ, _AZ.lower()))


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of every line whose key is long enough."""
    rows = docs.filter(F.col("doc_id").isNotNull())
    lines = rows.select("doc_id", F.xxhash64(_text()).alias("text_hash"), F.posexplode(_lines()).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return keys.filter(F.length("key") >= min_chars).select(
        "doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def repeated_lines(lines: DataFrame, hot: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos) of lines whose hash occurs in a smaller document.

    ``hot`` gives the smallest document (``first``) of the hashes settled beforehand.
    """
    judged = lines.join(hot, ["h1", "h2"], "left")
    settled = judged.filter("doc_id > first")
    ranges = judged.filter("first is null").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    seen = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = ranges.withColumn("first", F.first("doc_id").over(seen)).filter("doc_id > first")
    columns = ["doc_id", "text_hash", "pos"]
    return settled.select(columns).unionAll(streamed.select(columns))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep) of every document, without its text.

    Identical rows share one bitmap. ``keep`` is array<struct<skip int, bits bigint>> as in the
    module's description; it is empty when every line stays.
    """
    with Scratch(docs.sparkSession) as scratch:
        lines = scratch.store(line_hashes(docs, min_chars), "lines")
        counts = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
        hot = scratch.store(counts.filter(F.col("n") > HOT_LINES).drop("n"), "hot-lines")
        bit = F.expr("shiftleft(1L, pos % 64)")
        words = (
            repeated_lines(lines, hot)
            .groupBy("doc_id", "text_hash", F.floor(F.col("pos") / 64).cast("int").alias("word"))
            .agg(F.bit_or(bit).alias("gone"))
        )
        none = F.lit(None)
        heads = docs.select("doc_id", F.xxhash64(_text()).alias("text_hash"), F.size(_lines()).cast("long").alias("n_lines"))
        parts = heads.withColumn("word", none.cast("struct<word:int,gone:bigint>")).unionByName(
            words.select("doc_id", "text_hash", none.cast("long").alias("n_lines"), F.struct("word", "gone").alias("word"))
        )
        # a null doc_id is a group of its own for each text; collect_list leaves null words out
        whole = parts.groupBy("doc_id", "text_hash").agg(
            F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_list("word")).alias("words")
        )
        before = lambda i: F.coalesce(F.get("words", i - 1)["word"], F.lit(-1))
        keep = F.transform(
            "words", lambda w, i: F.struct((w["word"] - before(i) - 1).alias("skip"), F.bitwise_not(w["gone"]).alias("bits"))
        )
        dropped = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["gone"]))
        bitmaps = whole.select("doc_id", "text_hash", "n_lines", dropped.alias("n_dropped"), keep.alias("keep"))
        return scratch.result(bitmaps, "keep-bitmaps")


def kept_text(keep: Column) -> Column:
    """The lines of ``text`` that a bitmap keeps, joined by ``\\n``; a null text gives ''."""
    all_kept = F.lit(-1).cast("long")
    unpacked = F.flatten(F.transform(keep, lambda w: F.concat(F.array_repeat(all_kept, w["skip"]), F.array(w["bits"]))))

    def pick(words: Column) -> Column:
        word = lambda i: F.coalesce(F.get(words, F.floor(i / 64).cast("int")), all_kept)
        return F.array_join(F.filter(_lines(), lambda _, i: F.getbit(word(i), i % 64) == 1), "\n")

    # as a lambda's variable the unpacked words are computed once, not once a line
    return F.when(F.size(keep) == 0, _text()).otherwise(F.transform(F.array(unpacked), pick)[0])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, n_lines, n_dropped, kept): every row of ``docs`` as a struct beside its kept text."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64(_text()).alias("text_hash"))
    found = rows.join(bitmaps.filter("n_dropped > 0").drop("n_lines"), ["doc_id", "text_hash"], "left")
    keep = F.coalesce("keep", F.array().cast(bitmaps.schema["keep"].dataType))
    return found.select(
        "row", F.size(_lines()).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept_text(keep).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with the kept lines as ``text``, in its own columns."""
    kept = apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
    return kept.select(*[F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
