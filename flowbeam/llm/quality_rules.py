"""Quality rules with thresholds learned from the data instead of fixed cutoffs.

Counts of each text become ratios; a quantile sketch of every ratio is built per (language,
source): counts of buckets that are ``GAMMA`` wide in proportion, summed map-side first. Sketches
merge by adding, so the language's and the whole corpus's sketches are made from the group's, and
the same documents give the same sketch however they are dealt over tasks. A quantile read from
one lies within 0.25 % of a value whose rank is exact; ratios up to ``LEAST`` count as 0. A group with fewer than ``min_group`` documents
takes the sketch of its language, and that in turn the corpus's. The accepted range of a ratio
is its quartiles widened by ``reach`` times the interquartile range (at least the ratio's
smallest spread, so that a constant ratio does not reject everything else). The thresholds are
joined back and documents outside any range are rejected.

A sketch has at most some 5,000 buckets a ratio, so a source with a third of all rows is
aggregated map-side like any other. A ratio equal to its bound is accepted. Null language or source is a group of its own. Null and empty texts
have no words and fail the base rule. Every input row is judged by itself; repeated rows get
the same verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbeam.llm.frames import add_columns, map_rows, stored
from flowbeam.llm.stats import SCHEMA, text_stats


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.greatest(F.col(whole), F.lit(1)), F.lit(0.0)).cast("double")


#: name, ratio, smallest spread, whether small values are suspect too
RATIOS = (
    ("symbols", lambda: _ratio("n_symbols", "word_chars"), 0.02, False),
    ("bangs", lambda: _ratio("n_bangs", "word_chars"), 0.02, False),
    ("capitals", lambda: _ratio("n_upper", "word_chars"), 0.08, False),
    ("word_length", lambda: _ratio("word_chars", "n_words"), 1.0, True),
    ("dup_lines", lambda: _ratio("n_dup_lines", "n_lines"), 0.10, False),
    ("repeats", lambda: _ratio("n_repeat_words", "n_words"), 0.06, False),
    ("top_word", lambda: _ratio("n_top", "n_words"), 0.10, False),
)
NAMES = [r[0] for r in RATIOS]
#: Width of a sketch's buckets, in proportion, and the upper end of the one that counts as 0.
GAMMA, LEAST = 1.005, 1e-8


def base_failed() -> Column:
    """Fewer than ten words, or over 20 % of the words in repeated five-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_ratios(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f"r_{name}": make() for name, make, _, _ in RATIOS})


def bucket(ratio: Column) -> Column:
    """Number of the sketch bucket that a ratio falls into."""
    return F.when(ratio <= LEAST, F.lit(0)).otherwise(F.greatest(F.ceil(F.log(ratio / LEAST) / math.log(GAMMA)), F.lit(1)).cast("int"))


def bucket_value(number: Column) -> Column:
    """The value that is within half a bucket, in proportion, of all in it."""
    return F.when(number == 0, F.lit(0.0)).otherwise(LEAST * 2 / (1 + GAMMA) * F.pow(F.lit(GAMMA), number))


def sketches(usable: DataFrame) -> DataFrame:
    """(lang, source, name, bucket, n): how many documents of a group have a ratio in a bucket."""
    every = F.explode(F.array(*(F.struct(F.lit(x).alias("name"), bucket(F.col(f"r_{x}")).alias("bucket")) for x in NAMES)))
    return usable.select("lang", "source", every.alias("b")).groupBy("lang", "source", "b.name", "b.bucket").agg(F.count("*").alias("n"))


def quartiles(counts: DataFrame, *keys: str) -> DataFrame:
    """Per group, its number of documents ``n`` and q1_<ratio>, q3_<ratio> from merged sketches."""
    merged = counts.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n")) if "source" not in keys else counts
    ratio = Window.partitionBy(*keys, "name")  # as many rows as a sketch has buckets
    ranked = merged.withColumns({
        "below": F.sum("n").over(ratio.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("n").over(ratio),
    })
    first = lambda x, q: F.min(F.when((F.col("name") == x) & (4 * F.col("below") >= q * F.col("total")), F.col("bucket")))
    return ranked.groupBy(*keys).agg(
        F.max("total").alias("n"), *(bucket_value(first(x, q)).alias(f"q{q}_{x}") for x in NAMES for q in (1, 3)))


def thresholds(ratios: DataFrame, min_group: int = 200, reach: float = 3.0) -> DataFrame:
    """(lang, source, lo_<ratio>, hi_<ratio>): the accepted ranges of every group in ``ratios``.

    ``ratios`` has lang, source, n_words, n_repeat_words and the r_* columns; documents that
    fail the base rule do not shape the thresholds.
    """
    counts = stored(sketches(ratios.filter(~base_failed())), "rule-sketches")
    values = ["n", *(f"q{q}_{x}" for x in NAMES for q in (1, 3))]
    group = quartiles(counts, "lang", "source")
    by_lang = quartiles(counts, "lang").select(F.col("lang").alias("lang_"), F.struct(*values).alias("by_lang"))
    overall = quartiles(counts).select(F.struct(*values).alias("overall"))  # one row
    every = ratios.select("lang", "source").distinct()
    pick = (
        every.alias("e")
        .join(group.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.struct(*values).alias("own")),
              F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
        .join(by_lang, F.col("lang").eqNullSafe(F.col("lang_")), "left")
        .join(F.broadcast(overall), F.lit(True), "left")
        .withColumn(
            "sketch",
            F.when(F.col("own.n") >= min_group, F.col("own"))
            .when(F.col("by_lang.n") >= min_group, F.col("by_lang"))
            .otherwise(F.col("overall")),
        )
    )
    out = [F.col("lang"), F.col("source"), F.col("sketch.n").alias("n_group")]
    for name, _, spread, low in RATIOS:
        q1, q3 = (F.col(f"sketch.q{q}_{name}") for q in (1, 3))
        margin = reach * F.greatest(q3 - q1, F.lit(spread))
        out.append((q1 - margin if low else F.lit(None).cast("double")).alias(f"lo_{name}"))
        out.append((q3 + margin).alias(f"hi_{name}"))
    return pick.select(*out)


def verdict() -> Column:
    """True when no ratio lies outside its range (a missing bound rejects nothing)."""
    fine = ~base_failed()
    for name in NAMES:
        r = F.col(f"r_{name}")
        fine = fine & F.coalesce(r <= F.col(f"hi_{name}"), F.lit(True)) & F.coalesce(r >= F.col(f"lo_{name}"), F.lit(True))
    return fine


def _judged(ratios: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.withColumnRenamed("lang", "l_").withColumnRenamed("source", "s_")
    return ratios.join(
        limits, F.col("lang").eqNullSafe(F.col("l_")) & F.col("source").eqNullSafe(F.col("s_")), "left"
    ).withColumns({"base_failed": base_failed(), "kept": verdict()})


def _kernel():
    return lambda doc_id, lang, source, text: (doc_id, lang, source, *text_stats(text))


def judge_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``. ``options``: see thresholds()."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    stats = map_rows(docs, ["doc_id", "lang", "source", "text"], _kernel, f"doc_id {kind}, lang string, source string, {SCHEMA}")
    ratios = stored(with_ratios(stats), "rule-ratios")
    limits = stored(thresholds(ratios, **options), "rule-limits")
    return _judged(ratios, limits)


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, all their columns unchanged.

    The texts are counted twice (once for the thresholds, once for the filter), which costs
    less than shuffling them to join a verdict by id, and judges repeated ids row by row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    stats = map_rows(docs, ["doc_id", "lang", "source", "text"], _kernel, f"doc_id {kind}, lang string, source string, {SCHEMA}")
    limits = stored(thresholds(stored(with_ratios(stats.drop("doc_id")), "rule-ratios"), **options), "rule-limits")
    counted = add_columns(docs, "text", lambda: text_stats, SCHEMA)
    ratios = with_ratios(counted.withColumns({"lang": F.col("row.lang"), "source": F.col("row.source")}))
    return _judged(ratios, limits).filter("kept").select("row.*")
