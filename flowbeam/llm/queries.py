"""The operators of this subpackage as registered queries over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbeam.llm import (
    decontam,
    kn_lm,
    license_scan,
    line_dedup,
    mixing,
    near_dedup,
    orc_tokens,
    periodic,
    pii_crf,
    quality_rules,
    rule_quality,
    secrets,
    whitening,
)
from flowbeam.session import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kn_lm.score(docs, kn_lm.train(docs, order=3))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_crf.find_personal_data(docs, pii_crf.train_crf(docs))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_quality.score_quality(docs, rule_quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    orc_tokens.write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZER)
    tokens = orc_tokens.read_tokens(spark, path)
    return orc_tokens.with_starts(orc_tokens.token_digests(tokens), tokens.select("row_no", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit_whitening(vectors))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; in texts that the hash of the doc_id picks, a tail repeats its first words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        first = (g % n).cast("int")
        period = (1 + F.floor((n - first) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i >= first, first + (i - first) % period).otherwise(i)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")

    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    # as a lambda's variable the words are split once, not once a word
    tail = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(tail, F.col("text"))).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", periodic.longest_run(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(periodic.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secrets, op2_decontamination, op3_mixing, op4_quality_rules, op5_near_duplicates,
        op6_language_model, op7_personal_data, op8_quality_classifier, op9_licenses, op10_token_files,
        op11_line_dedup, op12_whitening, op13_periodic_runs,
    )
}

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _five_word_sets(table_: str, key: str) -> str:
    """Distinct five-word shingles of each text; fewer words are one shingle."""
    return f"""
select distinct {key}, unnest(case
    when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), i -> array_to_string(ws[i:i + 4], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh
from (select {key}, regexp_extract_all(
    translate(text, '{_AZ}', '{_AZ.lower()}'), '[^\\x20\\x09-\\x0D]+') as ws from {table_})"""


ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
with d as ({_five_word_sets('documents', 'doc_id')}),
     q as ({_five_word_sets('benchmark', 'item_id')}),
     n as (select item_id, count(*) as n_item from q group by 1),
     c as (select doc_id, item_id, count(*) as n_common from d join q using (sh) group by 1, 2)
select doc_id, item_id, n_item, n_common from c join n using (item_id) where n_common >= 0.8 * n_item""",
    "op11_line_dedup": f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
     k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_AZ}', '{_AZ.lower()}') as key from l),
     f as (select key, min(doc_id) as first from k where length(key) >= 10 group by key),
     j as (select k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first, false) as gone from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by doc_id""",
}
