"""Flow documents (JSON lines of display rows) and term lookups on them."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbeam.functions.once import computed_once
from flowbeam.operators.project import from_document
from flowbeam.schema import DISPLAY_SCHEMA
from flowbeam.sinks.ledger import only_closed


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All whole documents under ``path`` as display rows (explicit schema, no inference).

    Lines that are no document, or lack a field, give no row (``split_documents`` tells which).
    Of a table with a ledger only closed batches are read.
    """
    docs = only_closed(spark.read.schema(DISPLAY_SCHEMA).json(path), path).select(*DISPLAY_SCHEMA.fieldNames())
    return docs.filter(functools.reduce(operator.and_, [F.col(c).isNotNull() for c in docs.columns]))


def read_document_text(spark: SparkSession, path: str) -> DataFrame:
    """Documents stored as raw text lines, parsed with ``from_json``."""
    return from_document(spark.read.text(path), "value")


def split_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(display rows, rejects) of JSON lines: rejects are (value, reject_reason).

    ``unreadable``: no JSON object, or a field of the wrong type. ``missing_field``: a field of
    the display schema is absent or null. Blank lines are no documents.
    """
    return split_lines(spark.read.text(path))


def split_lines(lines: DataFrame, keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """``split_documents`` of text lines (``value``), which display rows keep with ``keep_text``."""
    schema = T.StructType([*DISPLAY_SCHEMA.fields, T.StructField("_unread", T.StringType())])
    lines = lines.filter(F.trim("value") != "")
    # parsed once a line, not once for each field and filter that reads it
    parsed = computed_once(lines.select("value"), d=F.from_json("value", schema, {"columnNameOfCorruptRecord": "_unread"}))
    fields = [F.col(f"d.{c}") for c in DISPLAY_SCHEMA.fieldNames()]
    missing = functools.reduce(operator.or_, [c.isNull() for c in fields])
    reason = F.when(F.col("d").isNull() | F.col("d._unread").isNotNull(), "unreadable").when(missing, "missing_field")
    judged = parsed.withColumn("reject_reason", reason)
    kept = ["value"] if keep_text else []
    docs = judged.filter(F.col("reject_reason").isNull()).select(*kept, *fields)
    return docs, judged.filter(F.col("reject_reason").isNotNull()).select("value", "reject_reason")


def term_query(docs: DataFrame, field: str, value) -> DataFrame:
    """Documents whose ``field`` equals ``value`` (a pushed-down equality on the scan)."""
    if field not in DISPLAY_SCHEMA.fieldNames():
        raise ValueError(f"unknown document field {field!r}")
    return docs.filter(F.col(field) == F.lit(value))
