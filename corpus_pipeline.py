"""A corpus pipeline: language, repeated lines, near-duplicates, mixture, tokens.

All stages take an empty table, nulls in any column, empty and very long texts,
repeated rows and further columns, which pass through but for the last stage:

* language_id drops null texts and texts without a letter; a null doc_id, source
  or lang doesn't matter.
* line_dedup: rows with a null doc_id count as one document. Null text becomes
  the empty text.
* near_dedup: texts without words are kept; of rows with one doc_id and one text
  all stay or all go; a null doc_id counts as the smallest.
* source_mix: a null source is a source; repeated rows are documents each.
* encode: null text gives null ids, -1 pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from picmeta.llm import language_id, line_dedup, lsh_forest, pieces, source_mix
from picmeta.llm.shared import batches, cut, table


#: Percent of common shingles from which documents are near-duplicates. op10's 85 is that query's own.
NEAR = 80
#: Rows that Python gets at once in the stages whose rows are whole texts.
ROWS = 1000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    batches(spark, ROWS)
    return language_id.accepted(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that several documents share; n_chars follows the text."""
    batches(spark)
    d = line_dedup.line_dedup(docs)
    return d.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    batches(spark)
    return lsh_forest.deduplicated(docs, NEAR)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mixture of sources wants it."""
    batches(spark)
    return source_mix.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether decoding gives the text again."""
    batches(spark, ROWS)
    return pieces.round_trips(docs, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("encode", encode_stage),
]

#: Learned models and lattices have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
