"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from picmeta.llm import language_id, license_scan, line_dedup, lm_score, lsh_forest, merkle, pieces, quality_rules, secret_scan, source_mix, token_rollup, topk_search, variants
from picmeta.llm.shared import cut, scratch, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents"), fitted=True)


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op3."""
    return lm_score.base(op3_lm_score(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(table(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in under an old version; all are then revised to the present one; the revision is committed twice."""
    new = cut(token_rollup.counted(table(spark, sf_dir, "documents")))
    old = new.withColumns({"version": F.lit("words-0"), "n_tokens": F.col("n_tokens") + 1})
    root = f"{scratch(spark)}/rollup-{uuid.uuid4().hex}"
    token_rollup.commit(token_rollup.changes(None, old), root, "1")
    for _ in range(2):
        token_rollup.commit(token_rollup.changes(old, new), root, "2")
    return token_rollup.totals(spark, root)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def mix_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op7."""
    return source_mix.goals(op7_source_mix(spark, sf_dir))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose id is divisible by 100 are the queries, against all documents."""
    docs = table(spark, sf_dir, "documents")
    return topk_search.top_k(docs, docs.filter("doc_id % 100 = 0"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op11."""
    return secret_scan.base(op11_secret_scan(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.digest(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_pieces, op3_lm_score, op4_language_id, op5_license_scan, op6_token_rollup, op7_source_mix, op8_topk_search, op9_line_dedup, op10_lsh_forest, op11_secret_scan, op12_spelling_variants, op13_merkle_manifest, lm_base, mix_goals, secret_base)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.oracle(), "op9_line_dedup": line_dedup.ORACLE, "op10_lsh_forest": lsh_forest.ORACLE, "op12_spelling_variants": variants.ORACLE, "op13_merkle_manifest": merkle.ORACLE, "lm_base": lm_score.ORACLE, "mix_goals": source_mix.ORACLE, "secret_base": secret_scan.ORACLE}
