"""The operators applied to the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from picmeta.operators import intervals, queries_chunks, queries_folds, queries_listing, queries_markup, queries_more, queries_parts, queries_splices, queries_tiff, text_ops


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_table(spark, sf_dir, "documents"))


def scrub_readback(docs: DataFrame) -> DataFrame:
    return text_ops.privacy_word(text_ops.scrubbed(docs)).groupBy("word").agg(F.count("*").alias("n"))


def scrub_digest(docs: DataFrame) -> DataFrame:
    return text_ops.scrubbed(docs).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def canary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_ops.planted(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_timestamp("ts")
    e = _table(spark, sf_dir, "events").select("user_id", s.alias("s"), (s + F.floor(F.col("value") * 400)).alias("e"))
    return intervals.merge(e, "user_id")


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))
    return intervals.offsets(li, "l_orderkey", "l_linenumber", "size")


def unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id").join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<!--.*?-->"), F.lit(0))).alias("value"))


def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "-"), "^-+|-+$", "").alias("slug"))


_RULE_SQL = " UNION ALL ".join(f"SELECT doc_id, source, '{k}' AS key, '{g}' AS grp, '{t}' AS tier, regexp_extract_all(text, '{p}') AS found FROM documents" for k, (g, t, p) in text_ops.RULES.items())
_FACTS = f"f AS (SELECT doc_id, source, key, grp, tier, unnest(range(1, len(found) + 1)) AS pos, unnest(found) AS value FROM ({_RULE_SQL}))"
_STRICT = "arg_min(tier, CASE tier WHEN 'red' THEN 0 WHEN 'amber' THEN 1 ELSE 2 END) AS tier"


def _has(tier: str, text: str) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches({text}, '{p}'), FALSE)" for _, t, p in text_ops.RULES.values() if t == tier) + ")"


def _word(text: str) -> str:
    return f"CASE WHEN {_has('red', text)} THEN 'custom' WHEN {_has('amber', text)} THEN 'public' WHEN {_has('green', text)} THEN 'minimal' ELSE 'clean' END"


_SCRUB = "text"
for _, _tier, _p in text_ops.RULES.values():
    if _tier == "red":
        _SCRUB = f"regexp_replace({_SCRUB}, '{_p}', '', 'g')"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "doc_items": (_docs(text_ops.item_ids), f"WITH {_FACTS} SELECT doc_id, pos, value, grp, tier, CASE WHEN pos = 1 THEN key ELSE concat(key, ':', pos) END AS id FROM f"),
    "doc_privacy_word": (_docs(text_ops.privacy_word), f"SELECT doc_id, {_word('text')} AS word FROM documents"),
    "strictest_tier_by_source": (_docs(text_ops.strictest), f"WITH {_FACTS} SELECT source, {_STRICT}, count(*) AS n FROM f GROUP BY source"),
    "merge_rows_batch": (_docs(text_ops.merged), f"WITH {_FACTS} SELECT key, count(*) AS n_facts, count(DISTINCT doc_id) AS n_docs, count(DISTINCT value) AS n_values, {_STRICT} FROM f GROUP BY key"),
    "scrub_text": (_docs(scrub_digest), f"SELECT doc_id, md5({_SCRUB}) AS digest FROM documents"),
    "scrub_readback": (_docs(scrub_readback), f"SELECT {_word('t')} AS word, count(*) AS n FROM (SELECT {_SCRUB} AS t FROM documents) GROUP BY 1"),
    "canary_scan": (canary_scan, "SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"),
    "merge_ranges": (
        merge_ranges,
        "WITH r AS (SELECT user_id, epoch(ts)::BIGINT AS s, epoch(ts)::BIGINT + floor(value * 400)::BIGINT AS e FROM (SELECT user_id, date_trunc('second', ts) AS ts, value FROM events)), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE s < e), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, island",
    ),
    "running_offsets": (
        running_offsets,
        "SELECT l_orderkey, l_linenumber, (sum(size) OVER w - size)::BIGINT AS s, (sum(size) OVER w)::BIGINT AS e FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) AS size FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)",
    ),
    "unknown_ids": (unknown_ids, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "html_comments_hidden": (html_comments, "SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->')) AS value FROM pages"),
    "slug_ids": (slug_ids, "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages"),
}
QUERIES |= queries_chunks.QUERIES | queries_splices.QUERIES | queries_folds.QUERIES | queries_tiff.QUERIES | queries_markup.QUERIES | queries_listing.QUERIES | queries_more.QUERIES | queries_parts.QUERIES
