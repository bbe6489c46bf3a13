"""Facts in texts: ordered classification, tiers, merging over a batch, removal and read-back.

All of it is built-in expressions: the scan reads only the columns named, and
the aggregations combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from picmeta.operators import audit

#: Ordered: key -> (group, tier, pattern). Fixed values of this test bed.
RULES = {
    "email": ("who", "red", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    "ipv4": ("device", "amber", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    "token": ("hidden", "red", r"token = \"[^\"]*\""),
    "license": ("technical", "green", r"License"),
}
TIERS = ("red", "amber", "green")


def rank(tier: Column) -> Column:
    return F.when(tier == "red", 0).when(tier == "amber", 1).otherwise(2)


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, grp, tier, pos, value): every match of every rule; pos counts from 1 within a document and key."""
    every = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(g).alias("grp"), F.lit(t).alias("tier"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("found")) for k, (g, t, p) in RULES.items()))
    one = F.explode(F.filter(every, lambda x: F.size(x["found"]) > 0))  # most documents have none
    many = docs.select("doc_id", "source", one.alias("r")).select("doc_id", "source", "r.*")
    return many.select("doc_id", "source", "key", "grp", "tier", F.posexplode("found").alias("at", "value")).select("doc_id", "source", "key", "grp", "tier", (F.col("at") + 1).cast("long").alias("pos"), "value")


def item_ids(docs: DataFrame) -> DataFrame:
    """Ids of the facts: the key, with a suffix from the second on."""
    return facts(docs).select("doc_id", "pos", "value", "grp", "tier", F.when(F.col("pos") == 1, F.col("key")).otherwise(F.concat_ws(":", "key", F.col("pos").cast("string"))).alias("id"))


def privacy_word(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """clean, minimal, public or custom for each document by the tiers of its facts."""
    t = F.col("text") if text is None else text
    has = {tier: F.lit(False) for tier in TIERS}
    for _, tier, p in RULES.values():
        has[tier] = has[tier] | F.coalesce(t.rlike(p), F.lit(False))
    return docs.select("doc_id", F.when(has["red"], "custom").when(has["amber"], "public").when(has["green"], "minimal").otherwise("clean").alias("word"))


def strictest(docs: DataFrame) -> DataFrame:
    return facts(docs).groupBy("source").agg(F.min_by("tier", rank(F.col("tier"))).alias("tier"), F.count("*").alias("n"))


def merged(docs: DataFrame) -> DataFrame:
    """A row per key over the whole batch."""
    return facts(docs).groupBy("key").agg(F.count("*").alias("n_facts"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("value").alias("n_values"), F.min_by("tier", rank(F.col("tier"))).alias("tier"))


def scrubbed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without the red facts."""
    t = F.col("text")
    for _, tier, p in RULES.values():
        if tier == "red":
            t = F.regexp_replace(t, p, "")
    return docs.select("doc_id", t.alias("text"))


def planted(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id): the planted texts, of any length and number, that documents hold."""
    files = docs.select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return audit.found(files, items.select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle")), ("UTF-8",)).select(F.col("needle_id").alias("item_id"), F.col("path").alias("doc_id"))
