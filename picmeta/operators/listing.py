"""Lists of a file's details: ids, caps, folds, counts and orders.

Windows run per file (path) and id, so a task holds one file's rows of an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from picmeta.functions.text import first_few, whole

WARNINGS = 40
DISTINCT = 24
DETAILED = 4


def suffixed(items: DataFrame) -> DataFrame:
    """items (path, pos, key) with id: the key, then key:2, key:3 and so on; a suffix that is a key of the file itself is left out. Other columns pass through, but for one named id."""
    nth = F.row_number().over(Window.partitionBy("path", "key").orderBy("pos"))
    own = items.select("path", F.col("key").alias("taken")).filter(F.col("taken").rlike(r":[1-9]\d*$")).distinct()
    skips = own.withColumn("key", F.regexp_extract("taken", r"^(.*):(\d+)$", 1)).withColumn("n", F.regexp_extract("taken", r"^(.*):(\d+)$", 2).try_cast("int")).filter("n >= 2").groupBy("path", "key").agg(F.sort_array(F.collect_set("n")).alias("__skips"))
    numbered = items.drop("id").withColumn("__nth", nth).join(skips, ["path", "key"], "left")
    moved = F.aggregate(F.coalesce("__skips", F.array().cast("array<int>")), F.col("__nth"), lambda n, x: F.when(x <= n, n + 1).otherwise(n))
    return numbered.withColumn("id", F.when(F.col("__nth") == 1, F.col("key")).otherwise(F.concat_ws(":", "key", moved.cast("string")))).drop("__nth", "__skips")


def capped(items: DataFrame, limit: int = DISTINCT, overflow: str = "more") -> DataFrame:
    """items (path, pos, key) with id: the key for the first `limit` distinct keys of a file in order of their first place, then overflow."""
    firsts = items.groupBy("path", "key").agg(F.min("pos").alias("first"))
    rank = firsts.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("first", "key"))).select("path", "key", "r")
    return items.join(rank, ["path", "key"]).withColumn("id", F.when(F.col("r") <= limit, F.col("key")).otherwise(overflow)).drop("r")


def folded(items: DataFrame, size: str, k: int = DETAILED) -> DataFrame:
    """(path, pos, n, size): the first k rows of each path as they are, the rest as one row at the end (pos null)."""
    nth = items.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("pos")))
    some = nth.filter(F.col("nth") <= k).select("path", "pos", F.lit(1).cast("long").alias("n"), F.col(size).alias("size"))
    rest = nth.filter(F.col("nth") > k).groupBy("path").agg(F.count("*").alias("n"), F.sum(size).alias("size")).select("path", F.lit(None).cast("long").alias("pos"), "n", "size")
    return some.unionByName(rest)


def warned(warnings: DataFrame, most: int = WARNINGS) -> DataFrame:
    """(path, nth, text): the first `most` distinct texts of a file, then one that counts what came after them; of that, repeats of texts beyond the first `most` count each."""
    firsts = warnings.groupBy("path", "text").agg(F.min("pos").alias("first"))
    rank = firsts.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("first", "text")))
    shown = rank.filter(F.col("nth") <= most).select("path", "nth", "text")
    more = warnings.join(rank.filter(F.col("nth") > most).select("path", "text"), ["path", "text"]).groupBy("path").agg(F.count("*").alias("n"))
    last = F.concat(F.lit("There were "), F.col("n").cast("string"), F.lit(" more problems with this file."))
    return shown.unionByName(more.select("path", F.lit(most + 1).alias("nth"), last.alias("text")))


def grouped(items: DataFrame, most: int = 3) -> DataFrame:
    """(path, key, n, value): the details of one key together, with their first distinct values in order."""
    own = items.groupBy("path", "key").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))
    return own.select("path", "key", "n", first_few(F.col("values"), most).alias("value"))


def last_wins(copies: DataFrame) -> DataFrame:
    """(path, key, name, value): of copies with one name, the last."""
    return copies.groupBy("path", "key", "name").agg(F.max_by("value", "pos").alias("value"))


def tier_counts(items: DataFrame, tiers: tuple[str, ...] = ("red", "amber", "green")) -> DataFrame:
    """(path, counts): '3 red, 1 green'."""
    n = items.groupBy("path").agg(*(F.count_if(F.col("tier") == t).alias(t) for t in tiers))
    return n.select("path", F.concat_ws(", ", *(F.when(F.col(t) > 0, F.concat(whole(F.col(t)), F.lit(f" {t}"))) for t in tiers)).alias("counts"))


def privacy(items: DataFrame, files: DataFrame) -> DataFrame:
    """(path, word): custom with a red detail, public with an amber one, minimal with others, clean without any."""
    own = items.groupBy("path").agg(F.bool_or(F.col("tier") == "red").alias("red"), F.bool_or(F.col("tier") == "amber").alias("amber"))
    return files.select("path").join(own, "path", "left").select("path", F.when(F.col("red").isNull(), "clean").when(F.col("red"), "custom").when(F.col("amber"), "public").otherwise("minimal").alias("word"))


def merged(items: DataFrame) -> DataFrame:
    """A row per key over the whole batch: files, distinct values, strictest tier, and group, label and value of the first in (path, pos)."""
    by_value = items.groupBy("key", "value").agg(F.count("*").alias("n"), F.min(F.struct("path", "pos", "grp", "label", "value")).alias("first"), F.min("tier_rank").alias("tier_rank"))
    rows = by_value.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("n_values"), F.min("first").alias("f"), F.min("tier_rank").alias("tier_rank"))
    return rows.select("key", "n", "n_values", "tier_rank", F.col("f.grp").alias("grp"), F.col("f.label").alias("label"), F.col("f.value").alias("value"))


def ordered(items: DataFrame, name: str, *by: str | Column) -> DataFrame:
    """items with their place (from 1) within the file in an order; ties by pos."""
    return items.withColumn(name, F.row_number().over(Window.partitionBy("path").orderBy(*by, "pos")))
