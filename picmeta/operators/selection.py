"""What is removed, what stays, and what a read-back shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def defaults(rows: DataFrame, own: tuple[str, ...] = (), kept_for: tuple[str, ...] = ()) -> DataFrame:
    """The red keys, without those of `own` while a key of `kept_for` is amber. rows: (key, tier)."""
    holds = rows.agg(F.coalesce(F.bool_or(F.col("key").isin(*kept_for) & (F.col("tier") == "amber")), F.lit(False)).alias("holds")) if kept_for else None
    red = rows.filter(F.col("tier") == "red")
    if holds is None:
        return red.select("key")
    return red.join(F.broadcast(holds)).filter(~(F.col("holds") & F.col("key").isin(*own))).select("key")  # one row


def removals(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """The items (path, id, key, ...) whose key is chosen."""
    return items.join(chosen.select("key").distinct(), "key", "left_semi")


def unknown(asked: DataFrame, items: DataFrame) -> DataFrame:
    """The (path, id) asked for that no file holds."""
    return asked.select("path", "id").join(items, ["path", "id"], "left_anti")


def coupled(chosen: DataFrame, couples: DataFrame, hops: int = 2) -> DataFrame:
    """chosen (path, id) and what goes with it: couples (path, id, other) are followed up to `hops` times."""
    found = edge = chosen.select("path", "id").distinct()
    for _ in range(hops):
        edge = edge.join(couples, ["path", "id"]).select("path", F.col("other").alias("id")).distinct().join(found, ["path", "id"], "left_anti")
        found = found.unionByName(edge)
    return found


def surviving(parts: DataFrame, dropped: DataFrame, replaced: DataFrame) -> DataFrame:
    """parts (path, part, structural, content) that stay, with their content or what replaces it; structure always stays."""
    gone = dropped.select("path", "part", F.lit(True).alias("gone")).distinct()
    new = replaced.select("path", "part", F.col("content").alias("new"))
    return parts.join(gone, ["path", "part"], "left").filter(F.col("structural") | F.col("gone").isNull()).join(new, ["path", "part"], "left").select("path", "part", F.coalesce("new", "content").alias("content"))


def lost(items: DataFrame, removed: DataFrame, after: DataFrame) -> DataFrame:
    """(path, id) that were to stay and aren't there after."""
    return items.select("path", "id").join(removed, ["path", "id"], "left_anti").join(after, ["path", "id"], "left_anti")


def extra(items: DataFrame, removed: DataFrame, after: DataFrame) -> DataFrame:
    """(path, id) that are there after and were not before, or were to go."""
    now = after.select("path", "id")
    return now.join(items, ["path", "id"], "left_anti").unionByName(now.join(removed, ["path", "id"], "left_semi")).distinct()


def selections(items: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """(selection, path, id): red, red and amber without `own`, red and amber, and all."""
    which = F.array_compact(F.array(F.when(F.col("tier") == "red", "red"), F.when((F.col("tier") != "green") & ~F.col("key").isin(*own), "red-amber-own"), F.when(F.col("tier") != "green", "red-amber"), F.lit("all")))
    return items.select(F.explode(which).alias("selection"), "path", "id")


def buildable(keys: DataFrame, never: tuple[str, ...] = ("makernote", "thumbnail")) -> DataFrame:
    """The keys of which a new block can be made."""
    return keys.filter(~F.col("key").isin(*never))
