"""Rules that hang on the order of a file's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused(events: DataFrame) -> DataFrame:
    """The definitions (path, key, pos, size) that nothing uses before the key is defined again or the file ends. events: (path, key, pos, defines, size)."""
    w = Window.partitionBy("path", "key").orderBy("pos")
    nth = F.sum(F.col("defines").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = events.withColumn("nth", nth).filter("nth > 0").groupBy("path", "key", "nth").agg(F.max_by("pos", F.col("defines")).alias("pos"), F.max_by("size", F.col("defines")).alias("size"), F.count_if(~F.col("defines")).alias("uses"))
    return runs.filter("uses = 0").select("path", "key", "pos", "size")


def inherited(parts: DataFrame, follows: Column, breaks: Column) -> DataFrame:
    """parts (path, pos, kind) where a part that follows others takes the kind of the last one before it, unless a part that breaks stands between; then unknown."""
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~follows & breaks, F.lit("")).when(~follows, F.col("kind")), ignorenulls=True).over(w)
    return parts.withColumn("kind", F.when(~follows, F.col("kind")).when(F.coalesce(last, F.lit("")) == "", "unknown").otherwise(last))


def first_of(parts: DataFrame, *by: str) -> DataFrame:
    """The first part of each group (pos, value)."""
    return parts.groupBy(*by).agg(F.min(F.struct("pos", "value")).alias("f")).select(*by, "f.pos", "f.value")


def padded(regions: DataFrame, pad: Column) -> DataFrame:
    """regions (path, pos, kind, s, e) without padding: it goes to the region after it, at the very end to the one before."""
    marked = regions.withColumn("pad", pad)
    w = Window.partitionBy("path").orderBy("pos")
    real = F.when(~F.col("pad"), F.col("pos"))
    next_ = F.first(real, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    last = F.last(real, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    owned = marked.withColumn("owner", F.coalesce(next_, last)).filter("owner IS NOT NULL")
    return owned.groupBy("path", F.col("owner").alias("pos")).agg(F.max(F.when(~F.col("pad"), F.col("kind"))).alias("kind"), F.min("s").alias("s"), F.max("e").alias("e"))


def tiled(chunks: DataFrame) -> DataFrame:
    """(path, whole): whether chunks (path, s, e) follow each other from 0 without gap or overlap."""
    w = Window.partitionBy("path").orderBy("s", "e")
    return chunks.withColumn("expected", F.coalesce(F.lag("e").over(w), F.lit(0))).groupBy("path").agg(F.bool_and(F.col("s") == F.col("expected")).alias("whole"))


def clashing(edits: DataFrame) -> DataFrame:
    """The edits (path, s, e) that begin before an earlier one ends."""
    w = Window.partitionBy("path").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("reach", F.max("e").over(w)).filter(F.col("s") < F.col("reach")).select("path", "s", "e")


def ordered_by(parts: DataFrame, *by: str) -> DataFrame:
    """parts with nth: their place in the file by record, number, tag or sequence; the last of `by` decides ties."""
    return parts.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy(*by)))
