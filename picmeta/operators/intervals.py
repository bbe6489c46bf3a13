"""Half-open ranges [s, e) of a key: merging, difference, gaps, overlap, offsets.

Windows run per key and part of the number line (`part`), so that a key with a
large share of the rows is spread over many tasks; what earlier parts contribute
is one row per key and part (`before`, `after`). Ranges without length are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from picmeta.operators.shared import kept

WIDTH = 1 << 18


def part(at: str | Column, width: int = WIDTH) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / width)


def _carried(df: DataFrame, key: str, order: list[Column], value: str, name: str, agg, combine, down: bool) -> DataFrame:
    df = kept(df)  # read twice
    side = (Window.unboundedPreceding, -1) if not down else (1, Window.unboundedFollowing)
    parts = df.groupBy(key, "part").agg(agg(value).alias("v"))
    carry = parts.select(F.col(key).alias("__k"), F.col("part").alias("__p"), agg("v").over(Window.partitionBy(key).orderBy("part").rowsBetween(*side)).alias("carry"))
    local = df.withColumn("local", agg(value).over(Window.partitionBy(key, "part").orderBy(*order).rowsBetween(*side)))
    both = local.join(carry, F.col(key).eqNullSafe(F.col("__k")) & (F.col("part") == F.col("__p")))
    return both.withColumn(name, combine("local", "carry")).drop("local", "carry", "__k", "__p")


def before(df: DataFrame, key: str, order: list[Column], value: str, name: str, agg=F.max) -> DataFrame:
    """df (with part) and name: agg (max, min or sum) of value over the key's earlier rows; null for the first (0 for sums)."""
    combine = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if agg is F.sum else F.greatest if agg is F.max else F.least
    return _carried(df, key, order, value, name, agg, lambda a, b: combine(F.col(a), F.col(b)), False)


def after(df: DataFrame, key: str, order: list[Column], value: str, name: str) -> DataFrame:
    """The same for the least value of the key's later rows."""
    return _carried(df, key, order, value, name, F.min, lambda a, b: F.least(F.col(a), F.col(b)), True)


def merge(ranges: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(key, s, e): touching and overlapping ranges become one."""
    own = ranges.filter("s < e").select(key, "s", "e", part("s", width).alias("part"))
    order = [F.col("s"), F.col("e")]
    reached = before(own, key, order, "e", "reach")
    begun = reached.withColumn("begin", F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), F.col("s")))
    island = before(begun, key, order, "begin", "earlier").withColumn("island", F.coalesce("begin", "earlier"))
    return island.groupBy(key, "island").agg(F.max("e").alias("e")).select(key, F.col("island").alias("s"), "e")


def subtract(ranges: DataFrame, minus: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(key, s, e): the parts of ranges that minus doesn't cover, merged. A sweep over both lists' ends."""
    ends = []
    for df, name in ((merge(ranges, key, width), "a"), (merge(minus, key, width), "m")):
        both = F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x")
        ends.append(df.select(key, both).select(key, "x.at", *(F.when(F.lit(name == n), F.col("x.d")).otherwise(0).alias(n) for n in "am")))
    at = ends[0].unionByName(ends[1]).groupBy(key, "at").agg(F.sum("a").alias("a"), F.sum("m").alias("m")).withColumn("part", part("at", width))
    order = [F.col("at")]
    inside = before(before(at, key, order, "a", "open_a", F.sum), key, order, "m", "open_m", F.sum)
    pieces = after(inside, key, order, "at", "next").filter((F.col("open_a") + F.col("a") > 0) & (F.col("open_m") + F.col("m") == 0) & F.col("next").isNotNull())
    return merge(pieces.select(key, F.col("at").alias("s"), F.col("next").alias("e")), key, width)


def gaps(ranges: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(key, s, e): what no range covers between the first start and the last end of the key."""
    own = ranges.filter("s < e")
    return subtract(own.groupBy(key).agg(F.min("s").alias("s"), F.max("e").alias("e")), own, key, width)


def covered(ranges: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(key, n_ranges, size): the merged ranges of a key and what they cover."""
    return merge(ranges, key, width).groupBy(key).agg(F.count("*").alias("n_ranges"), F.sum(F.col("e") - F.col("s")).alias("size"))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """(key, l_id, r_id): pairs of left (key, id, s, e) and right that overlap. Ranges meet in bins of `width`; a pair counts in the first bin that both touch."""

    def binned(df: DataFrame, x: str) -> DataFrame:
        own = df.filter("s < e").select(key, *(F.col(c).alias(f"{x}_{c}") for c in ("id", "s", "e")))
        return own.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{x}_s") / width), F.floor((F.col(f"{x}_e") - 1) / width))))

    both = binned(left, "l").join(binned(right, "r"), [key, "bin"])
    first = F.col("bin") == F.floor(F.greatest("l_s", "r_s") / width)
    return both.filter((F.col("l_s") < F.col("r_e")) & (F.col("r_s") < F.col("l_e")) & first).select(key, "l_id", "r_id")


def offsets(parts: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """The place of each part when the parts of a key are put end to end."""
    before_ = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.select(key, order, F.coalesce(before_, F.lit(0)).cast("long").alias("s"), (F.coalesce(before_, F.lit(0)) + F.col(size)).cast("long").alias("e"))


def moved(places: DataFrame, parts: DataFrame, key: str, width: int) -> DataFrame:
    """places (key, id, at) with to: where a copy of parts (key, s, e, out), source ranges and their new starts, puts them; null where the byte wasn't copied."""
    own = parts.filter("s < e").select(F.col(key).alias("__k"), "s", "e", "out").withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    hit = F.col(key).eqNullSafe(F.col("__k")) & (F.col("bin") == F.floor(F.col("at") / width)) & (F.col("at") >= F.col("s")) & (F.col("at") < F.col("e"))
    return places.join(own, hit, "left").select(key, "id", "at", (F.col("out") + F.col("at") - F.col("s")).alias("to"))
