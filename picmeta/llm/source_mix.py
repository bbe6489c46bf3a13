"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Sources, in code point order with null last, weigh 3, 1, 2, 3, 1, 2, ... and
share SHARE times all words; a target stops at CAP times its source's size and
the excess is shared again by weight.

Each document gets the rate r that stays closest, in relative entropy, to one
copy while its source's words meet the target and r <= CAP:

    minimise sum(r ln r - r)  subject to  sum(size * r) = target, 0 <= r <= CAP

The solution is exponentially tilted, r = min(CAP, exp(lam * size / scale)), and
lam solves the convex dual. `balance` finds it with Newton iterations that run
as Spark aggregates over a histogram (documents of one source and size share
their rate, so nothing is lost), inside a bracket that makes every step safe.
Nothing but one error figure per iteration reaches the driver.

`rounded` turns rates into whole copies: each source is dealt by hash into
chunks of about CHUNK documents, and in each chunk, from the longest text to the
shortest, copies are chosen between floor(r) and ceil(r) so that the words taken
follow the words wanted. The rest of a chunk is less than one of its short
texts. Rows with the same doc_id and text are numbered, and CHUNK of them at a
time are dealt like one document, so no group is much larger than a chunk,
whatever a source holds. All of this hangs on contents only: the same rows in
other files or another order give the same copies.

Null text has size 0. A null source is a source, the last one. Texts of size 0
take part with 0 words. Repeated rows are documents of their own; which of them
are taken is not defined, how many is. An empty table gives an empty result.
Other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from picmeta.llm.shared import cut, hinted

SHARE = 1.5
CAP = 2.0
WEIGHTS = (3, 1, 2)
CHUNK = 256
TOLERANCE = 1e-9
MAX_STEPS = 60


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, uid: str = "__uid") -> DataFrame:
    """(uid, doc_id, source, size, mark, nth): mark is a hash of the text; nth counts the rows of one doc_id and mark from 0. docs has a column uid."""
    own = identity()
    rows = cut(docs.select(F.col(uid).alias("uid"), own["doc_id"].alias("doc_id"), own["source"].alias("source"), words().alias("size"), own["mark"].alias("mark"), F.spark_partition_id().alias("part")))
    return counted(rows).select("uid", "doc_id", "source", "size", "mark", "nth")


def identity() -> Column:
    """What tells documents apart: source, doc_id and a hash of the text, none of them null as a whole."""
    return F.struct(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark")).cast("struct<source: string, doc_id: long, mark: long>")  # as a table has it, else a join casts it and shuffles again


def counted(rows: DataFrame) -> DataFrame:
    """rows (uid, source, doc_id, mark, part, ...), a table, with nth."""
    key = ["source", "doc_id", "mark"]
    counts = rows.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each task that has the key
    repeated = before.filter("n > 1 OR before > 0").select(*(F.col(k).alias(f"r_{k}") for k in key), F.col("part").alias("r_part"), "before")
    same = F.col("part") == F.col("r_part")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    nth = F.when(F.col("r_part").isNull(), 0).otherwise(F.col("before") + F.row_number().over(Window.partitionBy(*key, "part").orderBy("uid")) - 1)
    return rows.join(repeated, same, "left").withColumn("nth", nth.cast("long")).drop("before", *repeated.columns)


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources with its weight by position in code point order, null last; the rank is counted per range of sources."""
    dealt = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.alias("a").join(counts.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.join(before, "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int") + 1).cast("double")).drop("part", "before")


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size, weight) with target: share times all words by weight, none above cap times its size."""
    most = F.col("source_size") * cap
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = most <= level * F.col("weight")
        held, open_weight = sources.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        raised = (total - (held or 0)) / open_weight if open_weight else level
        if raised <= level:
            return sources.withColumn("target", F.least(most, F.col("weight") * level))
        level = raised


def balance(hist: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """sources with lam and scale. hist: (source, size, n)."""
    shape = hist.filter("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"), F.min("size").alias("least"))
    ratio = F.log(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")))
    s = sources.join(shape.withColumnRenamed("source", "s0"), F.col("source").eqNullSafe(F.col("s0")), "left").drop("s0")
    wide = F.col("scale") / F.col("least")
    s = s.withColumn("low", F.least(F.lit(0.0), ratio * wide)).withColumn("high", math.log(cap) * wide)
    s = s.withColumn("lam", F.when(F.col("target") >= F.col("source_size") * cap, F.col("high")).otherwise(ratio))
    x = F.col("size") / F.col("scale")
    tilt = F.least(F.lit(cap), F.exp(F.col("lam") * x))
    state = cut(s)
    for _ in range(MAX_STEPS):
        joined = hist.select("source", "size", "n").join(state.withColumnRenamed("source", "s0"), F.col("source").eqNullSafe(F.col("s0")))
        at = joined.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * tilt).alias("got"), F.sum(F.when(tilt < cap, F.col("n") * F.col("size") * x * tilt).otherwise(0.0)).alias("slope"))
        new = state.join(at.withColumnRenamed("source", "s0"), F.col("source").eqNullSafe(F.col("s0")), "left").drop("s0", "error")
        gap = F.col("got") - F.col("target")
        new = new.withColumn("low", F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("lam")).otherwise(F.col("high")))
        error = F.coalesce(F.abs(gap) / F.when(F.col("target") > 0, F.col("target")), F.lit(0.0))
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        new = new.withColumn("lam", F.when(error <= TOLERANCE, F.col("lam")).otherwise(step)).withColumn("error", error).drop("got", "slope")
        state = cut(new)
        if (state.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"the dual is not solved to {TOLERANCE} after {MAX_STEPS} steps")
    return state.select("source", "source_size", "weight", "target", F.round("lam", 10).alias("lam"), "scale", "docs")  # reruns add in another order


def rounded(rated: DataFrame, cap: float = CAP) -> DataFrame:
    """rated (uid, doc_id, source, size, mark, nth, docs, rate, ...) with copies."""
    others = [c for c in rated.columns if c not in ("source", "docs", "mark", "nth", "doc_id", "uid")]
    chunk = F.pmod(F.xxhash64("doc_id", "size", "mark", F.floor(F.col("nth") / CHUNK)), F.greatest(F.ceil(F.col("docs") / CHUNK), F.lit(1)))
    row = F.struct((-F.col("size")).alias("order"), "doc_id", "mark", "nth", "uid", *others)
    others = ["doc_id", "mark", "nth", "uid", *others]
    groups = rated.groupBy("source", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def step(acc: Column, r: Column) -> Column:
        want = acc["want"] + r["rate"] * r["size"]
        near = F.when(r["size"] > 0, F.floor((want - acc["got"]) / r["size"] + 0.5)).otherwise(F.floor(r["rate"] + 0.5))
        n = F.greatest(F.floor(r["rate"]), F.least(F.ceil(r["rate"]), near)).cast("int")
        return F.struct(want.alias("want"), (acc["got"] + n * r["size"]).alias("got"), F.concat(acc["copies"], F.array(n)).alias("copies"))

    start = F.struct(F.lit(0.0).alias("want"), F.lit(0).cast("long").alias("got"), F.array().cast("array<int>").alias("copies"))
    dealt = groups.select("source", "rows", F.aggregate("rows", start, step)["copies"].alias("copies"))
    pair = F.explode(F.arrays_zip("rows", "copies")).alias("p")
    return dealt.select("source", pair).select("source", *(F.col(f"p.rows.{c}").alias(c) for c in others), F.col("p.copies").cast("long").alias("copies"))


def mixture(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken), one row per row of docs."""
    return copied(docs.withColumn("__uid", F.monotonically_increasing_id()), share, cap, weights).drop("uid", "source", "mark", "nth")


def copied(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`mixture` with the uid, source, mark and nth of each row; docs has the uid as __uid."""
    rows = cut(sized(docs))
    hist = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    solved = balance(hist, cut(targets(weighted(sources, weights), share, cap)), cap)
    tilt = F.when(F.col("lam").isNotNull(), F.least(F.lit(cap), F.exp(F.col("lam") * F.col("size") / F.col("scale"))))  # null in sources without words
    solved = hinted(cut(solved.withColumnRenamed("source", "s0")))
    rated = rows.join(solved, F.col("source").eqNullSafe(F.col("s0"))).select("uid", "doc_id", "source", "size", "mark", "nth", "source_size", "target", "docs", F.coalesce(tilt, F.lit(1.0)).alias("rate"))
    return rounded(rated, cap).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mixture takes it. Rows find their copies by what tells them apart: whole rows are shuffled once and not written, but for those of which there are more than CHUNK alike. docs is read twice, three times with such rows, and has to hold the same rows each time."""
    found = copied(docs.withColumn("__uid", F.monotonically_increasing_id()), **options)
    copies = cut(found.select(F.struct("source", "doc_id", "mark").alias("__key0"), "nth", "copies"))
    crowded = hinted(cut(copies.filter(F.col("nth") == CHUNK).select(F.col("__key0").alias("__crowded"))))
    keyed, alike = docs.withColumn("__key", identity()), F.col("__key") == F.col("__crowded")
    some = not crowded.isEmpty()
    plain = keyed.join(crowded, alike, "left_anti") if some else keyed
    few = copies.join(crowded, F.col("__key0") == F.col("__crowded"), "left_anti") if some else copies
    lists = few.groupBy("__key0").agg(F.sort_array(F.collect_list(F.struct("nth", "copies")))["copies"].alias("__lists")).filter(F.array_max("__lists") > 0)  # CHUNK at most
    at = plain.withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy("__key")))
    mixed = at.join(lists, F.col("__key") == F.col("__key0")).withColumn("__copies", F.element_at("__lists", F.col("__nth"))).select(*docs.columns, "__copies")
    if some:
        own = cut(keyed.join(crowded, alike, "left_semi").withColumn("__uid", F.monotonically_increasing_id()))
        nth = counted(own.select(F.col("__uid").alias("uid"), "__key.*", F.spark_partition_id().alias("part"))).select("uid", F.struct("source", "doc_id", "mark").alias("__key"), F.col("nth").alias("__nth"))
        wanted = nth.join(copies, (F.col("__key") == F.col("__key0")) & (F.col("__nth") == F.col("nth"))).select(F.col("uid").alias("__uid0"), F.col("copies").alias("__copies"))
        mixed = mixed.unionByName(own.join(wanted, F.col("__uid") == F.col("__uid0")).select(*docs.columns, "__copies"))
    return mixed.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def goals(mixed: DataFrame) -> DataFrame:
    """What SQL can express of a mixture; targets in whole words."""
    return mixed.select("doc_id", "size", "source_size", F.round("target").cast("long").alias("target_words"), (F.col("taken") <= 2 * F.col("size")).alias("within_cap"))


#: Water-filling in one pass: sources by cap per weight; a source is full if all before it and itself are full at its own level.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})::INTEGER + 1]::DOUBLE AS weight FROM d GROUP BY source),
o AS (SELECT *, {CAP} * source_size / weight AS level, {SHARE} * sum(source_size) OVER () AS total,
  coalesce(sum({CAP} * source_size) OVER (ORDER BY {CAP} * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
  sum(weight) OVER (ORDER BY {CAP} * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM s),
l AS (SELECT arg_min((total - full_before) / open_weight, level) FILTER (WHERE (total - full_before) / open_weight < level) AS water FROM o)
SELECT doc_id, size, o.source_size, round(least({CAP} * o.source_size, coalesce(l.water * o.weight, {CAP} * o.source_size)))::BIGINT AS target_words, TRUE AS within_cap
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source CROSS JOIN l"""
