"""Planted strings: where they are, in which encoding, and which removal takes them away."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from picmeta.functions import grams
from picmeta.operators.shared import kept, tidy

ENCODINGS = ("UTF-8", "UTF-16LE", "UTF-16BE")
AT_ONCE = 1 << 18  # rows of two numbers that are broadcast
#: Bits that the filter of picked grams has for each of them, and at least and at most: it fills up beyond, and more grams are shuffled than strings have picked.
BITS, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 30


def forms(needles: DataFrame, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """(needle_id, encoding, bytes): each text in each encoding; texts that are null or empty have none."""
    each = F.array(*(F.struct(F.lit(e).alias("encoding"), F.encode("needle", e).alias("bytes")) for e in encodings))
    return needles.filter("needle <> ''").select("needle_id", F.explode(each).alias("f")).select("needle_id", "f.*")


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= AT_ONCE else df


def picks(own: DataFrame) -> DataFrame:
    """(key, n, way, gram): the grams that each string of own (key, bytes) picks, and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.binary_length(b.column(1))
            for way, row, h in grams.picked(b.column(1)):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), n.take(at).cast(pa.int32()), pa.array(np.full(len(row), way, np.int32)), pa.array(h.view(np.int64))], ["key", "n", "way", "gram"])

    return own.select("key", "bytes").mapInArrow(tidy(run), "key long, n int, way int, gram long")


def filtered(own: DataFrame) -> tuple[list[int], bytes]:
    """The ways of all grams that own's strings pick, and a Bloom filter of these grams."""
    bits = min(max(1 << (BITS * grams.PICKS * own.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for way, _, h in grams.picked(b.column(0)):
                bit = np.unique(np.concatenate([grams.bit_of(h, bits, k) for k in range(grams.hashes(way))]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bit), way, np.int32)), pa.array(bit)], ["way", "bit"])

    part = LEAST_BITS  # the bits of one of Spark's bitmaps
    of = own.select("bytes").mapInArrow(tidy(run), "way int, bit long").groupBy(F.floor(F.col("bit") / part).alias("part"))
    ways, every = set(), np.zeros(bits // 8, np.uint8)
    for r in of.agg(F.bitmap_construct_agg(F.col("bit") % part).alias("bits"), F.collect_set("way").alias("ways")).toLocalIterator():
        ways |= set(r.ways)
        every[r.part * part // 8 : (r.part + 1) * part // 8] = np.frombuffer(r.bits, np.uint8)
    return sorted(ways), every.tobytes()


def met(rows: DataFrame, own: DataFrame) -> DataFrame:
    """(row, key): contents and shorter strings that may stand in them, each once. rows: (row, content); own: (key, bytes).

    A content that holds a string holds all its grams. Each string picks some, and
    the one of these that the fewest contents have is joined, if all of them stand
    in some longer content; grams that no string has picked stay, but for a few,
    where the contents are read. Strings without a
    long gram pick others (`grams.WAYS`)."""
    ways, wanted = filtered(own)
    known = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(known.value, np.uint8)
        for b in batches:
            row, h = grams.asked(b.column(1), ways, wanted)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pc.binary_length(b.column(1)).take(at).cast(pa.int32()), pa.array(h.view(np.int64))], ["row", "row_n", "gram"])

    every = rows.select("row", "content").mapInArrow(tidy(run), "row long, row_n int, gram long")
    held = every.filter("row IS NOT NULL AND row_n IS NOT NULL AND gram IS NOT NULL").repartition("gram")  # both uses below read all columns, so that it's made once
    often = held.groupBy("gram").agg(F.count("*").alias("held_by"), F.max("row_n").alias("most"), F.max("row").alias("last"))
    each = picks(own).join(often, "gram").withColumn("other", F.expr("most > n AND (held_by > 1 OR last <> key)"))
    rarest = each.groupBy("key", "n").agg(F.min(F.struct("held_by", "gram")).alias("g"), F.bool_and("other").alias("other")).filter("other").select("key", "n", "g.gram")
    return held.join(rarest, "gram").filter("row <> key AND n < row_n").select("row", "key").distinct()


def inside(files: DataFrame, needles: DataFrame, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """(path, needle_id, encoding): the forms that are shorter than a file (path, content) that holds them, a row for each row of a file and of a text.

    What a rare gram brings together (`met`) is compared in full, once for equal
    contents and equal strings; contents that meet a string are shuffled once,
    strings once for each content that they meet. Neither side is bounded."""
    own = forms(needles, encodings).withColumn("key", F.xxhash64("bytes"))
    rows = files.filter("content IS NOT NULL").select("path", "content", F.xxhash64("content").alias("row"))
    pairs = kept(met(rows, own))
    n = pairs.count()
    one = rows.select("row", "content").join(small(pairs.select("row").distinct(), n), "row", "left_semi").dropDuplicates(["row"])
    two = own.select("key", "bytes").join(small(pairs.select("key").distinct(), n), "key", "left_semi").dropDuplicates(["key"]).join(small(pairs, n), "key")
    hits = one.hint("merge").join(two, "row").filter(F.contains("content", F.col("bytes"))).select("row", "key")
    return rows.select("path", "row").join(hits, "row").join(own.select("key", "needle_id", "encoding"), "key").select("path", "needle_id", "encoding")


def found(files: DataFrame, needles: DataFrame, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """(path, needle_id, encoding): the forms that files (path, content) contain, each once: those `inside` a file, and those that are a file's whole content, which are known by their digest. Rows that repeat a path are files of that path; null content holds nothing."""
    digest = lambda x: F.sha2(x, 256).alias("digest")
    same = files.select("path", digest("content")).join(forms(needles, encodings).select(digest("bytes"), "needle_id", "encoding"), "digest")
    return inside(files, needles, encodings).unionByName(same.select("path", "needle_id", "encoding")).distinct()


def opened_once(files: DataFrame, least_hex: int = 24, least_base64: int = 64) -> DataFrame:
    """(path, kind, content): what is written inside files (path, kind, content) as runs of hex pairs or base64."""
    text = F.decode("content", "ISO-8859-1")
    hexes = F.transform(F.regexp_extract_all(text, F.lit(f"(?:[0-9a-fA-F]{{2}}){{{least_hex},}}"), F.lit(0)), lambda x: F.struct(F.lit("hex").alias("kind"), F.unhex(x).alias("content")))
    b64 = F.transform(F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9+/]{{{least_base64},}}={{0,2}}"), F.lit(0)), lambda x: F.struct(F.lit("base64").alias("kind"), F.try_to_binary(F.substring(x, F.lit(1), (F.floor(F.length(x) / 4) * 4).cast("int")), F.lit("base64")).alias("content")))
    inside = files.select("path", "kind", F.explode(F.concat(hexes, b64)).alias("x")).filter("x.content IS NOT NULL")
    return inside.select("path", F.when(F.col("kind") == "raw", F.col("x.kind")).otherwise(F.concat("kind", F.lit("/"), F.col("x.kind"))).alias("kind"), "x.content")


def opened(files: DataFrame, least_hex: int = 24, least_base64: int = 64) -> DataFrame:
    """(path, kind, content): the bytes of files (path, content) as they are (raw), those written inside as runs of hex pairs or base64, and what is written inside these (hex/base64), until nothing is left to open. What is opened is shorter than the run it stood in, so that ends."""
    last = files.filter("content IS NOT NULL").select("path", F.lit("raw").alias("kind"), "content")
    every = last
    while True:
        last = kept(opened_once(last, least_hex, least_base64))
        if last.isEmpty():
            return every
        every = every.unionByName(last)


def contained(needles: DataFrame) -> DataFrame:
    """(inner, outer): texts of a registry (needle_id, needle) that stand inside other, different texts of it, for each pair of such rows. A text that another one holds and that differs from it is shorter, so equal texts, whose pairs grow with the square of their number, aren't joined."""
    files = needles.select(F.col("needle_id").alias("path"), F.encode("needle", "UTF-8").alias("content"))
    return inside(files, needles, ("UTF-8",)).select(F.col("needle_id").alias("inner"), F.col("path").alias("outer"))


def responsible(present: DataFrame, after: DataFrame) -> DataFrame:
    """(path, needle_id, keys): the keys whose removal alone takes a needle away, with commas. present: (path, needle_id); after: (path, key, needle_id), what is left without a key, and a row with a null needle for each key tried."""
    tried = after.select("path", "key").distinct()
    left = after.filter("needle_id IS NOT NULL")
    gone = present.join(tried, "path").join(left, ["path", "key", "needle_id"], "left_anti")
    return gone.groupBy("path", "needle_id").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))


def visibility(registry: DataFrame, shown: DataFrame) -> DataFrame:
    """(needle_id, verdict): whether a reader shows a planted text of registry (needle_id, path, needle, grp, name, value): yes, verbatim in a value of that file; reformatted, as the registry says it looks there (grp, name and value, null if it doesn't say); no. shown: (path, grp, name, value). Empty texts are in no value; rows that repeat an id get the best verdict of them."""
    asked = registry.select("needle_id", "path", "needle")
    yes = asked.filter("needle <> ''").join(shown.select("path", F.col("value").alias("seen")), "path").filter(F.contains("seen", F.col("needle"))).select("needle_id", F.lit(2).alias("rank"))
    other = registry.drop("needle").join(shown, ["path", "grp", "name", "value"], "left_semi").select("needle_id", F.lit(1).alias("rank"))
    every = registry.select("needle_id", F.lit(0).alias("rank")).unionByName(other).unionByName(yes).groupBy("needle_id").agg(F.max("rank").alias("rank"))
    return every.select("needle_id", F.element_at(F.array(*map(F.lit, ("no", "reformatted", "yes"))), F.col("rank") + 1).alias("verdict"))


def visible(verdict: Column) -> Column:
    return F.coalesce(verdict, F.lit("no"))


def findings(rows: DataFrame) -> DataFrame:
    """(severity, n): findings count once per key."""
    return rows.groupBy("severity", "key").agg(F.lit(1).alias("one")).groupBy("severity").agg(F.count("*").alias("n"))


def run_stats(cases: DataFrame, slow_ms: int = 3000) -> DataFrame:
    """One row: cases, errors, hangs, crashes, slow ones, and those that kept all in silence. cases: (status, ms, kept)."""
    return cases.agg(
        F.count("*").alias("cases"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "hang").alias("hangs"), F.count_if(F.col("status") == "crash").alias("crashes"), F.count_if(F.col("ms") > slow_ms).alias("slow"), F.count_if(F.col("kept") & (F.col("status") == "ok")).alias("silent_keeps")
    )


def repeated(needles: DataFrame) -> DataFrame:
    """(needle, n): texts that a registry has more than once."""
    return needles.groupBy("needle").agg(F.count("*").alias("n")).filter("n > 1")


def same_model(one: DataFrame, two: DataFrame) -> DataFrame:
    """(path, same): whether both hold the same (name, value) as often each."""
    n = [df.groupBy("path", "name", "value").agg(F.lit(s).alias("s"), F.count("*").alias("n")) for s, df in ((1, one), (-1, two))]
    net = n[0].unionByName(n[1]).groupBy("path", "name", "value").agg(F.sum(F.col("s") * F.col("n")).alias("d"))
    return net.groupBy("path").agg(F.bool_and(F.col("d") == 0).alias("same"))
