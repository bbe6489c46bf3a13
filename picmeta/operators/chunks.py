"""Files of chunks as tables: their parts, files without some of them, and the proof that the rest is unharmed.

A file stays in its row: the walk and the rewriting are expressions, and only the
lists of changes, which are short, are shuffled to the files. Null or empty content
has no parts and stays as it is. Changes of parts that a file doesn't have do
nothing; a part that is both dropped and replaced is dropped. Rows that repeat a
path are files each, and changes apply to all of them. Other columns of files pass
through, but for those named walk, changes and new, which results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from picmeta.functions.walks import cutout, let, png_rewritten, png_walk


def walked(files: DataFrame, walk=png_walk) -> DataFrame:
    """files (path, content, ...) with walk: struct<stop, parts>."""
    return files.withColumn("walk", walk(F.col("content")))


def parts(walked_files: DataFrame, kinds: tuple[str, ...] = (), data: bool = False) -> DataFrame:
    """(path, pos, kind, ..., stored_crc): a row per part, of the kinds named, pos from 0; stored_crc is the checksum that the chunk carries, in hex. data: with the bytes of each."""
    b = F.col("content")

    def row(p: Column, i: Column) -> Column:
        # one struct made here: fields taken from `walk` one by one would each walk anew
        own = [i.alias("pos"), *(p[c].alias(c) for c in ("kind", "start", "data_start", "data_end", "end", "bad", "crc_ok", "resynced")), F.hex(cutout(b, p["end"] - 4, 4)).alias("stored_crc")]
        return F.struct(*own, *([cutout(b, p["data_start"], p["data_end"] - p["data_start"]).alias("data")] if data else []))

    rows = F.transform("walk.parts", row)
    return walked_files.select("path", F.inline(F.filter(rows, lambda p: p["kind"].isin(*kinds)) if kinds else rows))


def change_lists(dropped: DataFrame, replaced: DataFrame) -> DataFrame:
    """(path, changes: map<int, binary>) of dropped (path, pos) and replaced (path, pos, data)."""
    gone = dropped.select("path", F.col("pos").cast("int").alias("pos"), F.lit(None).cast("binary").alias("data"), F.lit(True).alias("gone"))
    new = replaced.select("path", F.col("pos").cast("int").alias("pos"), "data", F.lit(False).alias("gone"))
    one = gone.unionByName(new).groupBy("path", "pos").agg(F.when(~F.bool_or("gone"), F.max("data")).alias("data"))
    return one.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("pos", "data"))).alias("changes"))


def rewritten(walked_files: DataFrame, dropped: DataFrame, replaced: DataFrame, cut_tail: Column, write=png_rewritten) -> DataFrame:
    """walked_files with changes and new, the content without dropped (path, pos) and with replaced (path, pos, data)."""
    lists = change_lists(dropped, replaced).withColumnRenamed("path", "__path")
    both = walked_files.drop("changes", "new").join(lists, F.col("path").eqNullSafe(F.col("__path")), "left").drop("__path")
    return both.withColumn("new", write(F.col("content"), F.col("walk"), F.col("changes"), cut_tail))


def slices(content: Column, found: Column) -> Column:
    """The digests of the parts, whole as they stand."""
    return F.transform(found, lambda p: F.md5(cutout(content, p["start"], p["end"] - p["start"])))


def pixels(content: Column, found: Column, kind: str = "IDAT") -> Column:
    return F.transform(F.filter(found, lambda p: p["kind"] == kind), lambda p: F.md5(cutout(content, p["data_start"], p["data_end"] - p["data_start"])))


def read_back(made: DataFrame, walk=png_walk, picture: str = "IDAT") -> DataFrame:
    """(path, parts, parts_after, unchanged_kept, pixels_same) of rewritten files: the new content is walked again; unchanged_kept: the parts that weren't to change are there, in their order, byte by byte."""
    again = made.withColumn("walk_after", walk(F.col("new")))
    stays = F.filter(F.col("walk.parts"), lambda p, i: ~F.coalesce(F.map_contains_key("changes", i), F.lit(False)))
    # digests are values of their own: inside the filter they would be taken anew for each part
    both = F.struct(slices(F.col("content"), stays).alias("own"), slices(F.col("new"), F.col("walk_after.parts")).alias("all"))
    same = let(both, lambda d: d["own"] == let(F.array_except(d["all"], d["own"]), lambda changed: F.filter(d["all"], lambda x: ~F.array_contains(changed, x))))
    return again.select(
        "path", F.size("walk.parts").alias("parts"), F.size("walk_after.parts").alias("parts_after"),
        same.alias("unchanged_kept"),
        (pixels(F.col("content"), F.col("walk.parts"), picture) == pixels(F.col("new"), F.col("walk_after.parts"), picture)).alias("pixels_same"),
    )
