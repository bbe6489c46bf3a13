"""Plans: what the options mean for each file, before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from picmeta.functions.text import listed

#: Sizes that drawing surfaces take, the widest first: (longest side, area).
SURFACES = [(32767, 268435456), (16384, 268435456), (16384, 16777216), (8192, 16777216), (4096, 4194304), (2048, 4194304)]
FORMATS = ("same", "jpeg", "png", "webp")
MODES = ("none", "percent", "edge", "size")
ROTATION = r"(^|:)orientation$"


def validated(options: DataFrame) -> DataFrame:
    """options (format, mode, value, crop_w, crop_h) with problem: the first thing wrong with them, or null."""
    return options.withColumn(
        "problem",
        F.when(~F.col("format").isin(*FORMATS), F.concat(F.lit("unknown format "), F.col("format")))
        .when(~F.col("mode").isin(*MODES), F.concat(F.lit("unknown resize "), F.col("mode")))
        .when((F.col("mode") == "percent") & ~F.col("value").between(1, 100), "percent must be 1 to 100")
        .when((F.col("mode") != "none") & (F.coalesce("value", F.lit(0.0)) <= 0), "a resize needs a number above 0")
        .when((F.col("crop_w") <= 0) | (F.col("crop_h") <= 0), "a crop needs a width and a height"),
    )


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def cropped(w: Column, h: Column, rect: Column) -> Column:
    """rect (x, y, w, h) within a picture of w by h, in whole pixels; null if it is the whole picture or there is none."""
    x = F.greatest(F.lit(0), F.least(w - 1, rounded(rect["x"])))
    y = F.greatest(F.lit(0), F.least(h - 1, rounded(rect["y"])))
    cw = F.greatest(F.lit(1), F.least(w - x, rounded(rect["w"])))
    ch = F.greatest(F.lit(1), F.least(h - y, rounded(rect["h"])))
    whole = (x == 0) & (y == 0) & (cw == w) & (ch == h)
    return F.when(rect.isNotNull() & ~whole, F.struct(x.alias("x"), y.alias("y"), cw.alias("w"), ch.alias("h")))


def scaled(w: Column, h: Column, mode: Column, value: Column) -> Column:
    """The factor, 1 at most, of a resize by percent or to a longest edge."""
    return F.when(mode == "percent", F.least(F.lit(1.0), value / 100)).when(mode == "edge", F.least(F.lit(1.0), value / F.greatest(w, h))).otherwise(F.lit(1.0))


def fitted(w: Column, h: Column, most_w: Column, most_h: Column) -> Column:
    """w by h within most_w by most_h, in shape, never enlarged."""
    s = F.least(F.lit(1.0), most_w / w, most_h / h)
    return F.struct(F.greatest(F.lit(1), rounded(w * s)).alias("w"), F.greatest(F.lit(1), rounded(h * s)).alias("h"))


def largest_with(w: Column, h: Column, ratio: Column) -> Column:
    """The largest rectangle of a ratio inside w by h, in its middle."""
    rw = F.least(w.cast("double"), h * ratio)
    rh = F.least(h.cast("double"), w / ratio)
    return F.struct(((w - rw) / 2).alias("x"), ((h - rh) / 2).alias("y"), rw.alias("w"), rh.alias("h"))


def workable(w: Column, h: Column, side: int, area: int) -> Column:
    """The nearest size in shape that the first surface takes which a device with this longest side and area has."""
    out = F.lit(None).cast("struct<w:bigint,h:bigint>")
    for most, room in reversed(SURFACES):
        s = F.least(F.lit(1.0), most / F.greatest(w, h), F.sqrt(room / (w * h).cast("double"))) * 0.999
        tw, th = F.greatest(F.lit(1), F.floor(w * s)).cast("long"), F.greatest(F.lit(1), F.floor(h * s)).cast("long")
        out = F.when((F.greatest(tw, th) <= side) & (tw * th <= area), F.struct(tw.alias("w"), th.alias("h"))).otherwise(out)
    return out


def planned(files: DataFrame, mode: str = "none", value: float = 0.0, to: str = "same", webp: bool = True) -> DataFrame:
    """files (path, format, w, h, orientation, decodable, remove: array of ids, rotation: array of ids, rect) with remove, bake, crop, out_w, out_h, enc, resave and warnings.

    A file that can't be opened keeps its rotation and is not edited."""
    asked = F.size(F.array_intersect("remove", "rotation")) > 0
    bake = (F.coalesce("orientation", F.lit(1)) != 1) & asked
    can = F.col("decodable")
    p = files.withColumn("crop_", cropped(F.col("w"), F.col("h"), F.col("rect"))).withColumn("rw", F.coalesce("crop_.w", "w")).withColumn("rh", F.coalesce("crop_.h", "h"))
    s = scaled(F.col("rw"), F.col("rh"), F.lit(mode), F.lit(value))
    p = p.withColumn("tw", F.greatest(F.lit(1), rounded(F.col("rw") * s))).withColumn("th", F.greatest(F.lit(1), rounded(F.col("rh") * s)))
    resized = (F.col("tw") < F.col("rw")) | (F.col("th") < F.col("rh"))
    wanted = F.col("format") if to == "same" else F.lit(to)
    convert = wanted != F.col("format")
    enc = F.when(wanted == "heic", "jpeg").when((wanted == "webp") & F.lit(not webp), "png").otherwise(wanted)
    edit = F.col("crop_").isNotNull() | resized | convert | F.lit(mode == "size")
    warnings = F.array_compact(F.array(F.when(~can & bake, "rotation kept: the picture can't be opened"), F.when(~can & edit, "not edited: the picture can't be opened")))
    return p.select(
        "path", F.when(~can & bake, F.array_except("remove", "rotation")).otherwise(F.col("remove")).alias("remove"), (can & bake).alias("bake"), F.when(can, F.col("crop_")).alias("crop"),
        F.when(can, F.col("tw")).otherwise(F.col("rw")).cast("long").alias("out_w"), F.when(can, F.col("th")).otherwise(F.col("rh")).cast("long").alias("out_h"),
        F.when(can, enc).otherwise(F.col("format")).alias("enc"), (can & (bake | F.col("crop_").isNotNull() | resized | convert)).alias("resave"), warnings.alias("warnings"),
    )


def unchanged(n_remove: Column, resave: Column, normalise: Column, limit: Column, size: Column) -> Column:
    """Whether the new file would be the old one."""
    return (n_remove == 0) & ~resave & ~normalise & (limit.isNull() | (size <= limit))


def idle_text(many: Column, has_items: Column, editable: Column, fits: Column) -> Column:
    """What is said where no file would change."""
    none = F.when(many, "Nothing to change: these files have no metadata, and they can't be edited.").otherwise("Nothing to change: this file has no metadata, and it can't be edited.")
    facts = F.array_compact(F.array(F.when(~has_items, F.when(many, "these files have no metadata").otherwise("this file has no metadata")), F.when(fits, F.when(many, "the pictures are already under the size limit").otherwise("the picture is already under the size limit"))))
    asks = F.array_join(F.array_compact(F.array(F.when(has_items, "tick something to remove"), F.when(editable, "choose a size or format"))), ", or ")
    capital = F.concat(F.upper(F.substring(asks, 1, 1)), F.substring(asks, 2, 1 << 20))
    return F.when(~has_items & ~editable, none).when(F.size(facts) == 0, F.concat(F.lit("Nothing to change yet: "), asks, F.lit("."))).otherwise(F.concat(F.lit("Nothing to change yet: "), listed(facts), F.lit(". "), capital, F.lit(".")))


def damaged(warnings: Column, ids: Column) -> Column:
    return F.exists(warnings, lambda w: w.rlike("(?i)cut short|damaged|ends without")) | F.exists(ids, lambda i: i.rlike(":damaged$"))


def camera_clean(fmt: Column, n_items: Column, n_warnings: Column, normalise: Column) -> Column:
    return (fmt == "jpeg") & (n_items == 0) & (n_warnings == 0) & ~normalise
