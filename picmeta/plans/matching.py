"""Folds that remember: entries matched to regions in order, and the search for a size.

Both go through a short list of a file (its directory, the attempts) in its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from picmeta.functions.walks import let

#: Regions behind a picture that an entry of its directory can stand for.
MEDIA = ("gainmap", "mpf", "preview", "jpeg", "video", "samsung")
#: Fixed values of the search for a size.
TARGET_SHARE, CLOSE_ENOUGH, STEP_MORE = 0.95, 0.97, 0.85
QUALITY, QUALITY_STEPS = 0.85, (0.8, 0.75, 0.7)
FLOOR_EDGE, MIN_EDGE = 1280.0, 64.0
TRIES, PNG_TRIES = 7, 9

MATCHED = "struct<taken: array<int>, found: array<int>>"
SEARCH = "struct<s: double, done: boolean, fit_scale: double, fit_size: double, miss: double, small_scale: double, small_size: double>"
FITTED = "struct<scale: double, quality: double, size: double, fitted: boolean>"


def matched(entries: Column, regions: Column) -> Column:
    """array<int>: for each entry (array of meanings) the number of the region (array<struct<kind, has_video>>) that it stands for; -1 for the first, which is the picture itself, null where nothing is found. In order, each region once: a gain map takes a gain map, or else any medium but videos; a motion photo takes a video, or else a trailer with one; others take the first medium that is no trailer. Null lists: null."""

    def step(s: Column, e: Column) -> Column:
        def first(fits: Callable[[Column], Column]) -> Column:
            free = F.filter(F.sequence(F.lit(0), F.size(regions) - 1), lambda i: F.get(regions, i)["kind"].isin(*MEDIA) & ~F.array_contains(s["taken"], i) & fits(F.get(regions, i)))
            return F.when(F.size(regions) > 0, F.get(free, F.lit(0)))

        gain = F.coalesce(first(lambda r: r["kind"] == "gainmap"), first(lambda r: ~r["kind"].isin("video", "samsung")))
        motion = F.coalesce(first(lambda r: r["kind"] == "video"), first(lambda r: (r["kind"] == "samsung") & F.coalesce(r["has_video"], F.lit(False))))
        other = first(lambda r: r["kind"] != "samsung")
        pick = F.when(F.size(s["found"]) == 0, -1).when(e == "GainMap", gain).when(e == "MotionPhoto", motion).otherwise(other)
        return let(pick, lambda p: F.struct(F.when(p >= 0, F.concat(s["taken"], F.array(p))).otherwise(s["taken"]), F.concat(s["found"], F.array(p))).cast(MATCHED))

    return F.aggregate(entries, F.struct(F.array(), F.array()).cast(MATCHED), step)["found"]


def search(size_at: Callable[[Column], Column], lo: Column, hi: Column, target: Column, tries: int) -> Column:
    """The largest scale from lo to hi whose size fits, in a few tries: a guess scales by the root of the sizes' ratio and narrows between the best fit and the smallest miss. struct: fit_scale and fit_size (null: nothing fits), small_scale and small_size, the smallest that was tried."""

    def step(a: Column, _: Column) -> Column:
        return F.when(a["done"], a).otherwise(let(size_at(a["s"]), lambda n: tried(a, n)))

    def tried(a: Column, n: Column) -> Column:
        s, fits = a["s"], n <= target
        smaller = a["small_size"].isNull() | (n < a["small_size"])
        better = fits & (a["fit_scale"].isNull() | (s > a["fit_scale"]))
        closer = ~fits & (a["miss"].isNull() | (s < a["miss"]))
        stop = (fits & ((s >= hi) | (n >= target * CLOSE_ENOUGH))) | (~fits & (s <= lo))
        now = F.struct(s, stop, F.when(better, s).otherwise(a["fit_scale"]), F.when(better, n).otherwise(a["fit_size"]), F.when(closer, s).otherwise(a["miss"]), F.when(smaller, s).otherwise(a["small_scale"]), F.when(smaller, n).otherwise(a["small_size"])).cast(SEARCH)
        return let(now, lambda b: F.when(b["done"], b).otherwise(let(following(b, n), lambda x: with_next(b, x))))

    def following(b: Column, n: Column) -> Column:
        guess = b["s"] * F.sqrt(target / n) * F.when(n > target, 0.97).otherwise(1.0)
        both = b["fit_scale"].isNotNull() & b["miss"].isNotNull()
        inside = (guess > b["fit_scale"]) & (guess < b["miss"])
        held = F.least(hi, F.greatest(lo, F.when(both & ~inside, (b["fit_scale"] + b["miss"]) / 2).otherwise(guess)))
        return F.when(b["miss"].isNotNull() & (held >= b["miss"]), F.greatest(lo, b["miss"] * STEP_MORE)).otherwise(held)

    def with_next(b: Column, x: Column) -> Column:
        over = F.coalesce(x <= b["fit_scale"], F.lit(False)) | (F.abs(x - b["s"]) < 1e-4)
        return F.struct(F.when(over, b["s"]).otherwise(x), over, b["fit_scale"], b["fit_size"], b["miss"], b["small_scale"], b["small_size"]).cast(SEARCH)

    none = [F.lit(None)] * 5
    return F.aggregate(F.sequence(F.lit(1), F.lit(tries)), F.struct(hi, F.lit(False), *none).cast(SEARCH), step)


def fitted(size_at: Callable[[Column, float | None], Column], long_edge: Column, most: Column, png: bool = False) -> Column:
    """struct<scale, quality, size, fitted>: the picture of a long edge that fits `most` bytes. size_at(scale, quality) tells the bytes. A PNG has scales only; others first keep the quality down to FLOOR_EDGE, then lower the quality there, then go on to MIN_EDGE; if nothing fits, the smallest that was tried."""
    target = F.floor(most * TARGET_SHARE).cast("double")
    tiny, floor = (F.least(F.lit(1.0), e / long_edge) for e in (MIN_EDGE, FLOOR_EDGE))
    one = F.lit(1.0)

    def answer(scale: Column, quality: float | None, size: Column, ok: bool) -> Column:
        return F.struct(scale, F.lit(quality), size, F.lit(ok)).cast(FITTED)

    def smallest(*options: Column) -> Column:
        """The first of the smallest."""
        best = F.array_min(F.array(*(o["size"] for o in options)))
        return F.get(F.filter(F.array(*options), lambda o: o["size"] == best), F.lit(0))

    if png:
        return let(search(lambda s: size_at(s, None), tiny, one, target, PNG_TRIES), lambda r: F.when(r["fit_scale"].isNotNull(), answer(r["fit_scale"], None, r["fit_size"], True)).otherwise(answer(r["small_scale"], None, r["small_size"], False)))
    last = QUALITY_STEPS[-1]
    first = search(lambda s: size_at(s, QUALITY), floor, one, target, TRIES)

    def with_first(r: Column) -> Column:
        steps = [answer(floor, q, size_at(floor, q), True) for q in QUALITY_STEPS]
        low = F.get(F.filter(F.array(*steps), lambda o: o["size"] <= target), F.lit(0))
        deep = let(search(lambda s: size_at(s, last), tiny, floor, target, TRIES), lambda d: F.when(d["fit_scale"].isNotNull(), answer(d["fit_scale"], last, d["fit_size"], True)).otherwise(smallest(answer(r["small_scale"], QUALITY, r["small_size"], False), *(answer(floor, q, size_at(floor, q), False) for q in QUALITY_STEPS), answer(d["small_scale"], last, d["small_size"], False))))
        return F.when(r["fit_scale"].isNotNull(), answer(r["fit_scale"], QUALITY, r["fit_size"], True)).otherwise(F.coalesce(low, deep))

    return let(first, with_first)
