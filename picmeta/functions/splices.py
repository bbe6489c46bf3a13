"""Edits that change a text's length, and pointers that follow.

An edit replaces the characters from s to e by its data; edits of a text are a short
array on its row. Edits that overlap or leave the text are refused: all results
are null then, as for null text or null edits. Two edits at one place without length
between them are applied in the order of the array. Positions count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from picmeta.functions.walks import let, scanned

EDIT = "struct<s: int, e: int, data: string>"
ROUNDS = 24  # each round that isn't the last makes some pointer longer by a digit


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, value>>: where a pattern matches, in order."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda b, m: F.struct(b.alias("b"), m.alias("m")))

    def step(at: Column, x: Column) -> Column:
        s = at + F.length(x["b"])
        return F.struct((s + F.length(x["m"])).alias("s"), F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("value")).alias("out"))

    return scanned(F.filter(both, lambda x: x["m"].isNotNull()), F.lit(0), step, "int", "struct<s: int, e: int, value: string>")


def ordered(edits: Column) -> Column:
    """The edits by place, those without length before others."""
    keyed = F.transform(edits, lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), i.alias("i"), x["data"].alias("data")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["data"].alias("data")).cast(EDIT))


def clashing(text: Column, edits: Column) -> Column:
    """Whether edits, in order, overlap or leave the text."""
    reach = F.aggregate(edits, F.lit(0), lambda at, x: F.when((at < 0) | (x["s"] < at) | (x["e"] < x["s"]), -1).otherwise(x["e"]))
    return (reach < 0) | (reach > F.length(text))


def spliced(text: Column, edits: Column) -> Column:
    """The text with all edits; null if they clash."""

    def whole(own: Column) -> Column:
        before = F.transform(own, lambda x, i: F.when(i == 0, 0).otherwise(F.get(own, i - 1)["e"]))
        pieces = F.zip_with(own, before, lambda x, b: F.concat(F.substring(text, b + 1, x["s"] - b), F.coalesce(x["data"], F.lit(""))))
        last = F.coalesce(F.get(own, F.size(own) - 1)["e"], F.lit(0))
        return F.when(~clashing(text, own), F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text))))

    return let(ordered(edits), whole)


def followed(at: Column, edits: Column) -> Column:
    """Where a place lies after the edits: moved by what those before it add or take; null inside what an edit takes away."""
    gone = F.exists(edits, lambda x: (at >= x["s"]) & (at < x["e"]))
    moved = F.aggregate(edits, F.lit(0), lambda n, x: n + F.when(x["e"] <= at, F.coalesce(F.length(x["data"]), F.lit(0)) - (x["e"] - x["s"])).otherwise(0))
    return F.when(~gone, at + moved)


def headed(body: Column, places: Column) -> Column:
    """struct<pointers, content>: the body behind a line of pointers into it, which count from the start of that line. The line grows with the pointers' digits, so it is made again until its length stays."""

    def line(size: Column) -> Column:
        return F.concat(F.array_join(F.transform(places, lambda p: (p + size).cast("string")), ","), F.lit("\n"))

    state = "struct<size: int, done: boolean>"
    size = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.lit(0), F.lit(False)).cast(state), lambda a, _: F.when(a["done"], a).otherwise(let(F.length(line(a["size"])), lambda n: F.struct(n, n == a["size"]).cast(state))))["size"]
    return let(size, lambda n: F.struct(F.transform(places, lambda p: p + n).alias("pointers"), F.concat(line(n), body).alias("content")))
