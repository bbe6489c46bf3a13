"""Walks over bytes: parts that each tell where the next one begins.

A cursor goes through the content by a fold; the rule of a format says what lies at
a place and where to go on. A file stays in its row and nothing is shuffled. PNG is
walked and written by Arrow batches, the others by built-in expressions: their fold
goes on in runs of RUN parts; a run that has nothing left to do costs one step, and
parts are appended to a short list.

Null content gives null. Content that is empty, cut short or damaged gives the parts
that can be read; each rule says how it goes on behind damage. Places count from 0;
files have less than 2 GiB, as rows of bytes do.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from picmeta.functions.binary import big, latin1, little

RUN = 256
BLOCK = 1 << 12

#: Chunks that make the picture, and those that RIFF pictures are known to have.
PNG_PICTURE = ("IHDR", "PLTE", "IDAT", "IEND", "tRNS", "acTL", "fcTL", "fdAT")
RIFF_KNOWN = ("VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF", "ICCP", "EXIF", "XMP ", "C2PA")
#: What resources begin with.
RESOURCES = ("8BIM", "MeSa", "PHUT", "AgHg", "DCSR")

PNG_PART = "struct<kind: string, start: int, data_start: int, data_end: int, end: int, bad: boolean, crc_ok: boolean, resynced: boolean>"
RIFF_PART = "struct<kind: string, start: int, data_start: int, data_end: int, end: int, broken: boolean>"
SET_PART = "struct<junk: boolean, record: int, number: int, start: int, data_start: int, data_end: int, end: int>"
RESOURCE_PART = "struct<id: int, start: int, data_start: int, data_end: int, end: int>"

Step = Callable[[Column], Column]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def cutout(b: Column, at: Column, n: Column | int) -> Column:
    """n bytes from a place; fewer at the end, none where n is negative."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(b, (at + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))


def kind_at(b: Column, at: Column) -> Column:
    return latin1(cutout(b, at, 4))


def moved(part: Column, go_on: Column, end: Column | None = None) -> Column:
    """What a step returns: the part (or null), the place to go on from, and whether the walk ends there."""
    return F.struct(part.alias("part"), go_on.cast("int").alias("go_on"), (F.lit(False) if end is None else F.coalesce(end, F.lit(False))).alias("end"))


def walked(begin: Column | int, most: Column, step: Step, part: str) -> Column:
    """struct<stop: int, parts: array<part>>: from begin, step(place) says what is there; null ends the walk, with stop at that place. most: more parts than there can be."""
    state = f"struct<at: int, done: boolean, parts: array<{part}>>"
    none = F.array().cast(f"array<{part}>")

    def one(s: Column, _: Column) -> Column:
        taken = let(step(s["at"]), lambda r: F.when(r.isNull(), F.struct(s["at"], F.lit(True), s["parts"]).cast(state)).otherwise(F.struct(r["go_on"], r["end"], F.when(r["part"].isNull(), s["parts"]).otherwise(F.concat(s["parts"], F.array(r["part"])))).cast(state)))
        return F.when(s["done"], s).otherwise(taken)

    def run(s: Column, _: Column) -> Column:
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(RUN)), F.struct(s["at"], F.lit(False), none).cast(state), one)
        return F.when(s["done"], s).otherwise(let(inner, lambda r: F.struct(r["at"], r["done"], F.concat(s["runs"], F.array(r["parts"]))).cast(whole)))

    whole = f"struct<at: int, done: boolean, runs: array<array<{part}>>>"
    start = F.struct((F.lit(begin) if isinstance(begin, int) else begin).alias("at"), F.lit(False).alias("done"), F.array().cast(f"array<array<{part}>>").alias("runs")).cast(whole)
    runs = F.aggregate(F.sequence(F.lit(0), F.ceil(most / RUN).cast("int")), start, run)
    return let(runs, lambda r: F.struct(r["at"].alias("stop"), F.flatten(r["runs"]).alias("parts")))


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], state: str, out: str) -> Column:
    """array<out>: step(state, item) gives struct<s, out> for each item, the state carried on. Results are appended to short lists, RUN at a time."""
    none = F.array().cast(f"array<{out}>")
    inner, outer = f"struct<s: {state}, outs: array<{out}>>", f"struct<s: {state}, runs: array<array<{out}>>>"

    def one(a: Column, x: Column) -> Column:
        return let(step(a["s"], x), lambda r: F.struct(r["s"], F.concat(a["outs"], F.array(r["out"]))).cast(inner))

    def over(xs: Column) -> Column:
        def run(a: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(xs, k * RUN + 1, F.lit(RUN)), F.struct(a["s"], none).cast(inner), one)
            return let(part, lambda r: F.struct(r["s"], F.concat(a["runs"], F.array(r["outs"]))).cast(outer))

        begin = F.struct(zero, F.array().cast(f"array<array<{out}>>")).cast(outer)
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor(F.size(xs) / RUN).cast("int")), begin, run)["runs"])

    return let(items, over)


def first_place(lo: Column, hi: Column, fits: Callable[[Column], Column]) -> Column:
    """The first place from lo to hi, both included, that fits; null if none does. Blocks behind the first hit aren't looked at."""

    def look(a: Column, k: Column) -> Column:
        block = F.sequence(lo + k * BLOCK, F.least(hi, lo + (k + 1) * BLOCK - 1))
        return F.when(a >= 0, a).otherwise(F.coalesce(F.get(F.filter(block, fits), F.lit(0)).cast("int"), F.lit(-1)))

    found = F.aggregate(F.sequence(F.lit(0), F.floor((hi - lo) / BLOCK).cast("int")), F.lit(-1), look)
    return F.when(hi >= lo, F.nullif(found, F.lit(-1)))


def png_walk(b: Column) -> Column:
    """The chunks of a PNG. bad: the name isn't four letters; it is stepped over. A chunk with a wrong checksum ends where, inside it, an intact chunk begins or one that an intact chunk follows (resynced). The walk stops behind IEND, or where a chunk is cut short.

    Files come in Arrow batches: the cursor as a fold of Spark took an interpreted expression for each field of each chunk."""
    names = re.compile(rb"(?=[A-Za-z]{4})")  # also those that overlap

    def walk(b: bytes | None) -> tuple | None:
        if b is None:
            return None
        size, at, parts = len(b), 8, []

        def number(q: int) -> int:
            return int.from_bytes(b[q : q + 4])

        def header(q: int) -> bool:
            return q + 12 <= size and names.match(b, q + 4) is not None and q + 12 + number(q) <= size

        def intact(q: int) -> bool:
            end = q + 8 + number(q)
            return zlib.crc32(view[q + 4 : end]) == number(end)

        def begins(q: int) -> bool:
            return header(q) and (intact(q) or header(x := q + 12 + number(q)) and intact(x))

        view = memoryview(b)
        while at + 12 <= size and (end := at + 12 + (n := number(at))) <= size:
            named = names.match(b, at + 4) is not None
            ok = named and intact(at)
            q = None
            if named and not ok:  # a chunk begins four bytes before its name
                q = next((m.start() - 4 for m in names.finditer(b, at + 12, min(end, size - 12) + 8) if begins(m.start() - 4)), None)
            data_end = at + 8 + n if q is None else q - 4 if q - 4 >= at + 8 else q
            kind, to = b[at + 4 : at + 8].decode("latin-1"), end if q is None else q
            parts.append((kind, at, at + 8, data_end, to, not named, ok, q is not None))
            at = to
            if kind == "IEND":
                break
        return at, parts

    return F.udf(walk, f"struct<stop: int, parts: array<{PNG_PART}>>", useArrow=True)(b)


def riff_walk(b: Column) -> Column:
    """The chunks of a WebP file, up to the size that its head gives. A chunk that would reach beyond it (broken) ends where known chunks begin that follow each other up to the end; VP8X has ten bytes whatever it says."""
    end = F.least(F.octet_length(b), 8 + little(b, 4, 4)).cast("int")

    def after(p: Column) -> Column:
        size = little(b, p + 4, 4)
        to = p + 8 + size + size % 2
        fits = kind_at(b, p).rlike("^[\\x20-\\x7e]{4}$") & (to <= end + size % 2)
        return F.when((p + 8 <= end) & fits, F.least(to, end.cast("long")).cast("int")).otherwise(-1)

    def tiles(q: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor((end - q) / 8).cast("int"))
        return kind_at(b, q).isin(*RIFF_KNOWN) & (F.aggregate(steps, q, lambda p, _: F.when((p < 0) | (p == end), p).otherwise(after(p))) == end)

    def step(at: Column) -> Column:
        def part(kind_size: Column) -> Column:
            kind, size = kind_size["kind"], kind_size["size"]
            data_end = at + 8 + size
            whole = F.struct(kind, at, at + 8, data_end, F.least(end.cast("long"), data_end + size % 2), F.lit(False))
            broken = let(first_place(at + 8, end - 8, tiles), lambda q: F.struct(kind, at, at + 8, F.coalesce(q, end), F.coalesce(q, end), F.lit(True)).cast(RIFF_PART))
            return let(F.when(data_end <= end, whole.cast(RIFF_PART)).otherwise(broken), lambda p: moved(p, p["end"]))

        size = F.when((kind_at(b, at) == "VP8X") & (at + 18 <= end), F.lit(10).cast("long")).otherwise(little(b, at + 4, 4))
        return F.when(at + 8 <= end, let(F.struct(kind_at(b, at).alias("kind"), size.alias("size")), part))

    return F.when(b.isNotNull(), walked(12, F.octet_length(b) / 8, step, RIFF_PART))


def set_walk(b: Column) -> Column:
    """The datasets of an IPTC block. Zero bytes between them are padding; other bytes are junk up to the next place that can be a dataset, or to the end where a length reaches beyond it."""
    size = F.octet_length(b)

    def junk(at: Column, to: Column) -> Column:
        return F.struct(F.lit(True), F.lit(None).cast("int"), F.lit(None).cast("int"), at, F.lit(None).cast("int"), F.lit(None).cast("int"), to).cast(SET_PART)

    def seen(at: Column, pattern: str) -> Column:
        """The first place from at on where the pattern fits; the end if there is none."""
        return let(F.regexp_instr(latin1(cutout(b, at, size)), F.lit(pattern)), lambda i: F.when(i > 0, at + i - 1).otherwise(size))

    def step(at: Column) -> Column:
        def dataset(n: Column) -> Column:
            data = at + 5 + F.when(n >= 0x8000, n - 0x8000).otherwise(0)
            length = F.when(n < 0x8000, n).when(n == 0x8000, 0).otherwise(F.conv(F.hex(cutout(b, at + 5, n - 0x8000)), 16, 10).cast("long"))
            bad = (n > 0x8004) | (data > size) | (data + length > size)
            return F.when(bad, moved(junk(at, size), size, F.lit(True))).otherwise(let(data + length, lambda to: moved(F.struct(F.lit(False), big(b, at + 1, 1), big(b, at + 2, 1), at, data, to, to).cast(SET_PART), to)))

        def by_mark(mark: Column) -> Column:
            skipped = moved(F.lit(None).cast(SET_PART), F.least(seen(at, r"[^\x00]"), size - 4))
            other = let(seen(at + 1, r"(?s)\x1c[\x01-\x09].{3}"), lambda to: moved(junk(at, to), to))
            return F.when(mark == 0, skipped).when(mark != 0x1C, other).otherwise(let(big(b, at + 3, 2), dataset))

        return F.when(at + 5 <= size, let(big(b, at, 1), by_mark))

    def with_rest(w: Column) -> Column:
        left = (w["stop"] < size) & F.hex(cutout(b, w["stop"], size)).rlike("[1-9A-F]")
        return F.struct(w["stop"].alias("stop"), F.when(left, F.concat(w["parts"], F.array(junk(w["stop"], size)))).otherwise(w["parts"]).alias("parts"))

    return F.when(b.isNotNull(), let(walked(0, size + 1, step, SET_PART), with_rest))


def resource_walk(b: Column) -> Column:
    """The resources of a Photoshop block; the walk stops where none begins or one is cut short."""
    size = F.octet_length(b)

    def step(at: Column) -> Column:
        def part(q: Column) -> Column:
            def sized(n: Column) -> Column:
                to = F.least(size.cast("long"), q + 4 + n + n % 2)
                return F.when((q + 4 <= size) & (q + 4 + n <= size), moved(F.struct(big(b, at + 4, 2), at, q + 4, q + 4 + n, to).cast(RESOURCE_PART), to))

            return let(big(b, q, 4), sized)

        name = big(b, at + 6, 1)
        return F.when((at + 12 <= size) & kind_at(b, at).isin(*RESOURCES), let((at + 7 + name + (name + 1) % 2).cast("int"), part))

    return F.when(b.isNotNull(), walked(0, size / 12, step, RESOURCE_PART))


def has(parts: Column, kind: str) -> Column:
    return F.exists(parts, lambda p: p["kind"] == kind)


def png_warnings(b: Column, walk: Column) -> Column:
    """What is said about a damaged PNG, as an array."""
    wrong = F.filter(walk["parts"], lambda p: ~p["bad"] & ~p["crc_ok"])
    ended = has(walk["parts"], "IEND")
    return F.array_compact(
        F.array(
            F.when(~ended & (walk["stop"] < F.octet_length(b)), "The PNG file is damaged or cut short at the end."),
            F.when(F.exists(walk["parts"], lambda p: p["bad"]), "The PNG file has a part with a damaged name."),
            F.when(F.size(wrong) == 1, F.format_string("The %s chunk has a wrong checksum.", F.get(wrong, F.lit(0))["kind"])).when(F.size(wrong) > 1, F.format_string("%d parts of the file have a wrong checksum.", F.size(wrong))),
        )
    )


def png_rewritten(b: Column, walk: Column, changes: Column, cut_tail: Column) -> Column:
    """The PNG with changes (map of a part's number to its new data, null data: without it), lengths and checksums computed anew. Parts of the picture can't be dropped, only replaced, unless their name is damaged. cut_tail: what follows IEND goes; of a file that is cut short the rest goes and, if it has pixels, IEND is put at its end."""
    picture = PNG_PICTURE

    def whole(b: bytes | None, stop: int | None, kinds: list, starts: list, ends: list, bad: list, changes: dict | None, cut_tail: bool | None) -> bytes | None:
        if b is None or stop is None:
            return None
        made, changes = [b[:8]], changes or {}
        for i, (kind, start, end, loose) in enumerate(zip(kinds, starts, ends, bad, strict=True)):
            new = changes.get(i)
            if new is not None:
                own = kind.encode() + new
                made += [len(new).to_bytes(4), own, zlib.crc32(own).to_bytes(4)]
            elif i not in changes or not loose and kind in picture:
                made.append(b[start:end])
        if cut_tail is False:
            made.append(b[stop:])
        elif "IEND" not in kinds and stop < len(b) and "IDAT" in kinds:
            made.append(bytes.fromhex("0000000049454E44AE426082"))
        return b"".join(made)

    fields = [walk["parts"].getField(c) for c in ("kind", "start", "end", "bad")]
    return F.udf(whole, "binary", useArrow=True)(b, walk["stop"], *fields, changes.cast("map<int, binary>"), cut_tail)


def _little_hex(v: Column, n: int) -> Column:
    h = F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))))


def riff_rewritten(b: Column, walk: Column, changes: Column, cut_tail: Column) -> Column:
    """The WebP file with changes, as for a PNG; the size in the head and the flags of VP8X (colour profile, EXIF, XMP) follow what is left."""
    flags = {"ICCP": 0x20, "EXIF": 0x08, "XMP ": 0x04}

    def whole(w: Column) -> Column:
        def stays(p: Column, i: Column) -> Column:
            return p["kind"].isin("VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF") | ~F.coalesce(F.map_contains_key(changes, i) & F.element_at(changes, i).isNull(), F.lit(False))

        left = F.filter(w["parts"], lambda p, i: stays(p, i))
        mask = sum((F.when(has(left, k), v).otherwise(0) for k, v in flags.items()), F.lit(0))
        first = F.array_position(F.transform(w["parts"], lambda p: p["kind"]), "VP8X") - 1

        def piece(p: Column, i: Column) -> Column:
            new = F.element_at(changes, i)
            same = F.hex(cutout(b, p["start"], p["end"] - p["start"]))
            n = F.octet_length(new)
            made = F.concat(F.hex(p["kind"].cast("binary")), _little_hex(n, 4), F.hex(new), F.when(n % 2 == 1, "00").otherwise(""))
            kept = F.when(F.coalesce(F.map_contains_key(changes, i), F.lit(False)) & new.isNotNull(), made).otherwise(same)
            fixed = F.lpad(F.hex(F.conv(F.substring(kept, 17, 2), 16, 10).cast("long").bitwiseAND(0xD3).bitwiseOR(mask)), 2, "0")
            return F.when(~stays(p, i), "").when(i == first, F.concat(F.substring(kept, 1, 16), fixed, F.substring(kept, 19, 1 << 30))).otherwise(kept)

        body = F.concat(F.lit("57454250"), F.array_join(F.transform(w["parts"], piece), ""))
        end = F.greatest(w["stop"], F.least(F.octet_length(b), 8 + little(b, 4, 4)).cast("int"))
        tail = F.when(cut_tail, "").otherwise(F.hex(cutout(b, end, F.octet_length(b))))
        return let(body, lambda h: F.unhex(F.concat(F.lit("52494646"), _little_hex(F.length(h) / 2, 4), h, tail)))

    return let(walk, whole)
