"""TIFF blocks (EXIF): directories of fixed records, found by chasing pointers, and blocks built anew.

`directories` carries the places it has been to, so pointers that go in circles
end. It and `values` read blocks in Arrow batches: as folds of Spark they took an
interpreted expression for each field of each record. The other functions are
built-in expressions with the byte order as a column. A block stays in its row.

Null, or bytes without a TIFF head, give null. Directories that are cut short or
lie outside the block are left out, with a warning each; a block whose first
directory can't be read has none and counts as damaged.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from picmeta.functions.binary import big, latin1, little
from picmeta.functions.walks import cutout, first_place, let

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Bytes of a value by type, tags that point to directories, and the longest chain of previews.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 129: 1}
EXIF, GPS, INTEROP = 0x8769, 0x8825, 0xA005
MAX_CHAIN = 16

IFD = "struct<name: string, offset: bigint, count: int, next: bigint, owner: string, tag: int, entry: int, chain: boolean>"
ENTRY = "struct<index: int, tag: int, type: int, count: bigint, size: bigint, inline: boolean, value_offset: bigint, valid: boolean>"
TIFF = f"struct<ifds: array<{IFD}>, warnings: array<string>, damaged: boolean>"
VALUE = "struct<ifd: string, nth: int, tag: int, type: int, valid: boolean, value: string>"
#: How numbers of a type are packed; fractions are two of them.
PACKED = {1: "B", 3: "H", 4: "I", 13: "I", 6: "b", 8: "h", 9: "i", 5: "I", 10: "i"}


def is_head(b: Column, at: Column | int = 0) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.hex(cutout(b, at, 4)).isin("49492A00", "4D4D002A") & (F.octet_length(b) >= at + 8)


def block_start(b: Column, limit: int = 64) -> Column:
    """Where the TIFF head is among the first places of an EXIF payload; null if it isn't there."""
    return F.when(F.octet_length(b) >= 8, first_place(F.lit(0), F.least(F.lit(limit), F.octet_length(b) - 8), lambda q: is_head(b, q)))


def first_block(b: Column) -> Column:
    """The first TIFF block of a payload, from its head on."""
    return let(block_start(b), lambda at: F.when(at.isNotNull(), cutout(b, at, F.octet_length(b))))


def number(b: Column, at: Column | int, n: int) -> Column:
    """An unsigned integer in the block's own byte order."""
    return F.when(F.hex(F.substring(b, 1, 1)) == "49", little(b, at, n)).otherwise(big(b, at, n))


def entries(b: Column, ifd: Column) -> Column:
    """The records of a directory. valid: the type is known and the value lies inside the block."""
    size = F.octet_length(b)

    def one(i: Column) -> Column:
        at = ifd["offset"] + 2 + i * 12

        def sized(h: Column) -> Column:
            unit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TYPE_SIZE.items() for x in kv)), h["type"]), F.lit(0))
            return let(unit * h["count"], lambda n: placed(h, n))

        def placed(h: Column, n: Column) -> Column:
            value = F.when(n <= 4, at + 8).otherwise(number(b, at + 8, 4))
            return let(value, lambda v: F.struct(i, h["tag"], h["type"], h["count"], n, n <= 4, v, (n < 0x7FFFFFFF) & h["known"] & ((n <= 4) | ((v >= 8) & (v + n <= size)))).cast(ENTRY))

        kind = number(b, at + 2, 2).cast("int")
        return let(F.struct(number(b, at, 2).cast("int").alias("tag"), kind.alias("type"), number(b, at + 4, 4).alias("count"), kind.isin(*TYPE_SIZE).alias("known")), sized)

    return F.when(ifd["count"] > 0, F.transform(F.sequence(F.lit(0), ifd["count"] - 1), one)).otherwise(F.array().cast(f"array<{ENTRY}>"))


def records(b: bytes, order: str, at: int, n: int) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(tag, type, count, size, place of the value, valid) of each of the n records of a directory, as `entries` has them."""
    for tag, kind, count, value in struct.iter_unpack(order + "HHII", b[at + 2 : at + 2 + n * 12]):
        size = TYPE_SIZE.get(kind, 0) * count
        at += 12
        place = at - 2 if size <= 4 else value
        yield tag, kind, count, size, place, kind in TYPE_SIZE and size < 0x7FFFFFFF and (size <= 4 or 8 <= value and value + size <= len(b))


def walk(b: bytes | None) -> tuple[list[tuple], list[str], bool] | None:
    """Directories, warnings, and whether there is no directory; null without a head."""
    if b is None or len(b) < 8 or b[:4] not in (b"II*\0", b"MM\0*"):
        return None
    order = "<" if b[:1] == b"I" else ">"
    ifds: list[tuple] = []
    warnings: list[str] = []
    visited: set[int] = set()

    def number(at: int, kind: str) -> int:
        return struct.unpack_from(order + kind, b, at)[0]

    def read(name: str, at: int, label: str, owner: tuple = (None, None, None), chain: bool = False) -> tuple | None:
        """The directory at a place, if there is one that wasn't read yet; owner: the pointer that leads there."""
        if not at:
            return None
        if at < 8 or at + 2 > len(b) or at in visited:
            warnings.append(f"The {label} directory in the EXIF data points outside the data and was skipped.")
            return None
        visited.add(at)
        n = number(at, "H")
        behind = at + 2 + n * 12
        if behind > len(b):
            warnings.append(f"The {label} directory in the EXIF data is damaged and was skipped.")
            return None
        ifds.append((name, at, n, number(behind, "I") if behind + 4 <= len(b) else 0, *owner, chain))
        return ifds[-1]

    def pointers(ifd: tuple | None, tag: int) -> list[tuple[tuple, int]]:
        found = enumerate(records(b, order, ifd[1], ifd[2])) if ifd else ()
        return [((ifd[0], tag, i), number(place, "I")) for i, (t, kind, count, _, place, valid) in found if t == tag and valid and count == 1 and kind in (4, 13)]

    main, exif = read("ifd0", number(4, "I"), "main"), None
    for owner, at in pointers(main, EXIF)[:1]:
        exif = read("exif", at, "Exif", owner)
    n = 0
    for owner, at in pointers(main, GPS) + pointers(exif, GPS):
        n += read(f"gps{n + 1}" if n else "gps", at, "GPS", owner) is not None
    for owner, at in pointers(exif, INTEROP)[:1]:
        read("interop", at, "Interop", owner)
    last = main
    for k in range(1, MAX_CHAIN + 1):
        last = last and read(f"ifd{k}", last[3], "preview" if k == 1 else "extra preview", chain=True)
    return ifds, warnings, not ifds


def directories(blocks: DataFrame, content: str = "content") -> DataFrame:
    """blocks with tiff: struct<ifds, warnings, damaged>, which replaces a column of that name: ifd0, the Exif directory, GPS directories wherever their pointer stands, Interop, and the chain of previews."""
    return blocks.withColumn("tiff", F.udf(walk, TIFF, useArrow=True)(F.col(content)))


def text_of(b: bytes, order: str, kind: int, count: int, size: int, at: int) -> str:
    """A valid value as text, as `value_text` has it."""
    raw = b[at : at + size]
    if kind == 2:
        return raw.partition(b"\0")[0].decode("latin-1")
    if kind == 129:
        return raw.decode("utf-8", "replace").partition("\0")[0]
    if kind not in PACKED:
        return raw.hex()
    half = kind in (5, 10)
    own = struct.unpack(f"{order}{2 * count if half else count}{PACKED[kind]}", raw)
    return ", ".join(f"{x}/{y}" for x, y in zip(own[::2], own[1::2])) if half else ", ".join(map(str, own))


def values(b: Column) -> Column:
    """array<struct<ifd, nth, tag, type, valid, value>>: the records of all directories of a block, values as text; null without a head."""

    def run(b: bytes | None) -> list[tuple] | None:
        found = walk(b)
        if found is None:
            return None
        order = "<" if b[:1] == b"I" else ">"
        return [(ifd[0], i, tag, kind, valid, text_of(b, order, kind, count, size, at) if valid else None) for ifd in found[0] for i, (tag, kind, count, size, at, valid) in enumerate(records(b, order, ifd[1], ifd[2]))]

    return F.udf(run, f"array<{VALUE}>", useArrow=True)(b)


def value_text(b: Column, e: Column) -> Column:
    """A value as text: letters up to the first zero byte, numbers and fractions with commas, other bytes in hex; null if it isn't valid."""

    def numbers(n: int, signed: bool) -> Column:
        def one(i: Column) -> Column:
            v = number(b, e["value_offset"] + i * n, n)
            return F.when(v >= 1 << (8 * n - 1), v - (1 << (8 * n))).otherwise(v) if signed else v

        return F.transform(F.sequence(F.lit(0).cast("long"), e["count"] - 1), lambda i: one(i).cast("string"))

    def fractions(signed: bool) -> Column:
        def half(at: Column) -> Column:
            v = number(b, at, 4)
            return (F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v) if signed else v).cast("string")

        return F.transform(F.sequence(F.lit(0).cast("long"), e["count"] - 1), lambda i: F.concat(half(e["value_offset"] + i * 8), F.lit("/"), half(e["value_offset"] + i * 8 + 4)))

    raw = cutout(b, e["value_offset"], e["size"])
    kinds = [(1, numbers(1, False)), (3, numbers(2, False)), (4, numbers(4, False)), (13, numbers(4, False)), (6, numbers(1, True)), (8, numbers(2, True)), (9, numbers(4, True)), (5, fractions(False)), (10, fractions(True))]
    out = F.when(~e["valid"], F.lit(None).cast("string")).when(e["count"] == 0, "").when(e["type"] == 2, F.substring_index(latin1(raw), "\x00", 1)).when(e["type"] == 129, F.substring_index(F.make_valid_utf8(raw.cast("string")), "\x00", 1))
    for kind, made in kinds:
        out = out.when(e["type"] == kind, F.array_join(made, ", "))
    return out.otherwise(F.lower(F.hex(raw)))


def field(tag: int, kind: int, count: Column | int, data: Column) -> Column:
    """A record to be written; data in the block's byte order."""
    return F.struct(F.lit(tag).alias("tag"), F.lit(kind).alias("type"), (F.lit(count) if isinstance(count, int) else count).cast("long").alias("count"), data.alias("data"))


def ordered_hex(little_endian: Column, v: Column, n: int) -> Column:
    h = F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    return F.when(little_endian, F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))))).otherwise(h)


def integer(little_endian: Column, v: Column | int, n: int) -> Column:
    """Bytes of an integer in a byte order."""
    return F.unhex(ordered_hex(little_endian, F.lit(v) if isinstance(v, int) else v, n))


def directory_size(fields: Column) -> Column:
    """The bytes that a directory of these fields takes, its longer values included."""
    return F.aggregate(fields, F.lit(6).cast("long"), lambda n, f: n + 12 + F.when(F.octet_length(f["data"]) > 4, F.octet_length(f["data"]) + F.octet_length(f["data"]) % 2).otherwise(0))


def directory(little_endian: Column, at: Column, fields: Column, follows: Column) -> Column:
    """A directory that stands at a place: its records by tag, the place of the next one, and values of more than four bytes behind it."""
    state = "struct<at: bigint, records: string, values: string>"

    def one(s: Column, f: Column) -> Column:
        n = F.octet_length(f["data"])
        head = F.concat(ordered_hex(little_endian, f["tag"], 2), ordered_hex(little_endian, f["type"], 2), ordered_hex(little_endian, f["count"], 4))
        inline = F.struct(s["at"], F.concat(s["records"], head, F.rpad(F.hex(f["data"]), 8, "0")), s["values"]).cast(state)
        apart = F.struct(s["at"] + n + n % 2, F.concat(s["records"], head, ordered_hex(little_endian, s["at"], 4)), F.concat(s["values"], F.hex(f["data"]), F.when(n % 2 == 1, "00").otherwise(""))).cast(state)
        return F.when(n <= 4, inline).otherwise(apart)

    begin = F.struct(at + 6 + F.size(fields) * 12, F.lit(""), F.lit("")).cast(state)
    made = F.aggregate(F.array_sort(fields, lambda x, y: x["tag"] - y["tag"]), begin, one)
    return let(made, lambda s: F.unhex(F.concat(ordered_hex(little_endian, F.size(fields), 2), s["records"], ordered_hex(little_endian, follows, 4), s["values"])))


def head(little_endian: Column, first: Column | int = 8) -> Column:
    return F.concat(F.when(little_endian, F.unhex(F.lit("49492A00"))).otherwise(F.unhex(F.lit("4D4D002A"))), integer(little_endian, first, 4))
