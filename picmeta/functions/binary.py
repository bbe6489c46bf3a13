"""Bytes as columns: integers, text encodings, search, checksums, formats. All built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first bytes of a PNG, and the brands of pictures in an ISO box file.
PNG = "89504E470D0A1A0A"
BRANDS = ("heic", "heix", "heim", "heis", "hevc", "hevx", "hevm", "hevs")


def bytes_of(value: Column) -> Column:
    """BINARY of text or bytes."""
    return value.cast("binary")


def hexed(b: Column, at: int | Column, n: int) -> Column:
    """n bytes from place `at` (from 0) as hex; shorter at the end."""
    return F.hex(F.substring(b, at + 1, n))


def big(b: Column, at: int | Column, n: int) -> Column:
    """An unsigned integer of n bytes, most significant first; null if the bytes aren't all there."""
    h = hexed(b, at, n)
    return F.when(F.length(h) == 2 * n, F.conv(h, 16, 10).cast("decimal(20,0)").cast("long"))


def little(b: Column, at: int | Column, n: int) -> Column:
    """The same, least significant first."""
    h = hexed(b, at, n)
    turned = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))))
    return F.when(F.length(h) == 2 * n, F.conv(turned, 16, 10).cast("decimal(20,0)").cast("long"))


def written(v: Column, n: int) -> Column:
    """v as n bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(v), 2 * n, "0"))


def latin1(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def utf8(b: Column) -> Column:
    """Text of UTF-8; bad bytes become U+FFFD, a leading byte order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(b.cast("string")), "^﻿", "")


def utf8_or_latin1(b: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(b.cast("string")), latin1(b))


def utf16(b: Column) -> Column:
    """Text of UTF-16 by its byte order mark, big-endian without one."""
    mark = hexed(b, 0, 2)
    rest = F.substring(b, 3, 1 << 30)
    return F.when(mark == "FFFE", F.decode(rest, "UTF-16LE")).when(mark == "FEFF", F.decode(rest, "UTF-16BE")).otherwise(F.decode(b, "UTF-16BE"))


def c_string(text: Column) -> Column:
    """Up to the first NUL."""
    return F.substring_index(text, "\x00", 1)


def place_of(b: Column, what: str) -> Column:
    """The place of ASCII text in bytes, from 0; -1 if it isn't there."""
    return (F.instr(latin1(b), what) - 1).cast("int")


def hex_lines(b: Column, per_line: int = 36) -> Column:
    """Lower-case hex with a line end after every per_line bytes."""
    return F.regexp_replace(F.lower(F.hex(b)), f"(.{{{2 * per_line}}})", "$1\n")


def blank(b: Column) -> Column:
    """Whether all bytes are zero."""
    return ~F.hex(b).rlike("[1-9A-F]")


def zeroed(b: Column, s: Column, e: Column) -> Column:
    """b with the bytes from s to e (from 0, e not included) set to zero; ranges beyond b's ends are cut."""
    n = F.octet_length(b)
    s, e = F.least(F.greatest(s, F.lit(0)), n), F.least(F.greatest(e, F.lit(0)), n)
    zeros = F.unhex(F.repeat(F.lit("00"), F.greatest(e - s, F.lit(0)).cast("int")))
    return F.concat(F.substring(b, F.lit(1), s), zeros, F.substring(b, F.greatest(s, e) + 1, n))


def file_format(b: Column) -> Column:
    """jpeg, png, webp or heic by the first bytes; null for others."""
    box = big(b, 0, 4)
    brands = F.filter(F.sequence(F.lit(8), F.greatest(F.least(box, F.octet_length(b)) - 4, F.lit(8)).cast("int"), F.lit(4)), lambda i: i != 12)
    heic = (hexed(b, 4, 4) == "66747970") & (box >= 16) & (box <= F.octet_length(b)) & F.exists(brands, lambda i: latin1(F.substring(b, i + 1, F.lit(4))).isin(*BRANDS))
    return (
        F.when(hexed(b, 0, 3) == "FFD8FF", "jpeg")
        .when(hexed(b, 0, 8) == PNG, "png")
        .when((hexed(b, 0, 4) == "52494646") & (hexed(b, 8, 4) == "57454250"), "webp")
        .when(heic, "heic")
    )


def png_chunk(kind: Column, data: Column) -> Column:
    """length, kind, data, CRC."""
    both = F.concat(kind.cast("binary"), data)
    return F.concat(written(F.octet_length(data), 4), both, written(F.crc32(both), 4))


def png_text(keyword: Column, value: Column) -> Column:
    """A tEXt chunk."""
    return png_chunk(F.lit("tEXt"), F.concat(F.encode(keyword, "ISO-8859-1"), F.unhex(F.lit("00")), F.encode(value, "ISO-8859-1")))


def jpeg_segment(marker: int, payload: Column) -> Column:
    """FF, marker, length, payload; null if the payload doesn't fit."""
    n = F.octet_length(payload)
    return F.when(n <= 65533, F.concat(F.unhex(F.lit(f"FF{marker:02X}")), written(n + 2, 2), payload))


def raw_profile(text: Column) -> Column:
    """The bytes of a text profile: kind, length and hex on lines of their own; null if it is none or too short."""
    n = F.regexp_extract(text, r"^\s*[^\n]*\n\s*(\d+)\n", 1).try_cast("int")
    h = F.regexp_replace(F.regexp_extract(text, r"(?s)^\s*[^\n]*\n\s*\d+\n(.*)$", 1), "[^0-9a-fA-F]", "")
    return F.when(F.floor(F.length(h) / 2) >= n, F.unhex(F.substring(h, F.lit(1), 2 * n)))


def iso_gain_length(b: Column) -> Column:
    """The length of a gain-map block by its flags: 4 for a bare version, null if it is damaged."""
    flags = big(b, 4, 1)
    channels = F.when(flags.bitwiseAND(0x80) != 0, 3).otherwise(1)
    length = 5 + F.when(flags.bitwiseAND(0x08) != 0, 12 + channels * 20).otherwise(16 + channels * 40)
    n = F.octet_length(b)
    return F.when((n < 4) | (big(b, 0, 2) != 0), None).when(n == 4, 4).when((flags.bitwiseAND(0x33) == 0) & (n >= length), length)


def gathered(b: Column, ranges: Column) -> Column:
    """The bytes of an array of ranges (s, e), one after the other."""
    return F.aggregate(F.transform(ranges, lambda r: F.substring(b, (r["s"] + 1).cast("int"), (r["e"] - r["s"]).cast("int"))), F.unhex(F.lit("")), lambda a, x: F.concat(a, x))
