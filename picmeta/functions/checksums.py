"""Adler-32 as sums that combine, and zlib streams without compression. The sums of bytes are taken by zlib in Arrow batches; a fold of Spark over single bytes takes some hundred times as long."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from picmeta.functions.binary import written
from picmeta.functions.walks import cutout, let

BASE = 65521
CHUNK = 1 << 20
STORED = 65535

SUMS = "struct<n: bigint, a: bigint, b: bigint>"


def adler_parts(content: Column, size: int | None = None) -> Column:
    """n, the sum of the bytes and their sum weighted by place (the last byte counts once), both mod BASE, of each run of `size` bytes (without it of all), in order."""

    def sums(b: bytes | None) -> list[tuple[int, int, int]] | None:
        if b is None:
            return None
        runs = [b[i : i + size] for i in range(0, len(b), size)] or [b""] if size else [b]
        # zlib's first sum begins with 1, and its second has that 1 for each byte
        return [(len(x), ((v := zlib.adler32(x)) % 65536 - 1) % 65521, ((v >> 16) - len(x)) % 65521) for x in runs]

    return F.udf(sums, f"array<{SUMS}>", useArrow=True)(content)


def joined_sums(left: Column, right: Column) -> Column:
    """The sums of two stretches of bytes, one behind the other."""
    return F.struct(left["n"] + right["n"], (left["a"] + right["a"]) % BASE, (left["b"] + right["b"] + right["n"] % BASE * left["a"]) % BASE).cast(SUMS)


def adler_value(sums: Column) -> Column:
    a, b = (1 + sums["a"]) % BASE, (sums["n"] % BASE + sums["b"]) % BASE
    return b * 65536 + a


def adler32(content: Column, size: int = CHUNK) -> Column:
    """The checksum of zlib streams, from sums by chunk; null for null."""
    none = F.struct(F.lit(0), F.lit(0), F.lit(0)).cast(SUMS)
    return F.when(content.isNotNull(), let(F.aggregate(adler_parts(content, size), none, joined_sums), adler_value))


def zlib_stored(content: Column) -> Column:
    """A zlib stream of stored blocks: head, blocks of up to STORED bytes, the checksum."""
    n = F.octet_length(content)
    last = F.greatest(F.ceil(n / STORED) - 1, F.lit(0)).cast("int")

    def block(k: Column) -> Column:
        size = F.least(F.lit(STORED), n - k * STORED)

        def turned(v: Column) -> Column:
            h = F.lpad(F.hex(v.cast("long")), 4, "0")
            return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))

        return F.concat(F.when(k == last, "01").otherwise("00"), turned(size), turned(65535 - size), F.hex(cutout(content, k * STORED, STORED)))

    blocks = F.array_join(F.transform(F.sequence(F.lit(0), last), block), "")
    return F.unhex(F.concat(F.lit("7801"), blocks, F.hex(written(adler32(content), 4))))
