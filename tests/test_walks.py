"""Walks over bytes against plain loops, on whole, damaged and random content."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from picmeta.functions import walks

SIGN = b"\x89PNG\r\n\x1a\n"


def png_chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def riff_chunk(kind, data):
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def riff(*chunks):
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def named(b, q):
    return len(b[q : q + 4]) == 4 and all(65 <= x <= 90 or 97 <= x <= 122 for x in b[q : q + 4])


def u32(b, q):
    return struct.unpack(">I", b[q : q + 4])[0]


def plain_png(b):
    def header(q):
        return q + 12 <= len(b) and named(b, q + 4) and q + 12 + u32(b, q) <= len(b)

    def intact(q):
        n = u32(b, q)
        return zlib.crc32(b[q + 4 : q + 8 + n]) == u32(b, q + 8 + n)

    at, parts = 8, []
    while at + 12 <= len(b) and at + 12 + u32(b, at) <= len(b):
        n = u32(b, at)
        end, data_end, bad, again = at + 12 + n, at + 8 + n, not named(b, at + 4), False
        ok = not bad and intact(at)
        if not bad and not ok:
            for q in range(at + 8, min(end, len(b) - 12) + 1):
                if header(q) and (intact(q) or (header(x := q + 12 + u32(b, q)) and intact(x))):
                    end, data_end, again = q, q - 4 if q - 4 >= at + 8 else q, True
                    break
        kind = b[at + 4 : at + 8].decode("latin1")
        parts.append((kind, at, at + 8, data_end, end, bad, ok, again))
        at = end
        if kind == "IEND":
            break
    return at, parts


def plain_riff(b):
    known = (b"VP8 ", b"VP8L", b"VP8X", b"ALPH", b"ANIM", b"ANMF", b"ICCP", b"EXIF", b"XMP ", b"C2PA")
    if len(b) < 8:
        return None
    end = min(len(b), 8 + struct.unpack("<I", b[4:8])[0])
    at, parts = 12, []

    def tiles(q):
        if b[q : q + 4] not in known:
            return False
        while q + 8 <= end:
            if not all(32 <= x <= 126 for x in b[q : q + 4]):
                return False
            n = struct.unpack("<I", b[q + 4 : q + 8])[0]
            if q + 8 + n + n % 2 > end + n % 2:
                return False
            q = min(q + 8 + n + n % 2, end)
            if q == end:
                return True
        return q == end

    while at + 8 <= end:
        kind, n = b[at : at + 4], struct.unpack("<I", b[at + 4 : at + 8])[0]
        if kind == b"VP8X" and at + 18 <= end:
            n = 10
        to, broken = at + 8 + n, False
        stop = min(end, to + n % 2)
        if to > end:
            broken, to = True, next((q for q in range(at + 8, end - 7) if tiles(q)), end)
            stop = to
        parts.append((kind.decode("latin1"), at, at + 8, to, stop, broken))
        at = stop
    return at, parts


def plain_sets(b):
    def fits(q):
        return q + 5 <= len(b) and b[q] == 0x1C and 1 <= b[q + 1] <= 9

    at, parts = 0, []
    while at + 5 <= len(b):
        if b[at] == 0:
            at += 1
        elif b[at] != 0x1C:
            q = at + 1
            while q < len(b) and not fits(q):
                q += 1
            parts.append((True, None, None, at, None, None, q))
            at = q
        else:
            n, data = struct.unpack(">H", b[at + 3 : at + 5])[0], at + 5
            if n & 0x8000:
                k = n & 0x7FFF
                if k > 4 or data + k > len(b):
                    n = 1 << 40
                else:
                    n, data = int.from_bytes(b[data : data + k], "big"), data + k
            if data + n > len(b):
                parts.append((True, None, None, at, None, None, len(b)))
                at = len(b)
                break
            parts.append((False, b[at + 1], b[at + 2], at, data, data + n, data + n))
            at = data + n
    if any(b[at:]):
        parts.append((True, None, None, at, None, None, len(b)))
    return parts


def plain_resources(b):
    at, parts = 0, []
    while at + 12 <= len(b) and b[at : at + 4] in (b"8BIM", b"MeSa", b"PHUT", b"AgHg", b"DCSR"):
        q = at + 7 + b[at + 6] + (b[at + 6] + 1) % 2
        if q + 4 > len(b) or q + 4 + u32(b, q) > len(b):
            break
        n = u32(b, q)
        end = min(len(b), q + 4 + n + n % 2)
        parts.append((struct.unpack(">H", b[at + 4 : at + 6])[0], at, q + 4, q + 4 + n, end))
        at = end
    return at, parts


def walk_of(spark, rows, walk):
    df = spark.createDataFrame(list(enumerate(rows)), "id int, b binary")
    got = {r.id: r.w for r in df.select("id", walk(F.col("b")).alias("w")).collect()}
    return [None if got[i] is None else (got[i].stop, [tuple(p) for p in got[i].parts]) for i in range(len(rows))]


def pngs(rng):
    files = [SIGN, b"", SIGN + b"\0" * 11, SIGN + b"\0" * 40, None]
    for _ in range(60):
        chunks = [png_chunk(b"IHDR", bytes(13))] + [png_chunk(rng.choice([b"tEXt", b"IDAT", b"prVt", b"t3Xt"]), rng.randbytes(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))]
        b = bytearray(SIGN + b"".join(chunks) + png_chunk(b"IEND", b"") + rng.randbytes(rng.choice([0, 9])))
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(8, len(b))] = rng.choice([0, 1, 7, 65, 255])
        files.append(bytes(b[: rng.choice([len(b), len(b), rng.randint(8, len(b))])]))
    many = SIGN + b"".join(png_chunk(b"tEXt", b"%d" % i) for i in range(1500)) + png_chunk(b"IEND", b"")
    swallowing = bytearray(SIGN + b"".join(png_chunk(b"tEXt", bytes([65 + i % 20]) * 3000) for i in range(9)) + png_chunk(b"IEND", b""))
    swallowing[8:12] = struct.pack(">I", 20_000)
    return [*files, many, bytes(swallowing)]


def test_png_walk(spark):
    rows = pngs(random.Random(4))
    assert walk_of(spark, rows, walks.png_walk) == [None if b is None else plain_png(b) for b in rows]


def test_riff_walk(spark):
    rng = random.Random(8)
    rows = [riff(), b"RIFF", None, riff(riff_chunk(b"VP8 ", b"abc"))[:-1]]
    for _ in range(60):
        chunks = [riff_chunk(rng.choice([b"VP8 ", b"EXIF", b"XMP ", b"abcd", b"VP8X"]), rng.randbytes(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        b = bytearray(riff(*chunks) + rng.randbytes(rng.choice([0, 5])))
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(12, len(b))] = rng.choice([0, 1, 7, 65, 255])
        rows.append(bytes(b))
    got = walk_of(spark, rows, walks.riff_walk)
    assert [x if b and len(b) >= 8 else None for b, x in zip(rows, got, strict=True)] == [plain_riff(b) if b else None for b in rows]


def test_set_walk(spark):
    rng = random.Random(9)
    rows = [b"", None, b"\0\0\0", b"\0\0\0\0\0\0\0x", b"\x1c\x02\x05\x80\x00", b"\x1c\x02\x05\x80\x02\x00\x03abcd", b"\x1c\x02\x05\x80\x05aaaaaaa"]
    for _ in range(80):
        b = b"".join(rng.choice([b"\x1c" + bytes([rng.randint(1, 9), rng.randint(0, 120)]) + struct.pack(">H", n := rng.randint(0, 9)) + rng.randbytes(n), bytes(rng.randint(0, 3)), b"junk\x1c"]) for _ in range(rng.randint(1, 7)))
        rows.append(b[: rng.choice([len(b), rng.randint(0, len(b))])])
    assert [x and x[1] for x in walk_of(spark, rows, walks.set_walk)] == [None if b is None else plain_sets(b) for b in rows]


def test_resource_walk(spark):
    rng = random.Random(10)
    rows = [b"", None, b"8BIM"]
    for _ in range(60):
        b = b""
        for _ in range(rng.randint(1, 6)):
            name, data = rng.randbytes(rng.randint(0, 5)), rng.randbytes(rng.randint(0, 9))
            b += rng.choice([b"8BIM", b"DCSR", b"AgHg", b"nope"]) + struct.pack(">HB", rng.randrange(5000), len(name)) + name + b"\0" * ((len(name) + 1) % 2) + struct.pack(">I", len(data)) + data + b"\0" * (len(data) % 2)
        rows.append(b[: rng.choice([len(b), rng.randint(0, len(b))])])
    assert walk_of(spark, rows, walks.resource_walk) == [None if b is None else plain_resources(b) for b in rows]


def rewritten(spark, b, changes, cut, walk, write):
    df = spark.createDataFrame([(bytes(b), changes, cut)], "b binary, c map<int, binary>, cut boolean")
    return bytes(df.select(write(F.col("b"), walk(F.col("b")), F.col("c"), F.col("cut")).alias("x")).first().x)


@pytest.mark.parametrize("cut", [True, False])
def test_png_rewritten(spark, cut):
    own = [png_chunk(b"IHDR", bytes(13)), png_chunk(b"tEXt", b"a\0one"), png_chunk(b"IDAT", b"pixels"), png_chunk(b"tEXt", b"b\0two"), png_chunk(b"IEND", b"")]
    changes = {0: None, 1: b"a\0new text", 3: None}  # the head of the picture stays
    want = SIGN + own[0] + png_chunk(b"tEXt", b"a\0new text") + own[2] + own[4] + (b"" if cut else b"tail")
    assert rewritten(spark, SIGN + b"".join(own) + b"tail", changes, cut, walks.png_walk, walks.png_rewritten) == want
    short = SIGN + b"".join(own)[:-20]  # cut in the last text
    assert rewritten(spark, short, {1: None}, cut, walks.png_walk, walks.png_rewritten) == SIGN + own[0] + own[2] + (own[4] if cut else own[3][:-8])
    assert rewritten(spark, SIGN + b"".join(own), None, cut, walks.png_walk, walks.png_rewritten) == SIGN + b"".join(own)


def test_riff_rewritten(spark):
    x = riff_chunk(b"VP8X", b"\x2c" + bytes(9))
    own = [x, riff_chunk(b"ICCP", b"icc"), riff_chunk(b"VP8 ", b"pixel"), riff_chunk(b"EXIF", b"exif"), riff_chunk(b"XMP ", b"xmp")]
    want = riff(riff_chunk(b"VP8X", b"\x24" + bytes(9)), *own[1:3], riff_chunk(b"XMP ", b"other"))
    assert rewritten(spark, riff(*own) + b"tail", {2: None, 3: None, 4: b"other"}, True, walks.riff_walk, walks.riff_rewritten) == want
    assert rewritten(spark, riff(*own) + b"tail", {}, False, walks.riff_walk, walks.riff_rewritten) == riff(*own) + b"tail"


def test_png_warnings(spark):
    good, wrong = png_chunk(b"IDAT", b"x"), png_chunk(b"tEXt", b"y")[:-1] + b"\0"
    files = [SIGN + good + png_chunk(b"IEND", b""), SIGN + wrong + png_chunk(b"IEND", b""), SIGN + wrong + wrong + good[:-1], SIGN + png_chunk(b"1234", b"") + png_chunk(b"IEND", b"")]
    df = spark.createDataFrame(list(enumerate(files)), "id int, b binary")
    got = [r.w for r in df.select("id", walks.png_warnings(F.col("b"), walks.png_walk(F.col("b"))).alias("w")).orderBy("id").collect()]
    assert got == [[], ["The tEXt chunk has a wrong checksum."], ["The PNG file is damaged or cut short at the end.", "2 parts of the file have a wrong checksum."], ["The PNG file has a part with a damaged name."]]
