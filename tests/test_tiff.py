"""TIFF directories against a plain reader, on whole and damaged blocks."""

import random
import struct

from pyspark.sql import functions as F

from picmeta.functions import tiff
from picmeta.operators import queries_tiff

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 129: 1}


def plain(b):
    if b is None or len(b) < 8 or b[:4] not in (b"II*\0", b"MM\0*"):
        return None
    order = "<" if b[:1] == b"I" else ">"
    ifds, warnings, visited = [], [], set()

    def r(at, n):
        return struct.unpack(order + {2: "H", 4: "I"}[n], b[at : at + n])[0]

    def read(name, at, label, owner=(None, None, None), chain=False):
        if not at:
            return None
        if at < 8 or at + 2 > len(b) or at in visited:
            warnings.append(f"The {label} directory in the EXIF data points outside the data and was skipped.")
            return None
        visited.add(at)
        n = r(at, 2)
        if at + 2 + n * 12 > len(b):
            warnings.append(f"The {label} directory in the EXIF data is damaged and was skipped.")
            return None
        found = []
        for i in range(n):
            p = at + 2 + i * 12
            tag, kind, count = r(p, 2), r(p + 2, 2), r(p + 4, 4)
            size = SIZES.get(kind, 0) * count
            value = p + 8 if size <= 4 else r(p + 8, 4)
            found.append((i, tag, kind, count, size, size <= 4, value, kind in SIZES and size < 0x7FFFFFFF and (size <= 4 or (value >= 8 and value + size <= len(b)))))
        end = at + 2 + n * 12
        ifds.append(((name, at, n, r(end, 4) if end + 4 <= len(b) else 0, *owner, chain), found))
        return ifds[-1]

    def pointers(d, tag):
        return [(e[0], r(e[6], 4)) for e in d[1] if e[1] == tag and e[7] and e[3] == 1 and e[2] in (4, 13)] if d else []

    main = read("ifd0", r(4, 4), "main")
    if main:
        p = pointers(main, 0x8769)[:1]
        exif = read("exif", p[0][1], "Exif", ("ifd0", 0x8769, p[0][0])) if p else None
        n = 0
        for owner in (main, exif):
            for i, at in pointers(owner, 0x8825):
                n += read("gps" + (str(n + 1) if n else ""), at, "GPS", (owner[0][0], 0x8825, i)) is not None
        p = pointers(exif, 0xA005)[:1]
        if p:
            read("interop", p[0][1], "Interop", ("exif", 0xA005, p[0][0]))
        prev = main
        for k in range(1, 17):
            prev = read(f"ifd{k}", prev[0][3], "preview" if k == 1 else "extra preview", chain=True) if prev[0][3] else None
            if not prev:
                break
    return [d for d, _ in ifds], [e for _, e in ifds], warnings, not main


def block(rng):
    order, tags = rng.choice("<>"), [0x010F, 0x0112, 0x8769, 0x8825, 0xA005, 0x9003, 0x829A, 0x9999]
    b = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8))
    places = [8 + 70 * i for i in range(6)]
    for at in places:
        n = rng.randint(0, 5)
        b += b"\0" * (at - len(b)) + struct.pack(order + "H", n)
        for _ in range(n):
            tag = rng.choice(tags)
            pointer = tag in (0x8769, 0x8825, 0xA005)
            kind = rng.choice([4, 4, 4, 13, 3]) if pointer else rng.choice([1, 2, 3, 4, 5, 7, 9, 10, 13, 77, 129])
            b += struct.pack(order + "HHI", tag, kind, 1 if pointer else rng.choice([0, 1, 2, 5, 2**31])) + struct.pack(order + "I", rng.choice([*places, 9, 900]) if pointer else rng.choice([8, 30, 300, 70_000]))
        b += struct.pack(order + "I", rng.choice([0, 0, *places, 5000]))
    return bytes(b[: rng.choice([len(b), len(b), rng.randint(0, len(b))])])


def test_directories(spark):
    rng = random.Random(2)
    rows = [None, b"", b"II*\0", b"II*\0\0\0\0\0", b"MM\0*\0\0\0\x09"] + [block(rng) for _ in range(250)]
    cycle = b"MM\0*\0\0\0\x08" + b"\0\0" + b"\0\0\0\x0e" + b"\0\0" + b"\0\0\0\x08"
    chain = b"II*\0" + struct.pack("<I", 8) + b"".join(struct.pack("<HI", 0, 14 + 6 * i) for i in range(40))
    rows += [cycle, chain]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, b binary")
    df = tiff.directories(df.withColumn("tiff", F.lit(1)), "b").withColumnRenamed("tiff", "d")
    got = df.select("id", "d", F.transform("d.ifds", lambda i: tiff.entries(F.col("b"), i)).alias("e")).collect()
    for r in got:
        want = plain(rows[r.id])
        have = r.d and ([tuple(x) for x in r.d.ifds], [[tuple(y) for y in x] for x in r.e], list(r.d.warnings), r.d.damaged)
        assert have == want, (r.id, rows[r.id], have, want)
    assert sum(len(x[0]) > 3 for x in map(plain, rows) if x) > 10 and len(plain(chain)[0]) == 17


def test_build_and_read(spark):
    """A block is written in both byte orders and read again, values included."""
    for le in (True, False):
        order = F.lit(le)
        fields = F.array(
            tiff.field(0x0112, 3, 1, tiff.integer(order, 6, 2)), tiff.field(0x010F, 2, 6, F.lit(b"Maker\0")), tiff.field(0x829A, 5, 1, F.concat(tiff.integer(order, 1, 4), tiff.integer(order, 250, 4))),
            tiff.field(0x9204, 10, 1, F.concat(tiff.integer(order, 0xFFFFFFFE, 4), tiff.integer(order, 3, 4))), tiff.field(0x0102, 3, 3, F.concat(*(tiff.integer(order, 8, 2) for _ in range(3)))), tiff.field(0x9000, 7, 4, F.lit(b"0232")),
        )
        df = spark.range(1).select(F.concat(F.lit(b"Exif\0\0"), tiff.head(order), tiff.directory(order, F.lit(8), fields, F.lit(0))).alias("p")).select(tiff.first_block(F.col("p")).alias("b"), tiff.directory_size(fields).alias("n"))
        own = tiff.directories(df, "b").withColumnRenamed("tiff", "d").select("n", F.octet_length("b").alias("size"), F.transform(tiff.entries(F.col("b"), F.col("d.ifds")[0]), lambda e: F.struct(e["tag"], tiff.value_text(F.col("b"), e))).alias("e"))
        r = own.first()
        assert r.size == 8 + r.n and [tuple(x) for x in r.e] == [(0x0102, "8, 8, 8"), (0x010F, "Maker"), (0x0112, "6"), (0x829A, "1/250"), (0x9000, "30323332"), (0x9204, "-2/3")]


def test_values_and_tasks(spark, tmp_path):
    """values gives what entries and value_text give; a small table of customers is read by all tasks."""
    rng = random.Random(5)
    df = spark.createDataFrame([(i, block(rng)) for i in range(120)] + [(-1, None)], "id int, b binary")
    b = F.col("b")
    own = F.flatten(F.transform("tiff.ifds", lambda d: F.transform(tiff.entries(b, d), lambda e: F.struct(d["name"].alias("ifd"), e["index"].alias("nth"), e["tag"].alias("tag"), e["type"].alias("type"), e["valid"].alias("valid"), tiff.value_text(b, e).alias("value")))))
    rows = tiff.directories(df, "b").select("id", own.alias("want"), tiff.values(b).alias("got")).collect()
    assert all(r.want == r.got for r in rows) and sum(len(r.got or ()) for r in rows) > 300
    spark.range(500).selectExpr("id AS c_custkey", "'n' AS c_name", "1 AS c_nationkey", "'BUILDING' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert queries_tiff._made(spark, str(tmp_path)).rdd.getNumPartitions() >= 4
