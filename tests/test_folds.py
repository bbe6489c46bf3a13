"""Matching, the search for a size, checksums and batches against plain loops."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from picmeta.functions import checksums, forms, text
from picmeta.operators import batch, listing, parts
from picmeta.plans import matching


def plain_match(entries, regions):
    media, used, out = [(i, r) for i, r in enumerate(regions) if r[0] in matching.MEDIA], set(), []

    def take(fits):
        for i, r in media:
            if i not in used and fits(r):
                used.add(i)
                return i
        return None

    for n, e in enumerate(entries):
        if n == 0:
            out.append(-1)
        elif e == "GainMap":
            got = take(lambda r: r[0] == "gainmap")
            out.append(got if got is not None else take(lambda r: r[0] not in ("video", "samsung")))
        elif e == "MotionPhoto":
            got = take(lambda r: r[0] == "video")
            out.append(got if got is not None else take(lambda r: r[0] == "samsung" and bool(r[1])))
        else:
            out.append(take(lambda r: r[0] != "samsung"))
    return out


def test_matched(spark):
    rng = random.Random(1)
    rows = [(0, [], []), (1, ["a"], []), (2, [], [("video", True)]), (3, ["a", None, "GainMap"], [("jpeg", None)])]
    rows += [(i, rng.choices(["GainMap", "MotionPhoto", "Original"], k=rng.randint(1, 7)), [(rng.choice([*matching.MEDIA, "unknown"]), rng.choice([True, False, None])) for _ in range(rng.randint(0, 6))]) for i in range(4, 120)]
    df = spark.createDataFrame(rows, "id int, e array<string>, r array<struct<kind: string, has_video: boolean>>")
    got = {r.id: r.m for r in df.select("id", matching.matched(F.col("e"), F.col("r")).alias("m")).collect()}
    assert got == {i: plain_match(e, r) for i, e, r in rows}
    assert df.select(matching.matched(F.lit(None).cast("array<string>"), F.col("r")).alias("m")).first().m is None


def test_search_finds_what_fits(spark):
    """Sizes fit where they can, never above the share of the limit; where nothing can, the smallest tried comes back."""
    rows = [(i, float(w), float(m)) for i, (w, m) in enumerate((w, m) for w in (64, 900, 4000, 12000) for m in (100, 5e3, 2e5, 1e6, 1e8))]
    df = spark.createDataFrame(rows, "id int, w double, m double")

    def size(s, q):
        return 400 + F.col("w") * F.col("w") * s * s * (0.4 if q is None else q * q * 0.3)

    for png in (True, False):
        for r in df.select("id", "w", "m", matching.fitted(size, F.col("w"), F.col("m"), png).alias("f")).collect():
            tiny = min(1.0, 64 / r.w)
            least = 400 + (r.w * tiny) ** 2 * (0.4 if png else 0.49 * 0.3)
            assert r.f.fitted == (least <= int(r.m * 0.95)) or (r.f.fitted is False and least > r.m * 0.5)
            assert not r.f.fitted or (r.f.size <= r.m * 0.95 and tiny <= r.f.scale <= 1)


def test_checksums(spark):
    rng = random.Random(2)
    rows = [(i, b) for i, b in enumerate([None, b"", b"a", b"\xff" * 9000, rng.randbytes(4096), rng.randbytes(4097), rng.randbytes(70_000), bytes(65_535)])]
    df = spark.createDataFrame(rows, "id int, b binary")
    got = {r.id: r for r in df.select("id", checksums.adler32(F.col("b")).alias("a"), checksums.zlib_stored(F.col("b")).alias("z"), checksums.adler32(F.col("b"), 7).alias("small")).collect()}
    for i, b in rows:
        if b is None:
            assert got[i].a is None and got[i].z is None
        else:
            assert got[i].a == got[i].small == zlib.adler32(b) and zlib.decompress(bytes(got[i].z)) == b


def test_batch(spark):
    rows = [(1, "12"), (2, "x"), (3, None), (4, "0"), (4, "5"), (None, "7")]
    df = spark.createDataFrame(rows, "path int, content string").withColumn("error", F.lit("old"))
    v = F.col("number")
    steps = [
        ("number", lambda: F.col("content").try_cast("int"), lambda: F.when(v.isNull(), "not a number")),
        ("share", lambda: F.lit(60) / F.nullif(v, F.lit(0)), lambda: F.when(F.col("share").isNull(), "no share")),
    ]
    tried = batch.attempted(df, steps)
    good, bad = batch.settled(tried).collect(), batch.failed(tried).collect()
    assert len(good) + len(bad) == len(rows)
    assert sorted((r.path or 0, r.number, r.share) for r in good) == [(0, 7, 60 / 7), (1, 12, 5.0), (4, 5, 12.0)]
    assert sorted((r.path, r.step, r.said) for r in bad) == [(2, "number", "not a number"), (3, "number", "not a number"), (4, "share", "no share")]


def test_values(spark):
    row = spark.range(1).select(
        text.leftover(F.lit(b"\0\0ab  cd\0 longest run \xff\0")).alias("left"),
        F.array(*(parts.green_chunk(F.lit("sCAL"), F.lit(b)) for b in (b"\x011.5\x002e3", b"\x031\x002", b"\x011", b"\x021\x00x", b""))).alias("scale"),
        F.array(*(forms.keyword_key(F.lit(k)) for k in ("Author", "Creation Time", "Warning", "GPSLatitude", "constructor"))).alias("keys"),
    ).first()
    assert (row.left.nonzero, row.left.text) == (20, "longest run")
    assert row.scale == [True, False, False, False, False] and row.keys == ["author", "dates", "notes", "gps", None]


def test_clashing_columns(spark):
    rows = spark.createDataFrame([("f", 1, "a", 7, 8, "old"), ("f", 2, "a", 7, 8, "old")], "path string, pos int, key string, nth int, skips int, id string")
    assert sorted((r.pos, r.id, r.nth, r.skips) for r in listing.suffixed(rows).collect()) == [(1, "a", 7, 8), (2, "a:2", 7, 8)]


@pytest.mark.parametrize(("tag", "key"), [(0x8828, "exposure"), (0x015B, "format"), (0x8769, "other"), (0x0201, "other"), (0xA462, "exposure"), (0xEA1D, "format")])
def test_tags(tag, key):
    assert [k for k, tags in forms.TAGS.items() if tag in tags] == [key]
