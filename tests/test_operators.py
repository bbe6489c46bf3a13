"""Operators that the driver's tables don't reach: files, formats, streams, and odd cases of the others."""

import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from picmeta.functions import binary, forms, text
from picmeta.operators import audit, graph, intervals, listing
from picmeta.plans import policy
from picmeta.sources import files
from picmeta.streaming import state

HEIC = struct.pack(">I4s4sI4s", 20, b"ftyp", b"mif1", 0, b"heix") + b"rest"
FILES = {"a.jpg": b"\xff\xd8\xff\xe0rest", "b.png": bytes.fromhex("89504e470d0a1a0a") + b"x", "c.webp": b"RIFF\x00\x00\x00\x00WEBPVP8 ", "d.heic": HEIC, "e.txt": b"plain", "g.heic": HEIC.replace(b"heix", b"avif"), "h.webp": b"RIFF\x00\x00"}
FORMATS = {"a.jpg": "jpeg", "b.png": "png", "c.webp": "webp", "d.heic": "heic"}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_files_and_formats(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content)
    got = files.files(spark, str(tmp_path))
    assert {r.path.rpartition("/")[2]: r.format for r in got.collect()} == {n: FORMATS.get(n) for n in FILES}
    expected = spark.createDataFrame([(f"file:{tmp_path}/a.jpg",), (f"file:{tmp_path}/e.txt",), ("file:/gone.jpg",)], "path string")
    assert {r.path.rpartition("/")[2] for r in files.missing(expected, got).collect()} == {"e.txt", "gone.jpg"}
    (tmp_path / "registry.tsv").write_text("string\tkind\tfile\n\"quoted\" text\tname\ta.jpg\n")
    assert files.registry(spark, str(tmp_path / "registry.tsv"), "string STRING, kind STRING, file STRING").collect() == [Row(string='"quoted" text', kind="name", file="a.jpg")]
    stream = files.arriving(spark, str(tmp_path), "*.[jp]*g").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    stream.awaitTermination(60)
    assert {r.format for r in spark.table("arrived").collect()} == {"jpeg", "png"}
    files.report(got.select("path", "format"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/json")).count() == len(FILES)
    assert one(spark, files.acceptable(F.lit("content://other/1"), "own")) and not one(spark, files.acceptable(F.lit("content://own/1"), "own"))


def test_bytes(spark):
    b = F.lit(bytes(range(250, 256)) + b"\x00\x01")
    assert one(spark, binary.big(b, 0, 4)) == 0xFAFBFCFD and one(spark, binary.little(b, 4, 4)) == 0x0100FFFE and one(spark, binary.big(b, 6, 4)) is None
    assert one(spark, binary.utf8(F.lit(b"\xef\xbb\xbfab\xff"))) == "ab�" and one(spark, binary.utf8_or_latin1(F.lit(b"\xe9"))) == "é"
    assert one(spark, binary.utf16(F.lit(b"\xff\xfea\x00"))) == one(spark, binary.utf16(F.lit(b"\x00a"))) == "a"
    assert bytes(one(spark, binary.zeroed(F.lit(b"abcdef"), F.lit(-2), F.lit(2)))) == b"\0\0cdef" and bytes(one(spark, binary.zeroed(F.lit(b"abc"), F.lit(2), F.lit(9)))) == b"ab\0"
    assert one(spark, binary.hex_lines(F.lit(bytes(37)))) == "00" * 36 + "\n00" and one(spark, binary.blank(F.lit(bytes(3))))
    assert [one(spark, binary.iso_gain_length(F.lit(x))) for x in (bytes(4), bytes(4) + b"\x08" + bytes(60), bytes(4) + b"\x80" + bytes(136), bytes(4) + b"\x01" + bytes(90), b"\0\1\0\0", b"\0")] == [4, 37, 141, None, None, None]
    made = spark.range(1).select(binary.gathered(F.lit(b"abcdef"), F.array(F.struct(F.lit(4).alias("s"), F.lit(6).alias("e")), F.struct(F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x")).first().x
    assert bytes(made) == b"efa" and one(spark, binary.raw_profile(F.lit("\nexif\n 9\nabcd\n"))) is None
    assert one(spark, forms.png_time(F.lit(struct.pack(">HBBBBB", 2024, 12, 31, 23, 59, 60)))) and not one(spark, forms.png_time(F.lit(bytes(7))))


def test_text(spark):
    long_ = "word " * 30
    assert one(spark, text.clip(F.lit(f" a\x00\x01b\n\n{long_}"))) == ("a b " + long_)[:77].rstrip() + "..."
    assert [one(spark, text.short_size(F.lit(n))) for n in (999, 1000, 1234, 45_600, 2_000_000, 31_500_000)] == ["999 bytes", "1 KB", "1.2 KB", "46 KB", "2 MB", "32 MB"]
    assert one(spark, text.listed(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c" and one(spark, text.listed(F.array().cast("array<string>"))) == ""
    assert one(spark, text.headroom(F.lit(0.8), F.lit(0.005))) == pytest.approx(2 ** (1.8 - 0.1)) and one(spark, text.headroom(F.lit(1.2), F.lit(8.0))) is None
    assert one(spark, text.clean_name(F.lit("..:"))) == "image" and one(spark, text.clean_name(F.lit("a/b.clean.jpeg"))) == "a-b"
    names = {"GPSLatitude": "gps", "Owner Software": None, "owner": "author", "HostComputer": "computer", "id": "ids", "x": None}
    assert {n: one(spark, forms.named_key(F.lit(n))) for n in names} == names
    good = {"Canon EOS 5D": True, "a  b": False, "a ": False, "": False, "x@y": False, "www.x": False, "a\tb": False, "ä️": False}
    assert {n: one(spark, forms.device_name(F.lit(n))) for n in good} == good


def test_lists(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "a:2"), (1, 4, "a"), (2, 1, "a:2")], "path int, pos int, key string")
    got = {(r.path, r.pos): r.id for r in listing.suffixed(rows).collect()}
    assert got == {(1, 1): "a", (1, 2): "a:3", (1, 3): "a:2", (1, 4): "a:4", (2, 1): "a:2"}
    w = spark.createDataFrame([(1, i, f"w{i % 45}") for i in range(90)], "path int, pos int, text string")
    last = [r.text for r in listing.warned(w).collect() if r.nth == 41]
    assert last == ["There were 10 more problems with this file."] and listing.warned(w).count() == 41


def test_ranges_over_many_parts(spark):
    """Narrow parts give what one part gives, for one hot key."""
    import random

    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice((1, 1, 1, None)), s, s + rng.randrange(0, 90)) for s in (rng.randrange(5000) for _ in range(700))], "k int, s long, e long").cache()
    minus = df.filter("s % 3 = 0")
    for f in (lambda w: intervals.merge(df, "k", w), lambda w: intervals.subtract(df, minus, "k", w), lambda w: intervals.gaps(df, "k", w)):
        assert sorted(map(str, f(16).collect())) == sorted(map(str, f(1 << 40).collect()))


def test_deep_references(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(5)] + [(1, 5, 0)], "path int, src int, dst int")
    start = spark.createDataFrame([(1, 2)], "path int, id int")
    assert {(r.id, r.depth) for r in graph.reached(start, edges).collect()} == {(2, 0), (3, 1), (4, 2), (5, 3), (0, 4), (1, 5)}
    with pytest.raises(ValueError, match="deeper"):
        graph.reached(start, edges, 3)


def test_plans(spark):
    o = spark.createDataFrame([("same", "none", None, None, None), ("gif", "none", None, None, None), ("png", "percent", 120.0, None, None), ("png", "edge", 0.0, None, None), ("png", "edge", 9.0, 0, 5)], "format string, mode string, value double, crop_w int, crop_h int")
    assert [bool(r.problem) for r in policy.validated(o).collect()] == [False, True, True, True, True]
    assert one(spark, policy.workable(F.lit(40000), F.lit(20000), 16384, 16777216)) == Row(w=5786, h=2893)
    assert one(spark, policy.fitted(F.lit(400), F.lit(100), F.lit(200), F.lit(200))) == Row(w=200, h=50)
    assert one(spark, policy.largest_with(F.lit(400), F.lit(100), F.lit(1.0))) == Row(x=150.0, y=0.0, w=100.0, h=100.0)
    assert one(spark, policy.idle_text(F.lit(False), F.lit(True), F.lit(True), F.lit(True))) == "Nothing to change yet: the picture is already under the size limit. Tick something to remove, or choose a size or format."
    assert one(spark, policy.damaged(F.array(F.lit("The file is cut short.")), F.array(F.lit("x")))) and not one(spark, policy.damaged(F.array(F.lit("ok")), F.array(F.lit("x"))))
    assert one(spark, policy.unchanged(F.lit(0), F.lit(False), F.lit(False), F.lit(None).cast("int"), F.lit(5)))


def test_planted_items_of_any_length(spark):
    from picmeta.operators.text_ops import planted

    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "x two"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three four five six"), (2, "two"), (3, "not there at all here"), (4, None)], "item_id long, text string")
    assert {(r.item_id, r.doc_id) for r in planted(docs, items).collect()} == {(1, 1), (2, 1), (2, 2)}
    assert audit.found(docs.select(F.col("doc_id").alias("path"), F.encode("text", "UTF-16BE").alias("content")), items.select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))).filter("encoding = 'UTF-16BE'").count() == 3


def test_chunk_stream(spark, tmp_path):
    rows = [("a", 0, 5, 9), ("a", 1, 4, 9), ("b", 1, 5, 9), ("c", 0, 0, 9), ("d", 0, 3, 9)]
    spark.createDataFrame(rows, "file string, idx int, size int, total int").coalesce(1).write.parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema("file string, idx int, size int, total int").parquet(str(tmp_path / "in"))
    q = state.assembling(chunks).writeStream.format("memory").queryName("chunks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(90)
    assert {(r.file, r.status) for r in spark.table("chunks").collect()} == {("a", "whole"), ("b", "broken"), ("c", "broken")}
