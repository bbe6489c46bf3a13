"""Work that must not grow faster than its input."""

import time
import zlib

from pyspark.sql import functions as F

from picmeta.functions import checksums, markup
from picmeta.operators import chunks, graph


def test_adler_of_a_long_file(spark):
    b, begun = bytes(range(256)) * (1 << 16), time.time()
    got = spark.createDataFrame([(b,)], "b binary").select(checksums.adler32(F.col("b")).alias("a")).first()
    assert got.a == zlib.adler32(b) and time.time() - begun < 30


def _png(n):
    def chunk(kind, data):
        return len(data).to_bytes(4) + kind + data + zlib.crc32(kind + data).to_bytes(4)

    return bytes.fromhex("89504e470d0a1a0a") + b"".join(chunk(b"tEXt", b"k%d\0" % i + b"x" * 40) for i in range(n)) + chunk(b"IDAT", b"p") + chunk(b"IEND", b"")


def _rewritten(spark, n):
    files = chunks.walked(spark.createDataFrame([(1, _png(n))], "path long, content binary"))
    return chunks.rewritten(files, spark.createDataFrame([(1, 3)], "path long, pos int"), spark.createDataFrame([(1, 5, b"new")], "path long, pos int, data binary"), F.lit(True))


def test_read_back_of_many_chunks(spark):
    begun = time.time()
    r = chunks.read_back(_rewritten(spark, 20_000)).first()
    assert (r.parts, r.parts_after, r.unchanged_kept, r.pixels_same) == (20_002, 20_001, True, True) and time.time() - begun < 40


def test_children_broadcast_nothing(spark, capsys):
    p = spark.range(100).select(F.col("id").alias("path"), "id", F.lit("t").alias("tag"), F.col("id").alias("at"))
    graph.children(p, p, p.select("path", "at", F.lit("c").alias("table"))).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_tags_inside_many_others(spark):
    page, begun = "<div>" * 250 + "<i></i>" * 60_000 + "</div>" * 250, time.time()
    r = spark.createDataFrame([(page,)], "t string").select(markup.parts(F.col("t")).alias("p")).select(F.size("p").alias("n"), F.element_at("p", -1).alias("last"), F.expr("p[300].depth").alias("deep")).first()
    assert (r.n, r.last.closes, r.deep) == (120_500, 0, 250) and time.time() - begun < 15
