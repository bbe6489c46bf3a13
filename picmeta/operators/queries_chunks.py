"""Files of chunks made of documents, some of them damaged, walked and written again; with SQL that knows the files by how they are made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from picmeta.functions.binary import PNG, png_chunk, written
from picmeta.functions.walks import png_warnings
from picmeta.operators import chunks

RED = "@|token"
NAMED = "[Ll]icen[sc]e"


def made(docs: DataFrame) -> DataFrame:
    """(path, content): a picture file of each document, its lines as text chunks. In every seventh, by turns, a checksum is zero, a length is too long, the end is missing, a name is damaged."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: _text_chunk(x, i))
    way = F.when(F.col("doc_id") % 7 == 0, F.floor(F.col("doc_id") / 7) % 4)
    first = F.col("lines")[0]
    n = F.octet_length(first)
    damaged = (
        F.when(way == 0, F.concat(F.substring(first, F.lit(1), n - 4), F.unhex(F.lit("00000000"))))
        .when(way == 1, F.concat(written(n - 12 + 7, 4), F.substring(first, F.lit(5), n)))
        .when(way == 3, F.concat(F.substring(first, 1, 4), F.lit(b"t3Xt"), F.substring(first, F.lit(9), n)))
        .otherwise(first)
    )
    texts = F.unhex(F.array_join(F.transform("lines", lambda x, i: F.hex(F.when(i == 0, damaged).otherwise(x))), ""))
    head = F.concat(F.unhex(F.lit(PNG)), png_chunk(F.lit("IHDR"), F.concat(written(F.col("doc_id"), 8), F.unhex(F.lit("0802000000")))))
    data = F.concat(png_chunk(F.lit("IDAT"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).cast("binary")), png_chunk(F.lit("IDAT"), F.coalesce("source", F.lit("")).cast("binary")), png_chunk(F.lit("IEND"), F.lit(b"")))
    whole = F.concat(head, texts, data)
    return docs.withColumn("lines", lines).select(F.col("doc_id").alias("path"), F.when(way == 2, F.substring(whole, F.lit(1), F.octet_length(whole) - 14)).otherwise(whole).alias("content"))


def _text_chunk(line: Column, i: Column) -> Column:
    return png_chunk(F.lit("tEXt"), F.concat(F.lit(b"k"), i.cast("string").cast("binary"), F.lit(b"\0"), line.cast("binary")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.walked(made(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def crc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.parts(_files(spark, sf_dir)).select(F.col("path").alias("doc_id"), "pos", "kind", "start", "data_end", "end", "bad", "crc_ok", "resynced", "stored_crc")


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return f.select(F.col("path").alias("doc_id"), F.md5("content").alias("digest"), F.size("walk.parts").alias("parts"), F.col("walk.stop").alias("stop"), F.array_join(png_warnings(F.col("content"), F.col("walk")), " ").alias("said"))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text chunks with an address or a token go; those that name a licence get another text."""
    f = _files(spark, sf_dir)
    own = chunks.parts(f, ("tEXt",), data=True).withColumn("text", F.col("data").cast("string"))
    red = own.filter(F.col("text").rlike(RED)).select("path", "pos")
    new = own.filter(F.col("text").rlike(NAMED)).select("path", "pos", F.concat(F.lit(b"Copyright\0"), F.col("pos").cast("string").cast("binary")).alias("data"))
    return chunks.rewritten(f, red, new, F.lit(True))


def chunk_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).select(F.col("path").alias("doc_id"), F.octet_length("new").alias("size"), F.md5("new").alias("digest"))


def chunk_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.read_back(_changed(spark, sf_dir)).withColumnRenamed("path", "doc_id")


def crc_hex_sql(hexed: str) -> str:
    """DuckDB SQL for the crc32, in hex, of bytes written in hex."""
    byte = f"('0x' || substr({hexed}, (2 * i - 1)::INTEGER, 2))::BIGINT"
    steps = "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"printf('%08X', xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({hexed}) // 2 + 1), lambda i: {byte})), {steps}), 4294967295))"


_HEX = "hex(encode({}))"
_MADE = f"""
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, CASE WHEN doc_id % 7 = 0 THEN (doc_id // 7) % 4 ELSE -1 END AS way FROM documents),
c AS (SELECT doc_id, way, 0 AS pos, 'IHDR' AS kind, concat(printf('%016X', doc_id), '0802000000') AS data, NULL AS line FROM d
  UNION ALL SELECT doc_id, way, i, 'tEXt', concat('6B', {_HEX.format('(i - 1)::VARCHAR')}, '00', {_HEX.format('line')}), line FROM (SELECT doc_id, way, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)
  UNION ALL SELECT doc_id, way, 1 + len(string_split(text, chr(10))), 'IDAT', {_HEX.format('md5(text)')}, NULL FROM d
  UNION ALL SELECT doc_id, way, 2 + len(string_split(text, chr(10))), 'IDAT', {_HEX.format('source')}, NULL FROM d
  UNION ALL SELECT doc_id, way, 3 + len(string_split(text, chr(10))), 'IEND', '', NULL FROM d),
k AS (SELECT doc_id, way, pos, kind, data, line, {_HEX.format('kind')} AS kind_hex, length(data) // 2 AS n, CASE WHEN pos = 1 THEN way ELSE -1 END AS hurt FROM c),
w AS (SELECT *, CASE WHEN hurt = 0 THEN '00000000' ELSE {crc_hex_sql('concat(kind_hex, data)')} END AS crc, coalesce(sum(12 + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 8 AS s, max(pos) OVER (PARTITION BY doc_id) AS last FROM k),
f AS (SELECT doc_id, way, pos, CASE WHEN hurt = 3 THEN 't3Xt' ELSE kind END AS kind, kind_hex, data, line, n, hurt, crc, s, last, concat(printf('%08X', n + CASE WHEN hurt = 1 THEN 7 ELSE 0 END), CASE WHEN hurt = 3 THEN {_HEX.format("'t3Xt'")} ELSE kind_hex END, data, crc) AS whole, way <> 2 OR pos < last - 1 AS there FROM w)"""
_SAYS = "kind = 'tEXt' AND coalesce(regexp_matches(line, '{}'), FALSE)"
_NEW = f"""
{_MADE},
x AS (SELECT *, {_SAYS.format(RED)} AS red, {_SAYS.format(NAMED)} AS named, concat({_HEX.format("'Copyright'")}, '00', {_HEX.format('pos::VARCHAR')}) AS other FROM f WHERE there),
y AS (SELECT *, CASE WHEN red THEN '' WHEN named THEN concat(printf('%08X', length(other) // 2), kind_hex, other, {crc_hex_sql('concat(kind_hex, other)')}) ELSE whole END AS piece FROM x),
z AS (SELECT doc_id, any_value(way) AS way, count(*)::INTEGER AS parts, count(*) FILTER (piece <> '')::INTEGER AS left_parts, concat('{PNG}', string_agg(piece, '' ORDER BY pos), CASE WHEN any_value(way) = 2 THEN '0000000049454E44AE426082' ELSE '' END) AS content FROM y GROUP BY doc_id)"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "crc_chunks": (crc_chunks, f"WITH {_MADE} SELECT doc_id, pos::INTEGER AS pos, kind, s::INTEGER AS start, (s + 8 + n)::INTEGER AS data_end, (s + 12 + n)::INTEGER AS end, hurt = 3 AS bad, hurt NOT IN (0, 1, 3) AS crc_ok, hurt IN (0, 1) AS resynced, crc AS stored_crc FROM f WHERE there"),
    "chunk_files": (
        chunk_files,
        f"WITH {_MADE}, g AS (SELECT doc_id, any_value(way) AS way, concat('{PNG}', string_agg(whole, '' ORDER BY pos)) AS content, count(*) FILTER (there)::INTEGER AS parts, max(s + 12 + n) FILTER (there)::INTEGER AS stop FROM f GROUP BY doc_id) SELECT doc_id, md5(unhex(CASE WHEN way = 2 THEN substr(content, 1, length(content) - 28) ELSE content END)) AS digest, parts, stop, CASE way WHEN 2 THEN 'The PNG file is damaged or cut short at the end.' WHEN 3 THEN 'The PNG file has a part with a damaged name.' WHEN 0 THEN 'The tEXt chunk has a wrong checksum.' WHEN 1 THEN 'The tEXt chunk has a wrong checksum.' ELSE '' END AS said FROM g",
    ),
    "chunk_rewrite": (chunk_rewrite, f"WITH {_NEW} SELECT doc_id, (length(content) // 2)::INTEGER AS size, md5(unhex(content)) AS digest FROM z"),
    "chunk_read_back": (chunk_read_back, f"WITH {_NEW} SELECT doc_id, parts, left_parts + CASE WHEN way = 2 THEN 1 ELSE 0 END AS parts_after, TRUE AS unchanged_kept, TRUE AS pixels_same FROM z"),
}
