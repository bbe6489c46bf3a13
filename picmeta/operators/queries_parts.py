"""Parts and references on the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from picmeta.operators import graph, ordered, parts

BEGINNINGS = ["JFIF\0 and so on to the end", "Exif\0", "ICC_PROFILE\0", "JP..c2pa", "JP..", "Adobe and more than that", "Adobe", "plain"]
MARKERS = [0xE0, 0xE1, 0xE2, 0xEB, 0xEE, 0xFE, 0xDB]
KINDS = [*parts.SIZES, "hIST", "tEXt"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", _pick(MARKERS, F.col("event_id")).alias("marker"), F.encode(_pick(BEGINNINGS, F.col("event_id") + F.floor(F.col("event_id") / 7)), "UTF-8").alias("data"))
    return e.select("event_id", parts.segment_kind(F.col("marker"), F.col("data")).alias("kind"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", parts.green_chunk(_pick(KINDS, F.col("p_partkey")), F.unhex(F.repeat(F.lpad(F.hex(F.col("p_partkey") % 3), 2, "0"), (F.col("p_size") % 35).cast("int")))).alias("ok"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns are segments of one text; in every third one the second is missing."""
    from pyspark.sql import Window

    n = F.octet_length("text").cast("long")
    w = Window.partitionBy("conv_id")
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.lit("g").alias("guid"), "turn", (F.coalesce(F.sum(n).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("off"), F.sum(n).over(w).alias("total"), F.encode("text", "UTF-8").alias("content"))
    made = parts.extended(c.filter("turn <> 1 OR path % 3 <> 0").drop("turn"))
    return made.select("path", F.coalesce(F.md5(F.col("content").cast("binary")), F.lit("none")).alias("digest"))


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders point to customers' tables by place."""
    o = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("path"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tag"), F.col("o_custkey").alias("at"))
    c = _t(spark, sf_dir, "customer").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("path"), F.col("c_custkey").alias("at"), F.col("c_name").alias("table"))
    return graph.children(o, o.select("path", "id", "tag", "at"), c)


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey")).alias("path"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nth"), F.col("l_partkey").alias("prop")).distinct()
    props = li.select("path", "prop").distinct().join(_t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("prop")).select("path", "prop", F.col("p_type").alias("kind"), F.col("p_name").alias("value"))
    return graph.properties(li.select("path", "id").distinct(), li, props)


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_BEGIN = "[" + ", ".join("concat('" + v.replace("\0", "', chr(0), '") + "')" for v in BEGINNINGS) + "]"
_PREFIX = " ".join(f"WHEN marker = {m} AND starts_with(data, concat('{p.replace(chr(0), chr(39) + ', chr(0), ' + chr(39))}')) AND length(data) >= {n} THEN " + ("CASE WHEN contains(data, 'c2pa') THEN 'c2pa' ELSE 'jumbf' END" if k == "jumbf" else f"'{k}'") for m, p, k, n in parts.PREFIXES)
_SIZE = " ".join(f"WHEN '{k}' THEN n IN ({', '.join(map(str, v))})" + (f" AND (n <= {parts.LAST[k][0]} OR b <= {parts.LAST[k][1]})" if k in parts.LAST else "") for k, v in parts.SIZES.items())
_HTML = "html"
for _e, _c in parts.ENTITIES:
    _HTML = f"replace({_HTML}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "segment_kinds": (kinds, f"SELECT event_id, CASE {_PREFIX} WHEN marker = 254 THEN 'com' WHEN marker BETWEEN 224 AND 239 THEN 'unknown' ELSE 'marker' END AS kind FROM (SELECT event_id, {_list(MARKERS)}[(event_id % {len(MARKERS)} + 1)::INTEGER] AS marker, {_BEGIN}[((event_id + event_id // 7) % {len(BEGINNINGS)} + 1)::INTEGER] AS data FROM events)"),
    "green_chunks": (chunks, f"SELECT p_partkey, CASE kind {_SIZE} WHEN 'hIST' THEN n % 2 = 0 AND n <= 512 ELSE FALSE END AS ok FROM (SELECT p_partkey, {_list(KINDS)}[(p_partkey % {len(KINDS)} + 1)::INTEGER] AS kind, p_size % 35 AS n, p_partkey % 3 AS b FROM part)"),
    "html_entities": (lambda s, d: _t(s, d, "pages").select("page_id", F.md5(parts.decoded(F.col("html")).cast("binary")).alias("digest"), F.regexp_count("html", F.lit("&")).alias("n")), f"SELECT page_id, md5({_HTML}) AS digest, (length(html) - length(replace(html, '&', '')))::INTEGER AS n FROM pages"),
    "extended_texts": (turns, "SELECT conv_id AS path, CASE WHEN conv_id % 3 = 0 AND count(*) > 1 THEN 'none' ELSE md5(string_agg(text, '' ORDER BY turn)) END AS digest FROM conversations GROUP BY conv_id"),
    "pointer_children": (pointers, "SELECT o_orderkey % 7 AS path, o_orderkey AS id, o_orderpriority AS tag, c_name AS child FROM orders JOIN customer ON c_custkey = o_custkey"),
    "item_properties": (properties, "SELECT path, id, nth, p_type AS kind, p_name AS value FROM (SELECT DISTINCT l_suppkey AS path, l_orderkey AS id, l_linenumber AS nth, l_partkey AS prop FROM lineitem) JOIN part ON p_partkey = prop"),
    "credentials_text": (
        lambda s, d: _t(s, d, "documents").select("doc_id", parts.credentials(F.concat(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 3 == 0, F.lit(b" c2pa.thumbnail exif:GPSLatitude")).when(F.col("doc_id") % 3 == 1, F.lit(b" BodySerial \"author\" Title")).otherwise(F.lit(b" HostComputer"))), parts.PROBES).alias("found")),
        r"SELECT doc_id, concat_ws(', ', CASE WHEN doc_id % 3 = 0 OR regexp_matches(text, 'GPS(Latitude|Longitude|Altitude|Position|Coordinates)|exif:GPS|LocationCreated|LocationShown') THEN 'location' END, CASE WHEN doc_id % 3 = 1 OR regexp_matches(text, 'SerialNumber|BodySerial|LensSerial|CameraSerial') THEN 'serial number' END, CASE WHEN doc_id % 3 = 1 OR regexp_matches(text, 'stds\.schema-org\.CreativeWork|cawg\.identity|\bPerson\b|\bauthor\b|CameraOwnerName|OwnerName') THEN 'names' END, CASE WHEN doc_id % 3 = 2 OR contains(text, 'HostComputer') THEN 'computer name' END, CASE WHEN doc_id % 3 = 1 OR regexp_matches(text, '(?i)dc:title|dc:description|dc:subject|\btitle\b|\bdescription\b|\bcaption\b|\bheadline\b|\bkeywords\b|\bcomment\b|\balt_?text\b') THEN 'titles or descriptions' END, CASE WHEN doc_id % 3 = 0 OR contains(text, 'c2pa.thumbnail') THEN 'a preview of the original picture' END) AS found FROM documents",
    ),
    "dataset_order": (
        lambda s, d: ordered.ordered_by(_t(s, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("record"), (F.col("l_partkey") % 9).alias("number")).distinct(), "record", "number", "pos"),
        "SELECT path, record, number, pos, row_number() OVER (PARTITION BY path ORDER BY record, number, pos)::INTEGER AS nth FROM (SELECT DISTINCT l_suppkey AS path, l_orderkey AS pos, l_linenumber AS record, l_partkey % 9 AS number FROM lineitem)",
    ),
}
