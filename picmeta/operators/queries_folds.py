"""Matching, the search for a size, checksums and batches with errors on the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from picmeta.functions import checksums
from picmeta.functions.walks import png_rewritten, png_walk
from picmeta.operators import batch, queries_chunks
from picmeta.plans import matching

KINDS = ["gainmap", "mpf", "preview", "jpeg", "video", "samsung", "unknown"]
MEANINGS = ["GainMap", "MotionPhoto", "Original", "Depth"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, n: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def directory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a file, its lines by number are its directory, by supplier the regions behind the picture."""
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    entry = F.struct("l_linenumber", _pick(MEANINGS, F.col("p")).alias("meaning"))
    region = F.struct(F.col("s").alias("at"), "l_linenumber", _pick(KINDS, F.col("p") + F.col("s")).alias("kind"), (F.col("s") % 2 == 0).alias("has_video"))
    files = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("e"), F.sort_array(F.collect_list(region)).alias("r"))
    found = matching.matched(F.transform("e", lambda x: x["meaning"]), F.transform("r", lambda x: F.struct(x["kind"].alias("kind"), x["has_video"].alias("has_video"))))
    return files.select(F.col("l_orderkey").alias("path"), F.posexplode(found).alias("nth", "region"))


def fit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures as large as parts are dear; sizes grow with the pixels and the quality, and not quite evenly."""
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 4).alias("w"), (F.col("p_retailprice") * 3).alias("h"), (F.col("p_size") * 20000.0).alias("most"))

    def size_at(s, q):
        return F.floor(600 + F.col("w") * F.col("h") * s * s * (0.5 if q is None else q * q) * (1 + 0.1 * s)).cast("double")

    jpeg, png = (matching.fitted(size_at, F.col("w"), F.col("most"), png=x) for x in (False, True))
    both = p.withColumn("fit", F.when(F.col("p_partkey") % 3 == 0, png).otherwise(jpeg))
    return both.select("p_partkey", F.round("fit.scale", 9).alias("scale"), "fit.quality", F.col("fit.size").cast("long").alias("size"), "fit.fitted")


def adler_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return _t(spark, sf_dir, "documents").select("doc_id", checksums.adler32(b).alias("adler"), F.md5(checksums.zlib_stored(b)).alias("stored"))


def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of chunks: walked, without their text chunks, walked again; damaged ones fail at their step and the others go on."""
    c, w, n = F.col("content"), F.col("walk"), F.col("clean")
    texts = F.map_from_entries(F.transform(F.filter(F.transform(w["parts"], lambda p, i: F.struct(i.alias("i"), p["kind"].alias("kind"))), lambda x: x["kind"] == "tEXt"), lambda x: F.struct(x["i"], F.lit(None).cast("binary"))))
    steps = [
        # the list of changes is a value of its own, so that it isn't made anew for each part
        ("walk", lambda: png_walk(c), lambda: F.when(~F.exists(w["parts"], lambda p: p["kind"] == "IEND"), "cut short").when(F.exists(w["parts"], lambda p: p["bad"]), "a damaged name")),
        ("texts", lambda: texts, lambda: F.lit(None).cast("string")),
        ("clean", lambda: png_rewritten(c, w, F.col("texts"), F.lit(True)), lambda: F.when(F.exists(w["parts"], lambda p: ~p["crc_ok"]), "a wrong checksum")),
        ("size", lambda: F.octet_length(n), lambda: F.when(F.size(png_walk(n)["parts"]) != 4, "something is left")),
    ]
    tried = batch.attempted(queries_chunks.made(_t(spark, sf_dir, "documents")), steps)
    good = batch.settled(tried).select("path", F.lit(None).cast("string").alias("step"), F.lit(None).cast("string").alias("said"), "size")
    return good.unionByName(batch.failed(tried).withColumn("size", F.lit(None).cast("int")))


_MATCH = f"""
li AS (SELECT l_orderkey AS path, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
f AS (SELECT path, list(['{"', '".join(MEANINGS)}'][(p % {len(MEANINGS)} + 1)::INTEGER] ORDER BY n) AS e, list({{'kind': ['{"', '".join(KINDS)}'][((p + s) % {len(KINDS)} + 1)::INTEGER], 'vid': s % 2 = 0}} ORDER BY s, n) AS r FROM li GROUP BY path),
w AS (SELECT path, e, list_transform(r, lambda x, i: {{'i': i - 1, 'kind': x.kind, 'vid': x.vid}}) AS free, 0 AS nth, -1::BIGINT AS region FROM f
  UNION ALL SELECT path, e, list_filter(free, lambda x: pick IS NULL OR x.i <> pick), nth + 1, pick FROM (SELECT *, CASE e[nth + 2] WHEN 'GainMap' THEN coalesce(list_filter(free, lambda x: x.kind = 'gainmap')[1].i, list_filter(free, lambda x: x.kind NOT IN ('video', 'samsung', 'unknown'))[1].i)
    WHEN 'MotionPhoto' THEN coalesce(list_filter(free, lambda x: x.kind = 'video')[1].i, list_filter(free, lambda x: x.kind = 'samsung' AND x.vid)[1].i) ELSE list_filter(free, lambda x: x.kind NOT IN ('samsung', 'unknown'))[1].i END AS pick FROM w WHERE nth + 1 < len(e)))"""


def _search(name: str, start: str, cols: str, size: str, tries: int) -> str:
    """A table of tries: start has (k, lo, hi, target, cols) and each try's row follows from the one before."""
    return f"""
{name} AS (SELECT k, lo, hi, target, {cols}, 0 AS i, hi AS s, FALSE AS done, NULL::DOUBLE AS fs, NULL::DOUBLE AS fn, NULL::DOUBLE AS miss, NULL::DOUBLE AS ss, NULL::DOUBLE AS sn FROM {start}
  UNION ALL SELECT k, lo, hi, target, {cols}, i + 1, CASE WHEN stop OR over THEN s ELSE nxt END, stop OR over, fs, fn, miss, ss, sn FROM (SELECT *, coalesce(nxt <= fs, FALSE) OR abs(nxt - s) < 1e-4 AS over FROM (SELECT *, CASE WHEN miss IS NOT NULL AND held >= miss THEN greatest(lo, miss * 0.85::DOUBLE) ELSE held END AS nxt FROM (SELECT *, least(hi, greatest(lo, CASE WHEN fs IS NOT NULL AND miss IS NOT NULL AND NOT (guess > fs AND guess < miss) THEN (fs + miss) / 2 ELSE guess END)) AS held FROM (
    SELECT k, lo, hi, target, {cols}, i, s, CASE WHEN n <= target THEN s >= hi OR n >= target * 0.97::DOUBLE ELSE s <= lo END AS stop, CASE WHEN n <= target AND (fs IS NULL OR s > fs) THEN s ELSE fs END AS fs, CASE WHEN n <= target AND (fs IS NULL OR s > fs) THEN n ELSE fn END AS fn, CASE WHEN n > target AND (miss IS NULL OR s < miss) THEN s ELSE miss END AS miss, CASE WHEN sn IS NULL OR n < sn THEN s ELSE ss END AS ss, CASE WHEN sn IS NULL OR n < sn THEN n ELSE sn END AS sn,
      s * sqrt(target / n) * CASE WHEN n > target THEN 0.97::DOUBLE ELSE 1 END AS guess FROM (SELECT *, {size} AS n FROM {name} WHERE NOT done AND i < {tries})))))),
{name}_end AS (SELECT k, arg_max(fs, i) AS fs, arg_max(fn, i) AS fn, arg_max(ss, i) AS ss, arg_max(sn, i) AS sn FROM {name} GROUP BY k)"""


def _size(s: str, q2: str) -> str:
    return f"floor(600 + w * h * {s} * {s} * {q2} * (1 + 0.1::DOUBLE * {s}))::DOUBLE"


_FIT = f"""
p AS (SELECT p_partkey AS k, p_retailprice * 4 AS w, p_retailprice * 3 AS h, floor(p_size * 20000.0::DOUBLE * 0.95::DOUBLE)::DOUBLE AS target FROM part),
z AS (SELECT *, least(1.0::DOUBLE, 64.0::DOUBLE / w) AS tiny, least(1.0::DOUBLE, 1280.0::DOUBLE / w) AS flr FROM p),
a0 AS (SELECT k, flr AS lo, 1.0::DOUBLE AS hi, target, w, h FROM z WHERE k % 3 <> 0), b0 AS (SELECT k, tiny AS lo, flr AS hi, target, w, h FROM z WHERE k % 3 <> 0), c0 AS (SELECT k, tiny AS lo, 1.0::DOUBLE AS hi, target, w, h FROM z WHERE k % 3 = 0),
{_search("a", "a0", "w, h", _size("s", "(0.85::DOUBLE * 0.85::DOUBLE)"), 7)}, {_search("b", "b0", "w, h", _size("s", "(0.7::DOUBLE * 0.7::DOUBLE)"), 7)}, {_search("c", "c0", "w, h", _size("s", "0.5::DOUBLE"), 9)},
q AS (SELECT k, flr, target, [{', '.join(f"{{'q': {x}::DOUBLE, 'n': {_size('flr', f'({x}::DOUBLE * {x}::DOUBLE)')}}}" for x in matching.QUALITY_STEPS)}] AS steps FROM z),
o AS (SELECT k, CASE WHEN a.fs IS NOT NULL THEN {{'s': a.fs, 'q': 0.85::DOUBLE, 'n': a.fn, 'ok': TRUE}} WHEN len(list_filter(steps, lambda x: x.n <= target)) > 0 THEN {{'s': flr, 'q': list_filter(steps, lambda x: x.n <= target)[1].q, 'n': list_filter(steps, lambda x: x.n <= target)[1].n, 'ok': TRUE}} WHEN b.fs IS NOT NULL THEN {{'s': b.fs, 'q': 0.7::DOUBLE, 'n': b.fn, 'ok': TRUE}}
  ELSE list_sort(list_transform(list_concat([{{'n': a.sn, 'i': 0, 's': a.ss, 'q': 0.85::DOUBLE}}], list_transform(steps, lambda x, i: {{'n': x.n, 'i': i, 's': flr, 'q': x.q}}), [{{'n': b.sn, 'i': 9, 's': b.ss, 'q': 0.7::DOUBLE}}]), lambda x: {{'n': x.n, 'i': x.i, 'v': {{'s': x.s, 'q': x.q, 'n': x.n, 'ok': FALSE}}}}))[1].v END AS v FROM q JOIN a_end a USING (k) JOIN b_end b USING (k)
  UNION ALL SELECT k, CASE WHEN fs IS NOT NULL THEN {{'s': fs, 'q': NULL::DOUBLE, 'n': fn, 'ok': TRUE}} ELSE {{'s': ss, 'q': NULL::DOUBLE, 'n': sn, 'ok': FALSE}} END FROM c_end)"""

_DOCS = "d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), v AS (SELECT doc_id, x, length(x) // 2 AS n, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, (2 * i - 1)::INTEGER, 2))::BIGINT) AS b FROM d), s AS (SELECT doc_id, x, n, (1 + coalesce(list_sum(b), 0)) % 65521 AS a, (n + coalesce(list_sum(list_transform(b, lambda y, i: (n - i + 1) * y)), 0)) % 65521 AS c FROM v)"
_STORED = "concat('7801', array_to_string(list_transform(range(0, greatest((n + 65534) // 65535, 1)), lambda k: concat(CASE WHEN k = greatest((n + 65534) // 65535, 1) - 1 THEN '01' ELSE '00' END, substr(printf('%04X', least(65535, n - k * 65535)), 3, 2), substr(printf('%04X', least(65535, n - k * 65535)), 1, 2), substr(printf('%04X', 65535 - least(65535, n - k * 65535)), 3, 2), substr(printf('%04X', 65535 - least(65535, n - k * 65535)), 1, 2), substr(x, (k * 131070 + 1)::INTEGER, 131070))), ''), printf('%08X', (c * 65536 + a)::BIGINT))"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "directory_match": (directory_match, f"WITH RECURSIVE {_MATCH} SELECT path, nth::INTEGER AS nth, region::INTEGER AS region FROM w"),
    "fit_scale": (fit_scale, f"WITH RECURSIVE {_FIT} SELECT k AS p_partkey, round(v.s, 9) AS scale, v.q AS quality, v.n::BIGINT AS size, v.ok AS fitted FROM o"),
    "adler_sums": (adler_sums, f"WITH {_DOCS} SELECT doc_id, (c * 65536 + a)::BIGINT AS adler, md5(unhex({_STORED})) AS stored FROM s"),
    "batch_errors": (batch_errors, f"WITH {queries_chunks._MADE}, g AS (SELECT doc_id, any_value(way) AS way, sum(12 + n) FILTER (kind <> 'tEXt') AS kept FROM f GROUP BY doc_id) SELECT doc_id AS path, CASE way WHEN 2 THEN 'walk' WHEN 3 THEN 'walk' WHEN 0 THEN 'clean' WHEN 1 THEN 'clean' END AS step, CASE way WHEN 2 THEN 'cut short' WHEN 3 THEN 'a damaged name' WHEN 0 THEN 'a wrong checksum' WHEN 1 THEN 'a wrong checksum' END AS said, CASE WHEN way < 0 THEN (8 + kept)::INTEGER END AS size FROM g"),
}
