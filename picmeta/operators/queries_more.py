"""Ranges, order, audits, values, plans and expiry on the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from picmeta.functions import binary, forms, text
from picmeta.operators import audit, graph, intervals, ordered
from picmeta.plans import policy
from picmeta.sources.files import incoming
from picmeta.streaming import state


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranges(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, id, s, e, event_type): an event lasts value * 400 seconds."""
    s = F.unix_timestamp("ts")
    e = _t(spark, sf_dir, "events")
    e = e.filter(F.col("event_type").isin(*types)) if types else e
    return e.select("user_id", F.col("event_id").alias("id"), s.alias("s"), (s + F.floor(F.col("value") * 400)).alias("e"), "event_type")


_EV = "ev AS (SELECT user_id, event_id AS id, epoch(date_trunc('second', ts))::BIGINT AS s, epoch(date_trunc('second', ts))::BIGINT + floor(value * 400)::BIGINT AS e, event_type FROM events)"


def _merged(name: str, source: str) -> str:
    return f"{name}_r AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({source}) WHERE s < e), {name}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_r), {name} AS (SELECT user_id, min(s) AS s, max(e) AS e FROM {name}_i GROUP BY user_id, island)"


def _less(a: str, b: str) -> str:
    """a minus b, for merged a and b: each piece runs from an end of b, or a's start, to the next start of b, or a's end."""
    return f"""cuts AS (SELECT a.user_id, a.s AS a_s, a.e AS a_e, greatest(m.s, a.s) AS s, least(m.e, a.e) AS e FROM {a} a JOIN {b} m ON a.user_id = m.user_id AND m.s < a.e AND a.s < m.e),
ends AS (SELECT user_id, a_s, a_e, a_s AS p FROM (SELECT user_id, s AS a_s, e AS a_e FROM {a}) UNION ALL SELECT user_id, a_s, a_e, e FROM cuts),
pieces AS (SELECT user_id, p AS s, coalesce((SELECT min(c.s) FROM cuts c WHERE c.user_id = ends.user_id AND c.a_s = ends.a_s AND c.s >= ends.p), a_e) AS e FROM ends)
SELECT user_id, s, e FROM pieces WHERE s < e"""


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlaps(ranges(spark, sf_dir, ("error",)), ranges(spark, sf_dir, ("purchase", "click", "view", "signup")), "user_id", 1 << 13)


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's place in its order's file when lines with an even number are left out."""
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))
    source = intervals.offsets(li, "l_orderkey", "l_linenumber", "size")
    kept = li.filter("l_linenumber % 2 = 1")
    out = intervals.offsets(kept, "l_orderkey", "l_linenumber", "size").select("l_orderkey", "l_linenumber", F.col("s").alias("out"))
    parts = source.join(out, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "s", "e", "out")
    return intervals.moved(source.select("l_orderkey", F.col("l_linenumber").alias("id"), F.col("s").alias("at")), parts, "l_orderkey", 1 << 6).fillna(-1, "to")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup and view define the user's table of their number, others use it."""
    e = _t(spark, sf_dir, "events")
    return ordered.unused(e.select(F.col("user_id").alias("path"), (F.col("event_id") % 3).alias("key"), F.col("event_id").alias("pos"), F.col("event_type").isin("signup", "view").alias("defines"), F.floor("value").alias("size")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assistant's turn takes the kind of what stands before it; a turn that divides by four breaks that."""
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("pos"), F.col("role").alias("kind"))
    return ordered.inherited(c, F.col("kind") == "assistant", F.col("pos") % 4 == 0)


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("size"), F.min("l_returnflag").alias("kind"))
    own = intervals.offsets(li, "l_orderkey", "l_linenumber", "size").join(li.select("l_orderkey", "l_linenumber", "kind"), ["l_orderkey", "l_linenumber"])
    return ordered.padded(own.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("pos"), "kind", "s", "e"), F.col("kind") == "N")


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier's order numbers (mod 97) lead to through its lines."""
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") % 97).alias("src"), (F.col("l_partkey") % 97).alias("dst")).distinct()
    start = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), (F.col("s_suppkey") % 97).alias("id"))
    return graph.reached(start, li)


def needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))


def planted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): documents; those of a registry item's number end with that item, in one of six ways of writing."""
    d, n = _t(spark, sf_dir, "documents").select("doc_id", "text"), needles(spark, sf_dir)
    both = d.join(F.broadcast(n), d["doc_id"] == n["needle_id"], "left")
    item, way = F.col("needle"), F.col("doc_id") % 6
    utf8 = F.encode(item, "UTF-8")
    end = F.when(way == 0, utf8).when(way == 1, F.encode(item, "UTF-16LE")).when(way == 2, F.encode(item, "UTF-16BE")).when(way == 3, F.hex(utf8).cast("binary")).when(way == 4, F.regexp_replace(F.base64(utf8), r"\s", "").cast("binary")).otherwise(F.hex(F.regexp_replace(F.base64(utf8), r"\s", "").cast("binary")).cast("binary"))
    return both.select(F.col("doc_id").alias("path"), F.concat(F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), "UTF-8"), F.coalesce(end, F.lit("").cast("binary"))).alias("content"))


def haystacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry items in files, as they are and inside runs of hex or base64, and runs inside runs."""
    inner = audit.opened(planted_files(spark, sf_dir))
    hits = inner.select(F.struct("path", "kind").alias("path"), "content")
    return audit.found(hits, needles(spark, sf_dir)).select("path.path", "path.kind", "needle_id", "encoding")


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a registry of items and whole documents, those that stand inside others."""
    b = _t(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("needle_id"), F.col("text").alias("needle"))
    d = _t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("needle_id"), F.col("text").alias("needle"))
    return audit.contained(b.unionByName(d))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders as a customer's file shows them: some looked for as written, some in another form that the registry knows, some in one that it doesn't. Counts by verdict and status."""
    o = _t(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    own = o.select(F.col("o_orderkey").alias("needle_id"), F.col("o_custkey").alias("path"), F.col("o_orderstatus").alias("grp"), F.col("o_orderpriority").alias("name"), day.alias("value"))
    needle = F.when(F.col("needle_id") % 5 == 0, F.substring("value", 1, 7)).otherwise(F.replace("value", F.lit("-"), F.lit(":")))
    registry = own.withColumn("needle", needle).withColumn("value", F.when(F.col("needle_id") % 2 == 0, F.col("value")))
    verdicts = audit.visibility(registry, own.drop("needle_id"))
    return verdicts.join(own.select("needle_id", "grp"), "needle_id").groupBy("grp", "verdict").agg(F.count("*").alias("n"))


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which single line of a document, taken away, takes a registry item away: for each item, its documents' lines (by number)."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = d.select(F.struct("path", "pos").alias("path"), F.encode("line", "UTF-8").alias("content"))
    hits = audit.found(lines, needles(spark, sf_dir), ("UTF-8",)).select("path.path", "needle_id", "path.pos")
    once = hits.groupBy("path", "needle_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    tried = hits.select("path", F.col("pos").cast("string").alias("key")).distinct()
    kept = tried.join(hits.select("path", "needle_id", F.col("pos").cast("string").alias("at")), "path").filter("key <> at").select("path", "key", "needle_id").distinct()
    after = kept.unionByName(tried.withColumn("needle_id", F.lit(None).cast("long")))
    return audit.responsible(once.select("path", "needle_id"), after)


def case_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "hang").when(F.col("event_type") == "purchase", "crash").otherwise("ok")
    return audit.run_stats(e.select(status.alias("status"), (F.col("value") * 100).alias("ms"), (F.col("event_id") % 9 == 0).alias("kept")))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    files = p.select(
        F.col("p_partkey").alias("path"), F.element_at(F.array(*map(F.lit, ("jpeg", "png", "webp", "heic"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("format"), (F.col("p_size") * 100).cast("long").alias("w"), F.floor("p_retailprice").alias("h"),
        (F.col("p_partkey") % 9).cast("int").alias("orientation"), (F.col("p_partkey") % 5 != 0).alias("decodable"), F.array(F.lit("exif:gps"), F.when(F.col("p_partkey") % 2 == 0, "exif:orientation").otherwise("exif:camera")).alias("remove"), F.array(F.lit("exif:orientation")).alias("rotation"),
        F.when(F.col("p_partkey") % 3 == 0, F.struct(F.lit(10.4).alias("x"), F.lit(-3.0).alias("y"), F.lit(500.5).alias("w"), F.lit(1e6).alias("h"))).alias("rect"),
    )
    made = policy.planned(files, "edge", 800.0)
    return made.select("path", F.array_join("remove", ",").alias("remove"), "bake", F.col("crop").isNotNull().alias("cropped"), "out_w", "out_h", "enc", "resave", F.size("warnings").alias("n_warnings"))


_RECT = "(CASE WHEN path % 3 = 0 THEN greatest(0, least(w - 1, 10)) ELSE 0 END)"
_PLAN = f"""WITH f AS (SELECT p_partkey AS path, ['jpeg', 'png', 'webp', 'heic'][(p_partkey % 4 + 1)::INTEGER] AS format, p_size::BIGINT * 100 AS w, floor(p_retailprice)::BIGINT AS h, p_partkey % 9 AS o, p_partkey % 5 <> 0 AS can, p_partkey % 2 = 0 AS rot FROM part),
c AS (SELECT *, CASE WHEN path % 3 = 0 THEN greatest(1, least(w - {_RECT}, 501)) ELSE w END AS rw, h AS rh, path % 3 = 0 AND NOT ({_RECT} = 0 AND greatest(1, least(w - {_RECT}, 501)) = w) AS crop FROM f),
s AS (SELECT *, least(1.0::DOUBLE, 800.0::DOUBLE / greatest(rw, rh)) AS k FROM c),
t AS (SELECT *, greatest(1, floor(rw * k + 0.5))::BIGINT AS tw, greatest(1, floor(rh * k + 0.5))::BIGINT AS th FROM s)
SELECT path, CASE WHEN NOT can AND o <> 1 AND rot THEN 'exif:gps' WHEN rot THEN 'exif:gps,exif:orientation' ELSE 'exif:gps,exif:camera' END AS remove, can AND o <> 1 AND rot AS bake, can AND crop AS cropped, CASE WHEN can THEN tw ELSE rw END AS out_w, CASE WHEN can THEN th ELSE rh END AS out_h,
 CASE WHEN can AND format = 'heic' THEN 'jpeg' ELSE format END AS enc, can AND ((o <> 1 AND rot) OR crop OR tw < rw OR th < rh) AS resave, ((NOT can AND o <> 1 AND rot)::INTEGER + (NOT can AND (crop OR tw < rw OR th < rh))::INTEGER) AS n_warnings FROM t"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    n = F.col("n_chars") * F.col("doc_id")
    return d.select("doc_id", text.clip(F.col("text")).alias("clipped"), text.byte_size(n).alias("size"), text.counted(F.col("doc_id") % 3, "file", "files").alias("files"), text.whole(n).alias("whole"), F.md5(F.col("text").cast("binary")).alias("md5"), text.longest_run(F.col("text")).alias("run"), text.leftover(F.encode("text", "UTF-8"))["nonzero"].alias("nonzero"))


_CLIP = r"trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g'), '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'))"
_BIG = "n_chars * doc_id"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as people type them, made of the balance of customers."""
    c = _t(spark, sf_dir, "customer")
    n = F.floor(F.abs("c_acctbal")).cast("long")
    way = (F.col("c_custkey") % 6).cast("int")
    made = F.when(way == 0, F.format_number(n, 0)).when(way == 1, F.concat(n.cast("string"), F.lit(",5"))).when(way == 2, F.concat(n.cast("string"), F.lit(" %"))).when(way == 3, F.concat(F.lit("−"), n.cast("string"), F.lit(" px"))).when(way == 4, F.concat(n.cast("string"), F.lit(".."))).otherwise(F.concat(F.lit("."), n.cast("string")))
    seconds = F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal") / 1000).otherwise(F.col("c_acctbal") / 100000)
    return c.select("c_custkey", text.number(made).alias("number"), text.exposure(seconds).alias("exposure"), text.orientation(F.col("c_nationkey")).alias("rotation"), text.known_orientation(F.col("c_nationkey")).alias("turn"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    dms = F.concat(F.col("s_nationkey").cast("string"), F.lit("/1, "), (F.col("s_suppkey") % 60).cast("string"), F.lit("/1, "), F.floor(F.abs("s_acctbal")).cast("string"), F.lit("/100"))
    return s.select("s_suppkey", text.coordinate(dms, F.when(F.col("s_suppkey") % 2 == 0, "North").otherwise("S")).alias("position"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    raw = F.concat(F.lit(" ."), F.col("p_name"), F.lit(": "), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, ".public.JPG").otherwise("?? "))
    return p.select("p_partkey", text.output_name(text.clean_name(raw), F.col("p_partkey") % 3, F.lit("clean"), F.lit("png")).alias("name"), text.slug(F.col("p_name")).alias("slug"), forms.device_name(F.col("p_name")).alias("device_ok"), forms.device_name(F.concat("p_name", F.lit("  x"))).alias("two_spaces"), F.coalesce(forms.named_key(F.col("p_type")), F.lit("none")).alias("by_name"), incoming(F.when(F.col("p_partkey") % 4 == 0, "image/PNG"), F.concat("p_name", F.element_at(F.array(F.lit(".jpeg"), F.lit(".heif"), F.lit(".gif")), (F.col("p_partkey") % 3 + 1).cast("int")))).alias("mime"))


#: The rules of names for DuckDB, written on their own.
_DEVICE = r"(length({0}) BETWEEN 1 AND 64 AND regexp_matches({0}, '^[\p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}}][\p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}} ]*$') AND NOT contains({0}, '  ') AND NOT suffix({0}, ' ') AND NOT contains({0}, '@') AND NOT contains({0}, '://') AND NOT contains(lower({0}), 'www.'))"
_NAMED = "CASE WHEN regexp_matches({0}, 'gps|latitude|longitude|altitude|geotag|coordinat') THEN 'gps' WHEN regexp_matches({0}, 'location|address|place|city|country|street|postal|province|landmark') THEN 'place' WHEN contains({0}, 'serial') THEN 'serial' WHEN regexp_matches({0}, 'uuid|guid|unique|^id$') THEN 'ids' ELSE 'none' END"


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    pattern = ["yyyy-MM-dd", "yyyy:MM:dd HH:mm:ss", "yyyyMMdd", "HHmmss", "dd/MM/yyyy", "yyyy-MM-dd HH:mm"]
    v = F.element_at(F.array(*(F.date_format("o_orderdate", p) for p in pattern)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    dataset = F.element_at(F.array(*map(F.lit, ("2:55", "2:60", "2:65", "2:0", "2:120", "3:1"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", forms.png_date(v).alias("png"), v.rlike(forms.EXIF_DATE).alias("exif"), text.exif_date(v).alias("shown"), text.iptc_date(v).alias("iptc_date"), text.iptc_time(v).alias("iptc_time"), forms.dataset_key(dataset, v).alias("dataset"), forms.latin1_line(F.concat(v, F.lit("é"))).alias("line"), forms.technical_text(v).alias("technical"))


_V = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') WHEN 3 THEN strftime(o_orderdate, '%H%M%S') WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END"


def bytes_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers, encodings and chunks of bytes; a PNG text chunk is written and read again."""
    p = _t(spark, sf_dir, "pages")
    b = F.encode(F.substring("url", 1, 60), "UTF-8")
    chunk = binary.png_text(F.lit("Source"), F.substring("url", 1, 60))
    n = F.octet_length(b)
    return p.select(
        "page_id", binary.big(b, 0, 4).alias("u32"), binary.little(b, 1, 2).alias("u16"), F.hex(binary.written(F.col("page_id"), 8)).alias("w64"), binary.latin1(F.substring(b, 1, 8)).alias("latin1"), binary.utf16(F.encode(F.col("url"), "UTF-16LE")).isNotNull().alias("utf16"),
        binary.place_of(b, "example").alias("place"), F.regexp_count(binary.hex_lines(b), F.lit("\n")).alias("lines"), binary.blank(F.substring(b, 1, 1)).alias("blank"), F.md5(binary.zeroed(b, F.lit(3), F.lit(9))).alias("zeroed"),
        (binary.big(chunk, 0, 4) == n + 7).alias("length_ok"), (binary.latin1(F.substring(chunk, 5, 4)) == "tEXt").alias("kind_ok"), (F.substring(chunk, F.lit(16), n) == b).alias("value_ok"), F.octet_length(binary.jpeg_segment(0xFE, b)).alias("segment"), binary.c_string(F.concat(F.substring("url", 1, 7), F.lit("\x00x"))).alias("c_string"),
        F.hex(binary.raw_profile(F.concat(F.lit("\nexif\n  4\n"), F.lower(F.hex(b))))).alias("profile"),
    )


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "subtract_ranges": (lambda s, d: intervals.subtract(ranges(s, d, ("click", "view")), ranges(s, d, ("error", "purchase")), "user_id"), f"WITH {_EV}, {_merged('a', '''SELECT * FROM ev WHERE event_type IN ('click', 'view')''')}, {_merged('m', '''SELECT * FROM ev WHERE event_type IN ('error', 'purchase')''')}, {_less('a', 'm')}"),
    "orphan_ranges": (lambda s, d: intervals.gaps(ranges(s, d), "user_id"), f"WITH {_EV}, {_merged('m', 'SELECT * FROM ev')} SELECT user_id, e AS s, nxt AS e FROM (SELECT user_id, e, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS nxt FROM m) WHERE nxt IS NOT NULL"),
    "covered_ranges": (lambda s, d: intervals.covered(ranges(s, d), "user_id"), f"WITH {_EV}, {_merged('m', 'SELECT * FROM ev')} SELECT user_id, count(*) AS n_ranges, sum(e - s)::BIGINT AS size FROM m GROUP BY user_id"),
    "overlap_ranges": (overlapping, f"WITH {_EV} SELECT l.user_id, l.id AS l_id, r.id AS r_id FROM ev l JOIN ev r ON l.user_id = r.user_id AND l.s < r.e AND r.s < l.e WHERE l.event_type = 'error' AND r.event_type IN ('purchase', 'click', 'view', 'signup') AND l.s < l.e AND r.s < r.e"),
    "clashing_edits": (lambda s, d: ordered.clashing(ranges(s, d).select(F.col("user_id").alias("path"), "s", "e")), f"WITH {_EV} SELECT path, s, e FROM (SELECT user_id AS path, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev) WHERE s < reach"),
    "moved_offsets": (moved, "WITH p AS (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT)::BIGINT AS size FROM lineitem GROUP BY ALL), o AS (SELECT *, sum(size) OVER w - size AS s, sum(CASE WHEN l_linenumber % 2 = 1 THEN size ELSE 0 END) OVER w AS o FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)) SELECT l_orderkey, l_linenumber AS id, s::BIGINT AS at, CASE WHEN l_linenumber % 2 = 1 THEN (o - size)::BIGINT ELSE -1 END AS \"to\" FROM o"),
    "define_use": (definitions, "WITH e AS (SELECT user_id AS path, event_id % 3 AS key, event_id AS pos, event_type IN ('signup', 'view') AS defines, floor(value)::BIGINT AS size FROM events), n AS (SELECT *, sum(defines::INTEGER) OVER (PARTITION BY path, key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS nth FROM e) SELECT path, key, max(pos) FILTER (defines) AS pos, max(size) FILTER (defines) AS size FROM n WHERE nth > 0 GROUP BY path, key, nth HAVING count(*) FILTER (NOT defines) = 0"),
    "inherit_kind": (turns, "WITH c AS (SELECT conv_id AS path, turn AS pos, role, CASE WHEN role <> 'assistant' AND turn % 4 = 0 THEN '' WHEN role <> 'assistant' THEN role END AS k FROM conversations), l AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM c) SELECT path, pos, CASE WHEN role <> 'assistant' THEN role WHEN coalesce(last, '') = '' THEN 'unknown' ELSE last END AS kind FROM l"),
    "padded_regions": (padded, "WITH p AS (SELECT l_orderkey AS path, l_linenumber AS pos, sum(l_quantity::BIGINT)::BIGINT AS size, min(l_returnflag) AS kind FROM lineitem GROUP BY ALL), o AS (SELECT *, (sum(size) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM p), w AS (SELECT *, coalesce(min(CASE WHEN kind <> 'N' THEN pos END) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(CASE WHEN kind <> 'N' THEN pos END) OVER (PARTITION BY path)) AS owner FROM o) SELECT path, owner AS pos, max(CASE WHEN kind <> 'N' THEN kind END) AS kind, min(e - size) AS s, max(e) AS e FROM w WHERE owner IS NOT NULL GROUP BY path, owner"),
    "first_per_source": (lambda s, d: ordered.first_of(_t(s, d, "documents").select("source", "lang", F.col("doc_id").alias("pos"), F.col("n_chars").alias("value")), "source", "lang"), "SELECT source, lang, min(doc_id) AS pos, arg_min(n_chars, doc_id) AS value FROM documents GROUP BY source, lang"),
    "tiled_chunks": (lambda s, d: ordered.tiled(intervals.offsets(_t(s, d, "conversations").withColumn("size", F.length("text")), "conv_id", "turn", "size").filter("turn <> 3 OR conv_id % 2 = 0").select(F.col("conv_id").alias("path"), "s", "e")), "WITH o AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM conversations), k AS (SELECT * FROM o WHERE turn <> 3 OR conv_id % 2 = 0), g AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY conv_id ORDER BY e - n, e), 0) AS expected FROM k) SELECT conv_id AS path, bool_and(e - n = expected) AS whole FROM g GROUP BY conv_id"),
    "closure_reach": (reach, "WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey AS path, l_orderkey % 97 AS src, l_partkey % 97 AS dst FROM lineitem), r AS (SELECT s_suppkey AS path, s_suppkey % 97 AS id, 0 AS depth FROM supplier UNION SELECT l.path, l.dst, depth + 1 FROM r JOIN l ON l.path = r.path AND l.src = r.id WHERE depth < 64) SELECT path, id, min(depth)::INTEGER AS depth FROM r GROUP BY path, id"),
    "haystack_hex_b64": (haystacks, "SELECT item_id AS path, CASE WHEN item_id % 6 = 3 THEN 'hex' WHEN item_id % 6 = 4 THEN 'base64' WHEN item_id % 6 = 5 THEN 'hex/base64' ELSE 'raw' END AS kind, item_id AS needle_id, ['UTF-8', 'UTF-16LE', 'UTF-16BE', 'UTF-8', 'UTF-8', 'UTF-8'][(item_id % 6 + 1)::INTEGER] AS encoding FROM benchmark JOIN documents ON doc_id = item_id UNION SELECT doc_id, 'raw', item_id, 'UTF-8' FROM benchmark b JOIN documents d ON contains(d.text, b.text)"),
    "attribution": (attribution, "WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), h AS (SELECT path, item_id AS needle_id, pos FROM l JOIN benchmark b ON contains(l.line, b.text)), o AS (SELECT path, needle_id, count(*) AS n, min(pos) AS pos FROM h GROUP BY ALL) SELECT path, needle_id, pos::VARCHAR AS keys FROM o WHERE n = 1"),
    "canary_unique_check": (lambda s, d: audit.repeated(needles(s, d).select("needle").unionByName(_t(s, d, "documents").select(F.col("text").alias("needle")))), "SELECT needle, count(*) AS n FROM (SELECT text AS needle FROM benchmark UNION ALL SELECT text FROM documents) GROUP BY needle HAVING count(*) > 1"),
    "visibility_counts": (seen, "SELECT o_orderstatus AS grp, CASE WHEN o_orderkey % 5 = 0 THEN 'yes' WHEN o_orderkey % 2 = 0 THEN 'reformatted' ELSE 'no' END AS verdict, count(*) AS n FROM orders GROUP BY ALL"),
    "canary_contained": (contained, "WITH r AS (SELECT concat('b', item_id) AS id, text FROM benchmark UNION ALL SELECT concat('d', doc_id), text FROM documents) SELECT i.id AS inner, o.id AS outer FROM r i JOIN r o ON i.text <> o.text AND i.text <> '' AND contains(o.text, i.text)"),
    "finding_counts": (lambda s, d: audit.findings(_t(s, d, "events").select(F.col("event_type").alias("severity"), (F.col("event_id") % 700).alias("key"))), "SELECT event_type AS severity, count(DISTINCT event_id % 700) AS n FROM events GROUP BY event_type"),
    "case_stats": (case_stats, "SELECT count(*) AS cases, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS hangs, count(*) FILTER (event_type = 'purchase') AS crashes, count(*) FILTER (value * 100 > 3000) AS slow, count(*) FILTER (event_id % 9 = 0 AND event_type NOT IN ('error', 'signup', 'purchase')) AS silent_keeps FROM events"),
    "same_models": (
        lambda s, d: audit.same_model(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("value")), _t(s, d, "lineitem").filter("l_linenumber <> 7 OR l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("value"))),
        "SELECT l_orderkey AS path, count(*) FILTER (l_linenumber = 7 AND l_orderkey % 2 = 1) = 0 AS same FROM lineitem GROUP BY l_orderkey",
    ),
    "file_plans": (plans, _PLAN),
    "text_values": (
        values,
        rf"SELECT doc_id, CASE WHEN length(t) > 80 THEN concat(rtrim(substr(t, 1, 77)), '...') ELSE t END AS clipped, CASE WHEN b < 1000 THEN concat(b, ' bytes') WHEN b < 1000000 THEN printf('%.1f KB', floor((b + 50) / 100) / 10) ELSE printf('%.1f MB', floor((b + 50000) / 100000) / 10) END AS size, concat(doc_id % 3, CASE WHEN doc_id % 3 = 1 THEN ' file' ELSE ' files' END) AS files, format('{{:,}}', b) AS whole, md5(text) AS md5, coalesce(list_filter(runs, lambda r: length(r) = most)[1], '') AS run, strlen(text)::INTEGER - (strlen(text) - strlen(replace(text, chr(0), '')))::INTEGER AS nonzero FROM (SELECT *, list_max(list_transform(runs, lambda x: length(x))) AS most FROM (SELECT doc_id, text, {_CLIP} AS t, {_BIG} AS b, list_transform(regexp_extract_all(text, '[\x20-\x7e]+'), lambda x: trim(x)) AS runs FROM documents))",
    ),
    "typed_numbers": (
        typed,
        "WITH c AS (SELECT *, floor(abs(c_acctbal))::BIGINT AS n, CASE WHEN c_acctbal > 5000 THEN c_acctbal / 1000 ELSE c_acctbal / 100000 END AS sec FROM customer) SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN n WHEN 1 THEN n + 0.5 WHEN 2 THEN n WHEN 3 THEN -n WHEN 4 THEN NULL ELSE concat('.', n)::DOUBLE END::DOUBLE AS number, CASE WHEN sec >= 1 THEN concat(regexp_replace(printf('%.1f', sec), '\\.0$', ''), ' s') WHEN sec > 0 THEN concat('1/', floor(1 / sec + 0.5)::BIGINT, ' s') END AS exposure, coalesce(['" + "', '".join(text.ORIENTATIONS) + "'][c_nationkey], concat('Unknown (', c_nationkey, ')')) AS rotation, CASE WHEN c_nationkey BETWEEN 1 AND 8 THEN c_nationkey ELSE 1 END AS turn FROM c",
    ),
    "dms_decimal": (positions, "SELECT s_suppkey, concat(printf('%.4f', s_nationkey::DOUBLE + (s_suppkey % 60)::DOUBLE / 60 + (floor(abs(s_acctbal)) / 100) / 3600), ' ', CASE WHEN s_suppkey % 2 = 0 THEN 'N' ELSE 'S' END) AS position FROM supplier"),
    "clean_names": (
        names,
        r"SELECT p_partkey, concat(p_name, '- ', p_brand, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-' END, CASE WHEN p_partkey % 3 > 1 THEN concat('-', p_partkey % 3) ELSE '' END, '.clean.png') AS name, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug, " + _DEVICE.format('p_name') + " AS device_ok, " + _DEVICE.format("concat(p_name, '  x')") + " AS two_spaces, " + _NAMED.format('lower(p_type)') + r" AS by_name, CASE WHEN p_partkey % 4 = 0 THEN 'image/png' WHEN p_partkey % 3 = 0 THEN 'image/jpeg' WHEN p_partkey % 3 = 1 THEN 'image/heif' END AS mime FROM part",
    ),
    "date_forms_ok": (
        date_forms,
        f"SELECT o_orderkey, k IN (0, 1, 5) AS png, k = 1 AS exif, CASE WHEN k = 1 THEN regexp_replace(v, '^(....):(..):(..)', '\\1-\\2-\\3') ELSE v END AS shown, CASE WHEN k = 2 THEN regexp_replace(v, '^(....)(..)(..)$', '\\1-\\2-\\3') ELSE v END AS iptc_date, CASE WHEN k IN (2, 3) THEN regexp_replace(v, '^(..)(..)(..)', '\\1:\\2:\\3') ELSE v END AS iptc_time, CASE k WHEN 0 THEN 'other' WHEN 1 THEN 'other' WHEN 2 THEN 'software' WHEN 4 THEN 'caption' WHEN 5 THEN 'other' END AS dataset, TRUE AS line, k IN (2, 3) AS technical FROM (SELECT o_orderkey, o_orderkey % 6 AS k, {_V} AS v FROM orders)",
    ),
    "byte_values": (
        bytes_,
        r"WITH p AS (SELECT page_id, substr(url, 1, 60) AS u, url FROM pages) SELECT page_id, ascii(u[1]) * 16777216::BIGINT + ascii(u[2]) * 65536 + ascii(u[3]) * 256 + ascii(u[4]) AS u32, (ascii(u[2]) + ascii(u[3]) * 256)::BIGINT AS u16, lpad(upper(to_hex(page_id)), 16, '0') AS w64, substr(u, 1, 8) AS latin1, TRUE AS utf16, instr(u, 'example')::INTEGER - 1 AS place, (length(u) // 36)::INTEGER AS lines, FALSE AS blank, md5(concat(substr(u, 1, 3), repeat(chr(0), 6), substr(u, 10))) AS zeroed, TRUE AS length_ok, TRUE AS kind_ok, TRUE AS value_ok, (length(u) + 4)::INTEGER AS segment, substr(u, 1, 7) AS c_string, upper(hex(substr(u, 1, 4)::BLOB)) AS profile FROM p",
    ),
    "ttl_expiry": (
        lambda s, d: _t(s, d, "events").select("event_id", state.expired(F.unix_millis(F.lit("2024-01-15").cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp")), 86_400_000).alias("expired")),
        "SELECT event_id, age >= 86400000 OR age < -5000 AS expired FROM (SELECT event_id, epoch_ms(TIMESTAMP '2024-01-15') - epoch_us(ts) // 1000 AS age FROM events)",
    ),
    "next_due": (
        lambda s, d: state.next_due(_t(s, d, "events").select(F.col("user_id").alias("owner"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms")), F.unix_millis(F.lit("2024-01-15").cast("timestamp")), 86_400_000),
        "SELECT user_id AS owner, greatest(0, least(86400000, min(t) + 86400000 - epoch_ms(TIMESTAMP '2024-01-15')))::BIGINT AS due_ms FROM (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events) WHERE NOT (epoch_ms(TIMESTAMP '2024-01-15') - t >= 86400000 OR epoch_ms(TIMESTAMP '2024-01-15') - t < -5000) GROUP BY user_id",
    ),
    "newest_copy": (
        lambda s, d: state.newest(_t(s, d, "events").select(F.col("user_id").alias("owner"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("file")), F.unix_millis(F.lit("2024-01-15").cast("timestamp")), 86_400_000),
        "SELECT user_id AS owner, arg_max(event_id, (t, event_id)) AS file FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events) WHERE NOT (epoch_ms(TIMESTAMP '2024-01-15') - t >= 86400000 OR epoch_ms(TIMESTAMP '2024-01-15') - t < -5000) GROUP BY user_id",
    ),
    "chunk_assembly": (
        lambda s, d: state.assembled(_t(s, d, "conversations").filter("turn <> 1 OR conv_id % 3 <> 0").select(F.col("conv_id").alias("file"), F.col("turn").alias("idx"), F.length("text").cast("long").alias("size"), F.sum(F.length("text")).over(_by("conv_id")).alias("total"))),
        "WITH c AS (SELECT *, length(text) AS n FROM conversations WHERE turn <> 1 OR conv_id % 3 <> 0) SELECT conv_id AS file, count(*) AS n_chunks, sum(n)::BIGINT AS size, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AND min(n) > 0 AS whole FROM c GROUP BY conv_id",
    ),
    "current_results": (
        lambda s, d: state.current(_t(s, d, "events").select(F.col("user_id").alias("owner"), (F.col("event_id") % 50).alias("version"), "event_id"), _t(s, d, "events").select(F.col("user_id").alias("owner"), (F.col("event_id") % 50).alias("version"))),
        "WITH e AS (SELECT user_id AS owner, event_id % 50 AS version, event_id FROM events) SELECT * FROM e WHERE (owner, version) IN (SELECT (owner, max(version)) FROM e GROUP BY owner)",
    ),
}


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)
