"""Details of the files that orders stand for (a customer is a file, an order a field), and their lists; with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from picmeta.functions import forms, text
from picmeta.operators import listing, selection

ALL_TAGS = sorted(t for tags in forms.TAGS.values() for t in tags) + [1, 2]  # and two that no table has
DATE = "yyyy:MM:dd HH:mm:ss"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, pos, tag, value): a field per order. Values are dates, numbers, names, and names with an address."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = F.element_at(F.array(F.date_format("o_orderdate", DATE), F.floor("o_totalprice").cast("string"), F.concat(F.lit("Maker "), F.col("o_orderpriority")), F.concat(F.col("o_orderstatus"), F.lit("@place"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("pos"), F.element_at(F.array(*map(F.lit, ALL_TAGS)), (F.col("o_orderkey") * 37 % len(ALL_TAGS) + 1).cast("int")).alias("tag"), value.alias("value"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.classified(facts(spark, sf_dir))


def with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.suffixed(items(spark, sf_dir))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that are red somewhere, without those of the maker while the camera is amber."""
    rows = items(spark, sf_dir).groupBy("key", "tier").agg(F.count("*").alias("n"))
    return selection.defaults(rows, ("serial", "makernote"), ("camera",))


def after_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a read-back of the saved files shows: all but every seventh field, and one new detail in every tenth file."""
    own = with_ids(spark, sf_dir)
    new = own.select("path").distinct().filter("path % 10 = 0").select("path", F.lit("new").alias("id"))
    return own.filter("pos % 7 <> 0").select("path", "id").unionByName(new)


def read_back(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = with_ids(spark, sf_dir)
        return f(own, selection.removals(own, chosen(spark, sf_dir)).select("path", "id"), after_save(spark, sf_dir))

    return run


def _items_of(*columns: str):
    return lambda spark, sf_dir: items(spark, sf_dir).select(*columns)


_TAGS = "[" + ", ".join(map(str, ALL_TAGS)) + "]"
#: The keys of tags once more, in decimal, so that the SQL doesn't follow a slip in the code's table.
_SQL_KEYS = """
serial 42033 50735
lens-serial 42037
unique-id 42016
owner 315 42032 40093 42039 42040
copyright 33432
datetime 306 36867 36868 37520 37521 37522
timezone 36880 36881 36882 34858
camera 271 272 50708
lens 42034 42035 42036
software 305 42041 42042 42043 42044
computer 316
description 270 37510 40091 40092 40094 40095 42038 269 285 18246 18249
makernote 37500
embedded 700 33723 34377
private 50341 330
orientation 274
resolution 282 283 296
colour 40961 42240 318 319 529 532 34675 301
dimensions 40962 40963 256 257
exposure 33434 33437 34850 34852 34855 34856 34864 34865 34866 34867 34868 34869 37377 37378 37379 37380 37381 37382 37383 37384 37385 37386 37396 37888 37889 37890 37891 37892 37893 41483 41484 41486 41487 41488 41492 41493 41495 41728 41729 41730 41985 41986 41987 41988 41989 41990 41991 41992 41993 41994 41995 41996 42080 42081 42082
format 36864 40960 37121 37122 530 531 259 258 262 277 284 254 59932 59933 263 264 265 266 273 278 279 280 281 290 291 292 293 297 317 320 321 322 323 324 325 338 339 347 50706
other 513 514 34665 34853 40964 40965
"""
_KEYS = "(VALUES " + ", ".join(f"({t}, '{row.split()[0]}')" for row in _SQL_KEYS.strip().splitlines() for t in row.split()[1:]) + ") AS t(tag, key)"
_DEFS = "(VALUES " + ", ".join(f"('{k}', '{g}', '{t}', '{label}', {i}, {forms.GROUPS.index(g)}, {forms.TIERS.index(t)})" for i, (k, g, t, label) in enumerate(forms.ITEMS)) + ") AS t(key, grp, tier, label, nth, grp_rank, tier_rank)"
_DEVICE = f"(length(value) BETWEEN 1 AND 64 AND regexp_matches(value, '{forms.DEVICE}') AND NOT contains(value, '  ') AND NOT suffix(value, ' ') AND NOT regexp_matches(value, '{forms.UNSEEN}') AND NOT regexp_matches(value, '{forms.ADDRESS}'))"
_AMBER = f"CASE key WHEN 'datetime' THEN regexp_matches(value, '{forms.EXIF_DATE}') OR regexp_matches(value, '^\\d{{1,9}}$') WHEN 'timezone' THEN regexp_matches(value, '{forms.ZONE}') WHEN 'other' THEN regexp_matches(value, '{forms.SHORT_FILE}') ELSE {_DEVICE} END"
_TECH = f"(value IN ('R98', 'THM', 'R03') OR (len(regexp_split_to_array(value, ', ?| ')) <= 8 AND len(list_filter(regexp_split_to_array(value, ', ?| '), lambda x: NOT regexp_matches(x, '{forms.VALUE}'))) = 0))"
ITEMS = f"""facts AS (SELECT o_custkey AS path, o_orderkey AS pos, {_TAGS}[(o_orderkey * 37 % {len(ALL_TAGS)} + 1)::INTEGER] AS tag,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') WHEN 1 THEN floor(o_totalprice)::BIGINT::VARCHAR WHEN 2 THEN concat('Maker ', o_orderpriority) ELSE concat(o_orderstatus, '@place') END AS value FROM orders),
defs AS (SELECT * FROM {_DEFS}),
keyed AS (SELECT path, pos, facts.tag, value, coalesce(t.key, 'private') AS key FROM facts LEFT JOIN {_KEYS} ON facts.tag = t.tag),
judged AS (SELECT path, pos, tag, value, CASE WHEN tier = 'green' AND NOT {_TECH} THEN 'technical-text' WHEN tier = 'amber' AND NOT ({_AMBER}) THEN 'device-text' ELSE key END AS key FROM (SELECT keyed.*, defs.tier FROM keyed JOIN defs USING (key))),
items AS (SELECT path, pos, tag, value, key, grp, tier, label, nth, grp_rank, tier_rank FROM judged JOIN defs USING (key))"""
IDS = f"""{ITEMS},
ids AS (SELECT *, CASE WHEN n = 1 THEN key ELSE concat(key, ':', n) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY path, key ORDER BY pos) AS n FROM items))"""
CHOSEN = "chosen AS (SELECT DISTINCT key FROM items WHERE tier = 'red' AND NOT ((SELECT coalesce(bool_or(key = 'camera' AND tier = 'amber'), FALSE) FROM items) AND key IN ('serial', 'makernote')))"
BACK = f"""{IDS}, {CHOSEN},
gone AS (SELECT path, id FROM ids WHERE key IN (SELECT key FROM chosen)),
back AS (SELECT path, id FROM ids WHERE pos % 7 <> 0 UNION ALL SELECT DISTINCT path, 'new' FROM ids WHERE path % 10 = 0)"""
_FEW = "concat(array_to_string(list_slice(v, 1, 3), ', '), CASE WHEN len(v) > 3 THEN concat(' and ', len(v) - 3, ' more') ELSE '' END)"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "classified_items": (_items_of("path", "pos", "tag", "value", "key", "grp", "tier", "label"), f"WITH {ITEMS} SELECT path, pos, tag, value, key, grp, tier, label FROM items"),
    "suffixed_ids": (lambda s, d: with_ids(s, d).select("path", "pos", "id"), f"WITH {IDS} SELECT path, pos, id FROM ids"),
    "item_groups": (lambda s, d: listing.grouped(items(s, d)), f"WITH {ITEMS}, g AS (SELECT path, key, count(*) AS n, list(value ORDER BY pos) AS vs FROM items GROUP BY path, key), u AS (SELECT path, key, n, list_filter(vs, lambda x, i: list_position(vs, x) = i) AS v FROM g) SELECT path, key, n, {_FEW} AS value FROM u"),
    "last_copies": (lambda s, d: listing.last_wins(items(s, d).withColumn("name", F.col("tag"))), f"WITH {ITEMS} SELECT path, key, tag AS name, arg_max(value, pos) AS value FROM items GROUP BY path, key, tag"),
    "tier_counts_text": (lambda s, d: listing.tier_counts(items(s, d)), f"WITH {ITEMS} SELECT path, concat_ws(', ', {', '.join(f'''CASE WHEN count(*) FILTER (tier = '{t}') > 0 THEN concat(count(*) FILTER (tier = '{t}'), ' {t}') END''' for t in forms.TIERS)}) AS counts FROM items GROUP BY path"),
    "file_privacy": (
        lambda s, d: listing.privacy(items(s, d), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("path"))),
        f"WITH {ITEMS} SELECT c_custkey AS path, CASE WHEN count(i.path) = 0 THEN 'clean' WHEN bool_or(tier = 'red') THEN 'custom' WHEN bool_or(tier = 'amber') THEN 'public' ELSE 'minimal' END AS word FROM customer LEFT JOIN items i ON i.path = c_custkey GROUP BY c_custkey",
    ),
    "batch_rows": (
        lambda s, d: listing.merged(items(s, d)),
        f"WITH {ITEMS} SELECT key, count(*) AS n, count(DISTINCT value) AS n_values, min(tier_rank) AS tier_rank, arg_min(grp, (path, pos)) AS grp, arg_min(label, (path, pos)) AS label, arg_min(value, (path, pos)) AS value FROM items GROUP BY key",
    ),
    "batch_values": (
        lambda s, d: listing.merged(items(s, d)).join(F.broadcast(s.read.parquet(f"{d}/orders.parquet").agg(F.count_distinct("o_custkey").alias("files")))).select("key", text.in_batch(F.col("value"), F.col("n_values"), F.least("n", "files"), F.col("files")).alias("value")),
        f"WITH {ITEMS}, b AS (SELECT key, least(count(*), (SELECT count(DISTINCT path) FROM items)) AS n, count(DISTINCT value) AS k, arg_min(value, (path, pos)) AS v, (SELECT count(DISTINCT path) FROM items) AS f FROM items GROUP BY key) SELECT key, CASE WHEN f < 2 THEN v WHEN k > 1 THEN concat('Differs between pictures, ', w) ELSE concat(v, ' (', w, ')') END AS value FROM (SELECT *, CASE WHEN n = f THEN 'in every picture' ELSE concat('in ', format('{{:,}}', n), ' of ', format('{{:,}}', f), ' pictures') END AS w FROM b)",
    ),
    "removal_order": (lambda s, d: listing.ordered(items(s, d), "nth_row", "tier_rank", "grp_rank").select("path", "pos", "nth_row"), f"WITH {ITEMS} SELECT path, pos, row_number() OVER (PARTITION BY path ORDER BY tier_rank, grp_rank, pos)::INTEGER AS nth_row FROM items"),
    "group_tier_order": (lambda s, d: listing.ordered(items(s, d), "nth_row", "grp_rank", "tier_rank").select("path", "pos", "nth_row"), f"WITH {ITEMS} SELECT path, pos, row_number() OVER (PARTITION BY path ORDER BY grp_rank, tier_rank, pos)::INTEGER AS nth_row FROM items"),
    "definition_order": (lambda s, d: listing.ordered(items(s, d), "nth_row", "nth", "tag").select("path", "pos", "nth_row"), f"WITH {ITEMS} SELECT path, pos, row_number() OVER (PARTITION BY path ORDER BY nth, tag, pos)::INTEGER AS nth_row FROM items"),
    "capped_ids": (
        lambda s, d: listing.capped(items(s, d).select("path", "pos", "key"), 4).select("path", "pos", "id"),
        f"WITH {ITEMS}, f AS (SELECT path, key, row_number() OVER (PARTITION BY path ORDER BY min(pos), key) AS r FROM items GROUP BY path, key) SELECT path, pos, CASE WHEN r <= 4 THEN key ELSE 'more' END AS id FROM items JOIN f USING (path, key)",
    ),
    "first_k_then_rest": (
        lambda s, d: listing.folded(items(s, d).withColumn("size", F.length("value").cast("long")), "size").fillna(-1, "pos"),
        f"WITH {ITEMS}, r AS (SELECT path, pos, length(value) AS size, row_number() OVER (PARTITION BY path ORDER BY pos) AS k FROM items) SELECT path, pos, 1::BIGINT AS n, size FROM r WHERE k <= 4 UNION ALL SELECT path, -1, count(*), sum(size)::BIGINT FROM r WHERE k > 4 GROUP BY path",
    ),
    "warning_cap": (
        lambda s, d: listing.warned(items(s, d).select("path", "pos", F.concat(F.col("key"), F.lit(" is damaged")).alias("text")), 5),
        f"WITH {ITEMS}, w AS (SELECT path, pos, concat(key, ' is damaged') AS text FROM items), f AS (SELECT path, text, row_number() OVER (PARTITION BY path ORDER BY min(pos), text) AS nth FROM w GROUP BY path, text) SELECT path, nth::INTEGER AS nth, text FROM f WHERE nth <= 5 UNION ALL SELECT path, 6, concat('There were ', count(*), ' more problems with this file.') FROM w JOIN f USING (path, text) WHERE nth > 5 GROUP BY path",
    ),
    "default_selection": (chosen, f"WITH {ITEMS}, {CHOSEN} SELECT key FROM chosen"),
    "removals": (lambda s, d: selection.removals(with_ids(s, d), chosen(s, d)).select("path", "id"), f"WITH {BACK} SELECT path, id FROM gone"),
    "unknown_removals": (
        lambda s, d: selection.unknown(with_ids(s, d).select("path", F.when(F.col("pos") % 5 == 0, F.concat("id", F.lit("?"))).otherwise(F.col("id")).alias("id")), with_ids(s, d)),
        f"WITH {IDS} SELECT path, concat(id, '?') AS id FROM ids WHERE pos % 5 = 0",
    ),
    "lost_after_save": (read_back(selection.lost), f"WITH {BACK} SELECT path, id FROM ids WHERE (path, id) NOT IN (SELECT path, id FROM gone) AND (path, id) NOT IN (SELECT path, id FROM back)"),
    "extra_after_save": (read_back(selection.extra), f"WITH {BACK} SELECT DISTINCT path, id FROM back WHERE (path, id) NOT IN (SELECT path, id FROM ids) OR (path, id) IN (SELECT path, id FROM gone)"),
    "audit_selections": (
        lambda s, d: selection.selections(with_ids(s, d), ("camera",)),
        f"WITH {IDS} SELECT 'red' AS selection, path, id FROM ids WHERE tier = 'red' UNION ALL SELECT 'red-amber-own', path, id FROM ids WHERE tier <> 'green' AND key <> 'camera' UNION ALL SELECT 'red-amber', path, id FROM ids WHERE tier <> 'green' UNION ALL SELECT 'all', path, id FROM ids",
    ),
    "buildable_keys": (lambda s, d: selection.buildable(items(s, d).select("path", "key").distinct()), f"WITH {ITEMS} SELECT DISTINCT path, key FROM items WHERE key NOT IN ('makernote', 'thumbnail')"),
    "surviving_parts": (
        lambda s, d: selection.surviving(
            items(s, d).select("path", F.col("pos").alias("part"), (F.col("key") == "orientation").alias("structural"), F.col("value").alias("content")),
            items(s, d).filter("tier = 'red' OR pos % 11 = 0").select("path", F.col("pos").alias("part")),
            items(s, d).filter("pos % 3 = 0").select("path", F.col("pos").alias("part"), F.upper("value").alias("content")),
        ),
        f"WITH {ITEMS} SELECT path, pos AS part, CASE WHEN pos % 3 = 0 THEN upper(value) ELSE value END AS content FROM items WHERE key = 'orientation' OR NOT (tier = 'red' OR pos % 11 = 0)",
    ),
    "coupling_closure": (
        lambda s, d: selection.coupled(_parts(s, d).filter("pos % 50 = 0").select("path", "id"), _couples(s, d)),
        "WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey AS path, l_orderkey % 97 AS id, l_partkey % 97 AS other FROM lineitem), r AS (SELECT DISTINCT l_suppkey AS path, l_orderkey % 97 AS id, 0 AS hop FROM lineitem WHERE l_orderkey % 50 = 0 UNION SELECT l.path, l.other, hop + 1 FROM r JOIN l USING (path, id) WHERE hop < 2) SELECT DISTINCT path, id FROM r",
    ),
}


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") % 97).alias("id"), F.col("l_orderkey").alias("pos"))


def _couples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") % 97).alias("id"), (F.col("l_partkey") % 97).alias("other")).distinct()
