"""Merkle manifest of a dataset.

Each row is a leaf, each group of rows a tree, and the groups' roots are the
leaves of one more tree; its root stands for the whole dataset. A row is proven
by the digests beside its path, without the other rows.

1. `leaves`: the digest of a row's columns, the only pass over texts. From here
   on a row is a few digests.
2. `indexed`: the place of each leaf in its group. Rows are dealt by ranges of
   (group, order), so a group of any size is split; row_number counts inside a
   range, and the ranges' counts are added up.
3. `levels`: nodes with the same index floor-divided by the fanout become one:
   their sorted array of digests is hashed. Each level is a table with the array
   of each node's children; all levels together have half as many rows as leaves.
4. `proven`: from the top down, each level's table is joined with the paths of
   its nodes, and each child gets its siblings and its parent's path. The last
   join is that of the lowest nodes, so leaves are never joined one by one.

`leaf` writes a value as its UTF-8 byte count, a colon and the value, null as a
hyphen; so no two rows of values make the same bytes.

Null: a null group is a group of its own, before all others; rows with a null
order come first in their group. Ties of the order go by digest; rows that are
equal altogether are leaves each, side by side, in any order. Empty texts have
their own digest, other than null's. An empty table gives an empty result. All
other columns pass through, but for those named subroot, root and path, which
the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from picmeta.llm.shared import crc32_sql, cut

FANOUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l: binary, r: binary>>"


def leaf(columns: list[Column]) -> Column:
    """The digest, in hex, of a row of values."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def _hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def _hashed(hexed: Column) -> Column:
    return F.unhex(F.sha2(hexed.cast("binary"), 256))


def _joined(kids: Column) -> Column:
    return F.aggregate(kids, F.lit(b""), lambda a, x: F.concat(a, x["__d"]))


def indexed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with __i, the place in the group from 0, and __n, the group's size."""
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = cut(tied.repartitionByRange(group, *order, "__tie").withColumn("__range", F.spark_partition_id()))
    whole = Window.partitionBy(group)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(group, "__range").agg(F.count("*").alias("__size"))
    starts = sizes.select(group, "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"), F.sum("__size").over(whole).alias("__n"))
    nth = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order, "__tie")) - 1
    return dealt.withColumn("__nth", nth).join(starts, [group, "__range"]).withColumn("__i", F.col("__start") + F.col("__nth")).drop("__tie", "__range", "__nth", "__start")


def levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Tables (__g, __i, __n, __d, __kids) of the nodes above nodes (__g, __i, __n, __d, ...), lowest first; __n: the group's nodes on that level, and further columns of nodes stay in __kids."""
    most, found = nodes.agg(F.max("__n")).first()[0] or 0, []
    while most > 1:
        kid = F.struct("__i", "__d", *(c for c in nodes.columns if c not in ("__g", "__i", "__n", "__d")))
        up = nodes.filter("__n > 1").groupBy("__g", F.floor(F.col("__i") / fanout).alias("__p")).agg(F.max("__n").alias("__n"), F.sort_array(F.collect_list(kid)).alias("__kids"))
        table = cut(up.select("__g", F.col("__p").alias("__i"), F.ceil(F.col("__n") / fanout).alias("__n"), _hashed(F.concat_ws("", F.transform("__kids", lambda x: _hex(x["__d"])))).alias("__d"), "__kids"))
        found.append(table)
        nodes, most = table.drop("__kids"), -(-most // fanout)
    return found


def tops(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(__g, __d): what remains of each group."""
    out = nodes.filter("__n = 1").select("__g", "__d")
    for t in above:
        out = out.unionByName(t.filter("__n = 1").select("__g", "__d"))
    return out


def proven(nodes: DataFrame, above: list[DataFrame], start: DataFrame) -> DataFrame:
    """All columns of nodes but __i and __n, with those of start (__g, path, ...): path then begins with the node's own siblings."""
    more = [c for c in start.columns if c not in ("__g", "path")]
    own = [c for c in nodes.columns if c not in ("__g", "__i", "__n")]
    paths = None
    for k, t in reversed(list(enumerate(above))):
        done = t.filter("__n = 1").select("__g", "__i").join(start, "__g")
        paths = done if paths is None else paths.unionByName(done)
        kids = t.select("__g", "__i", "__kids").join(paths, ["__g", "__i"]).select("*", F.posexplode("__kids").alias("__at", "__kid"))
        beside = F.struct(_joined(F.slice("__kids", F.lit(1), F.col("__at"))).alias("l"), _joined(F.slice("__kids", F.col("__at") + 2, F.size("__kids"))).alias("r"))
        kept = ["__kid.__i"] if k else [f"__kid.`{c}`" for c in own]
        paths = kids.select("__g", *kept, F.concat(F.array(beside), "path").alias("path"), *more)
    alone = nodes.filter("__n = 1").select("__g", *own).join(start, "__g")
    return alone if paths is None else alone.unionByName(paths)


def manifest(rows: DataFrame, group: str = "source", order: str = "doc_id", fanout: int = FANOUT) -> DataFrame:
    """All columns of rows (which have their digest, in hex, in `leaf`), then subroot and root in hex and path: per level what is left and right of the node among its siblings, digest after digest."""
    rows = rows.drop("subroot", "root", "path")
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # sorts as the group does, null first
    nodes = cut(indexed(cut(rows.select(key.alias("__g"), F.unhex("leaf").alias("__d"), F.col(order).alias("__o"), F.struct(*rows.columns).alias("__row"))), "__g", ["__o", "__d"]).drop("__o"))
    above = levels(nodes, fanout)
    groups = tops(nodes, above).select(F.lit("").alias("__g"), F.col("__g").alias("__name"), "__d")
    roots = cut(indexed(groups, "__g", ["__name"]))
    over = levels(roots, fanout)
    ends = tops(roots, over).select("__g", F.array().cast(PATH).alias("path"), F.col("__d").alias("__root"))
    start = cut(proven(roots, over, ends).select(F.col("__name").alias("__g"), "path", F.col("__d").alias("__sub"), "__root"))
    return proven(nodes, above, start).select("__row.*", _hex(F.col("__sub")).alias("subroot"), _hex(F.col("__root")).alias("root"), "path")


def proof(path: Column) -> Column:
    """One digest, in hex, of all siblings of a path, lowest level first."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(_hex(x["l"]), _hex(x["r"])))).cast("binary"), 256)


def folded(leaf_hex: Column, path: Column) -> Column:
    """The root, in hex, that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf_hex, lambda a, x: F.sha2(F.concat(_hex(x["l"]), a, _hex(x["r"])).cast("binary"), 256))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every second row, by the checksum of its id, is checked with the line ends of its text deleted; a row without an id isn't."""
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf([F.replace(F.col(c).cast("string"), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS]))
    known = manifest(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), leaf([F.col(c) for c in COLUMNS]).alias("leaf"), other.alias("other")))
    now = known.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return now.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    values = [f"{c}::VARCHAR" for c in COLUMNS[:-1]] + [text]
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in values) + "))"


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf_sql('text')} AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS other FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
up AS (SELECT 0 AS lvl, g, i, n, leaf AS h FROM n UNION ALL SELECT lvl + 1, g, i // {FANOUT}, any_value((n + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lvl, g, i // {FANOUT}),
subs AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, i, n, h FROM subs UNION ALL SELECT lvl + 1, i // {FANOUT}, any_value((n + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // {FANOUT}),
k AS (SELECT lvl, g, i // {FANOUT} AS p, list(h ORDER BY i) AS kids FROM up WHERE n > 1 GROUP BY ALL),
kt AS (SELECT lvl, i // {FANOUT} AS p, list(h ORDER BY i) AS kids FROM top WHERE n > 1 GROUP BY ALL),
climb AS (SELECT g, i AS leaf_i, 0 AS lvl, i, '' AS beside, coalesce(other, leaf) AS h FROM n UNION ALL
  SELECT c.g, leaf_i, c.lvl + 1, c.i // {FANOUT}, concat(beside, array_to_string(list_filter(kids, lambda x, j: j <> c.i % {FANOUT} + 1), '')), sha256(array_to_string(list_transform(kids, lambda x, j: CASE WHEN j = c.i % {FANOUT} + 1 THEN c.h ELSE x END), '')) FROM climb c JOIN k ON k.lvl = c.lvl AND k.g = c.g AND k.p = c.i // {FANOUT}),
half AS (SELECT g, leaf_i, arg_max(beside, lvl) AS beside, arg_max(h, lvl) AS h FROM climb GROUP BY g, leaf_i),
more AS (SELECT half.g, leaf_i, 0 AS lvl, s.i, beside, half.h, s.h AS subroot FROM half JOIN subs s USING (g) UNION ALL
  SELECT c.g, leaf_i, c.lvl + 1, c.i // {FANOUT}, concat(beside, array_to_string(list_filter(kids, lambda x, j: j <> c.i % {FANOUT} + 1), '')), sha256(array_to_string(list_transform(kids, lambda x, j: CASE WHEN j = c.i % {FANOUT} + 1 THEN c.h ELSE x END), '')), subroot FROM more c JOIN kt ON kt.lvl = c.lvl AND kt.p = c.i // {FANOUT}),
whole AS (SELECT g, leaf_i, any_value(subroot) AS subroot, arg_max(beside, lvl) AS beside, arg_max(h, lvl) AS h FROM more GROUP BY g, leaf_i)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(beside) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified FROM n JOIN whole w ON w.g = n.g AND w.leaf_i = n.i CROSS JOIN (SELECT h FROM top WHERE n = 1) r"""
