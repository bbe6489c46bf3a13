"""The manifest against plain trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from picmeta.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes):
    """The root of digests, and for each its siblings level by level."""
    at, beside, now = list(range(len(nodes))), [[] for _ in nodes], nodes
    while len(now) > 1:
        for k, i in enumerate(at):
            run = now[i - i % 3 : i - i % 3 + 3]
            beside[k].append((run[: i % 3], run[i % 3 + 1 :]))
            at[k] = i // 3
        now = [h(*now[i : i + 3]) for i in range(0, len(now), 3)]
    return now[0] if now else None, beside


def plain(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[1], []).append(r)
    trees = [(own, *climbed([leaf(r) for r in own])) for own in groups.values()]
    root, over = climbed([sub for _, sub, _ in trees])
    out = []
    for (own, sub, beside), up in zip(trees, over, strict=True):
        for r, b in zip(own, beside, strict=True):
            path, now = b + up, leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r[0], leaf(r), sub, root, h(*(x for left, right in path for x in left + right)), now, now == root))
    return out


def got(df):
    return sorted(map(str, map(tuple, merkle.digest(df).collect())))


def test_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, a group of one row, names of other scripts, a clashing column."""
    rows = [(i, f"s{i % 4}", "en", i, f"line {i}\nline\n" * (i % 3)) for i in range(60)]
    rows += [(None, None, None, None, None), (None, "s1", "en", 1, "x\ny"), (5, "s1", "en", 5, "other"), (900, None, "de", 3, ""), (901, "é", "fr", 3, "é\n"), (902, "", None, None, "a\n" * 200_000)]
    rows += [(7, "s3", "en", 7, "same\n")] * 5
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df.withColumn("root", F.lit(1)).withColumn("path", F.lit("x")).repartition(5)) == sorted(map(str, plain(rows)))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_sizes(spark, n):
    rows = [(i, "s", "en", 1, f"t{i}\n") for i in range(n)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == sorted(map(str, plain(rows)))


def test_split_group(spark):
    """A group over many ranges, and a third of its rows with one id and one content."""
    rows = [(i, "hot", "en", 1, f"t{i}") for i in range(2000)] + [(77, "hot", "en", 1, "copy\n")] * 1000 + [(i, f"s{i}", "en", 1, "x") for i in range(20)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert got(spark.createDataFrame(rows, SCHEMA).repartition(9)) == sorted(map(str, plain(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_manifest_keeps_columns_and_finds_a_change(spark):
    rows = [(i, f"s{i % 2}", "en", 1, f"t{i}") for i in range(30)]
    own = [F.col(c) for c in merkle.COLUMNS]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", merkle.leaf(own))
    m = merkle.manifest(df, fanout=4)
    assert m.columns == [*df.columns, "subroot", "root", "path"]
    changed = m.withColumn("text", F.when(F.col("doc_id") == 11, "other").otherwise(F.col("text")))
    bad = changed.filter(merkle.folded(merkle.leaf(own), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in bad.collect()] == [11]
