"""The mixture's targets against water-filling by hand, and its words against the targets."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from picmeta.llm import queries as llm
from picmeta.llm import source_mix


def wanted(sizes, share=1.5, cap=2.0):
    weight = dict(zip(sorted(sizes), (3, 1, 2) * len(sizes)))
    left, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_words(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.source, len(re.findall(rb"[^\x20\x09-\x0d]+", (r.text or "").encode()))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = Counter()
    for source, n in docs.values():
        sizes[source] += n
    target, taken = wanted(sizes), Counter()
    rows = llm.queries()["op7_source_mix"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        source, n = docs[r.doc_id]
        assert r["size"] == n and r.source_size == sizes[source] and r.taken <= 2 * n
        assert r.target == pytest.approx(target[source], rel=1e-9)
        taken[source] += r.taken
    for source in sizes:
        assert taken[source] == pytest.approx(target[source], rel=0.02)


def test_reruns_agree_over_other_files(spark):
    """The same rows in 1, 7 and 211 parts, in other orders, give the same copies of each text, repeated rows and null ids included."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    extra = spark.createDataFrame([(None, "one and the same row", "src0")] * 700 + [(1, None, None)] * 3 + [(1, "", None)] * 2, "doc_id long, text string, source string")
    every = docs.unionByName(extra).withColumn("size", F.lit("clash")).withColumn("uid", F.lit(0))
    found = []
    for n in (1, 7, 211):
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/mix_{n}"
        every.repartition(n, F.rand(n)).write.mode("overwrite").parquet(path)
        found.append(Counter(map(str, source_mix.mixture(spark.read.parquet(path)).collect())))
    assert found[0] == found[1] == found[2]
    mixed = source_mix.mix(spark.read.parquet(path))
    assert mixed.columns == every.columns and mixed.filter("doc_id IS NULL").count() > 0
    per_file = [r.n for r in source_mix.sized(spark.read.parquet(path).withColumn("__uid", F.monotonically_increasing_id())).filter("doc_id IS NULL").groupBy("nth").agg(F.count("*").alias("n")).collect()]
    assert per_file == [1] * 700


def test_rates_solve_the_dual(spark):
    """Each source's rates are min(cap, exp(lam * size)) with the lam that a bisection finds."""
    sizes = {"a": [3, 5, 40, 41, 200], "b": [10] * 6 + [1], "c": [7, 0, 90], None: [25, 26]}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, all_ in sizes.items() for n in all_)]
    got = source_mix.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in rows}
    target = wanted({s or "~": sum(n) for s, n in sizes.items()})
    for s, own in sizes.items():
        low, high = -5.0, 5.0
        for _ in range(200):
            lam = (low + high) / 2
            words = sum(n * min(2.0, math.exp(min(lam * n, 50))) for n in own)
            low, high = (lam, high) if words < target[s or "~"] else (low, lam)
        for r in got:
            if source[r.doc_id] == s:
                assert r.target == pytest.approx(target[s or "~"]) and r.rate == pytest.approx(min(2.0, math.exp(low * r["size"])), rel=1e-4)
                assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
