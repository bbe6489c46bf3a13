"""Edits and pointers against plain slicing."""

import random

from pyspark.sql import functions as F

from picmeta.functions import splices

ROWS = f"id int, t string, e array<{splices.EDIT}>, p array<int>"


def plain(text, edits):
    """The new text, and where each old place went; None if the edits clash."""
    if text is None or edits is None:
        return None
    own, at, out, to = sorted(enumerate(edits), key=lambda x: (x[1][0], x[1][1], x[0])), 0, "", {}
    for _, (s, e, data) in own:
        if s < at or e < s or e > len(text):
            return None
        for i in range(at, s):
            to[i] = len(out) + i - at
        out, at = out + text[at:s] + (data or ""), e
    return out + text[at:], to | {i: len(out) + i - at for i in range(at, len(text))}


def test_edits(spark):
    rng = random.Random(11)
    rows = [(0, None, [], [0]), (1, "abc", None, [0]), (2, "", [], []), (3, "abc", [(0, 9, "x")], [0]), (4, "abcdef", [(1, 3, ""), (2, 4, "y")], [0]), (5, "abc", [(1, 1, "x"), (1, 1, "y")], [0, 1]), (6, "abc", [(2, 1, "")], [0]), (7, "äb𐀀d", [(1, 2, None)], [0, 1, 2, 3])]
    for i in range(8, 150):
        text = "".join(rng.choices("abcé\n", k=rng.randint(0, 30)))
        rows.append((i, text, [(s := rng.randint(0, len(text)), min(len(text) + (rng.random() < 0.1), s + rng.choice([0, 1, 4])), "z" * rng.randint(0, 5)) for _ in range(rng.randint(0, 3))], list(range(len(text)))))
    df = spark.createDataFrame(rows, ROWS)
    got = df.select("id", splices.spliced(F.col("t"), F.col("e")).alias("new"), F.transform("p", lambda p: splices.followed(p, F.col("e"))).alias("to")).collect()
    refused = 0
    for r in got:
        _, text, edits, places = rows[r.id]
        want = plain(text, edits)
        refused += want is None
        assert r.new == (want and want[0]), rows[r.id]
        if want:
            assert r.to == [want[1].get(p) for p in places], rows[r.id]
    assert 10 < refused < 100


def test_pointers_grow(spark):
    """The line of pointers grows past 9, 99 and 999, and every pointer still points at its place."""
    rows = [(n, "x" * n + "!" + "y" * 2000, [], [n + i for i in range(k)]) for n in (0, 5, 90, 880, 985) for k in (0, 1, 3, 40)]
    for r in spark.createDataFrame(rows, ROWS).select("t", "p", splices.headed(F.col("t"), F.col("p")).alias("h")).collect():
        line, _, body = r.h.content.partition("\n")
        assert body == r.t and [int(x) for x in line.split(",") if x] == r.h.pointers
        assert all(r.h.content[to] == r.t[at] and to == at + len(line) + 1 for at, to in zip(r.p, r.h.pointers, strict=True))


def test_matches(spark):
    df = spark.createDataFrame([(None,), ("",), ("aab aab",), ("b",), ("a" * 2000,)], "t string")
    got = [r.m and [tuple(x) for x in r.m] for r in df.select(splices.matches(F.col("t"), "a+").alias("m")).collect()]
    assert got == [None, [], [(0, 2, "aa"), (4, 6, "aa")], [], [(0, 2000, "a" * 2000)]]
