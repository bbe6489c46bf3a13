"""Many strings in many files against plain search; runs inside runs."""

import base64
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from picmeta.functions import grams
from picmeta.operators import audit

CODECS = {"UTF-8": "utf-8", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be"}


def test_found(spark):
    """Needles of 1 to 60 characters with and without signs, in files with several of them, repeated paths, nulls."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdé", k=n))
    needles = {0: "", 1: None, 2: "q", 3: "é", 4: "\U00010000"} | {i: (word(rng.randint(1, 9)) if i % 3 else " ".join(word(rng.randint(1, 7)) for _ in range(8))) for i in range(5, 60)}
    files = [(1, None), (2, b""), (3, b"\xff\xfe\x00q")]
    for i in range(4, 60):
        parts = [rng.choice([rng.randbytes(5), b" ", word(20).encode(), (needles[rng.randrange(5, 60)]).encode(rng.choice(list(CODECS.values())))]) for _ in range(6)]
        files.append((i // 2, b"".join(parts)))  # two rows with each path
    want = {(p, n, e) for p, b in files for n, t in needles.items() for e, codec in CODECS.items() if t and b and t.encode(codec) in b}
    df = spark.createDataFrame(files, "path int, content binary").repartition(3)
    got = audit.found(df, spark.createDataFrame(list(needles.items()), "needle_id int, needle string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert audit.found(df, spark.createDataFrame([(1, "")], "needle_id int, needle string")).collect() == []
    assert audit.found(df.limit(0), spark.createDataFrame([(1, "ab")], "needle_id int, needle string")).collect() == []


def test_opened(spark):
    deep = ("a needle in the innermost run, " * 4).encode()
    twice = base64.b64encode(deep).hex().encode()
    files = [(1, b"x " + twice + b" y"), (2, None), (3, b"plain"), (4, b"AAA" + base64.b64encode(twice))]
    got = {(r.path, r.kind): bytes(r.content) for r in audit.opened(spark.createDataFrame(files, "path int, content binary")).collect()}
    assert got[1, "hex/base64"] == deep and got[1, "hex"] == base64.b64encode(deep) and got[3, "raw"] == b"plain" and (2, "raw") not in got
    assert (1, "raw") in got


def test_contained(spark):
    rows = [("a", "one two"), ("b", "say one two three"), ("c", "one two"), ("d", None), ("e", ""), ("f", "three")]
    got = {tuple(r) for r in audit.contained(spark.createDataFrame(rows, "needle_id string, needle string")).collect()}
    assert got == {("a", "b"), ("c", "b"), ("f", "b")}


def test_visibility(spark):
    registry = [(1, "f", "one", None, None, None), (2, "f", "2024:01", "EXIF", "Date", "2024-01"), (3, "f", "absent", "EXIF", "Date", "1999"), (4, "g", "one", None, None, None), (5, "f", "", None, None, None), (6, None, None, None, None, None), (1, "f", "zzz", None, None, None)]
    shown = [("f", "EXIF", "Date", "2024-01"), ("f", "XMP", "Title", "say one two"), ("g", "XMP", "Title", None), (None, None, None, "one")]
    cols = "grp string, name string, value string"
    got = audit.visibility(spark.createDataFrame(registry, f"needle_id int, path string, needle string, {cols}"), spark.createDataFrame(shown, f"path string, {cols}"))
    assert {r.needle_id: r.verdict for r in got.collect()} == {1: "yes", 2: "reformatted", 3: "no", 4: "no", 5: "no", 6: "no"}


def test_contained_with_a_common_beginning(spark):
    """Texts that begin alike meet by their rarest gram, not by the first: few pairs are compared."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    rows = [(i, " the same words begin every text of these, and then " + " ".join(word() for _ in range(40))) for i in range(300)]
    rows += [(1000 + i, t[:200]) for i, t in rows[:20]] + [(2000, "Avec."), (2001, "and they say Avec. to it")]
    df = spark.createDataFrame(rows, "needle_id int, needle string")
    assert {tuple(r) for r in audit.contained(df).collect()} == {(1000 + i, i) for i in range(20)} | {(2000, 2001)}
    texts = df.select(F.encode("needle", "UTF-8").alias("b"), F.xxhash64(F.encode("needle", "UTF-8")).alias("h"))
    assert audit.met(texts.select(F.col("h").alias("row"), F.col("b").alias("content")), texts.select(F.col("h").alias("key"), F.col("b").alias("bytes"))).count() < 2_000


def test_contained_by_rows(spark):
    """A row for each pair of rows, also if they share an id; equal texts are no pairs, however many."""
    rows = [("a", "one two"), ("a", "zebra"), ("b", "say one two three"), ("b", "say one two three"), ("c", "say")] + [("e", "a text that is there many times")] * 50
    got = sorted(tuple(r) for r in audit.contained(spark.createDataFrame(rows, "needle_id string, needle string")).collect())
    assert got == [("a", "b"), ("a", "b"), ("c", "b"), ("c", "b")]


def test_near_copies_do_not_meet(spark):
    """Long texts that differ in one word meet by few pairs: the grams of a long text are long."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(600)]
    rows = [(i, " ".join([*words[:at], f"other{i}", *words[at + 1 :]]) + "x" * (i % 9)) for i, at in enumerate(range(20, 580, 2))]
    texts = spark.createDataFrame(rows, "i int, t string").select(F.encode("t", "UTF-8").alias("b"), F.xxhash64(F.encode("t", "UTF-8")).alias("h"))
    assert audit.met(texts.select(F.col("h").alias("row"), F.col("b").alias("content")), texts.select(F.col("h").alias("key"), F.col("b").alias("bytes"))).count() < 4_000


def test_grams_of_parts():
    """What a part of a content picks is among the content's grams, whatever the windows; only what was picked is asked."""
    rng, window = random.Random(7), grams.WINDOW
    try:
        for n in (4, 60, 900, 9000):
            content = " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(n)).encode()
            parts = [content[i : i + 1 + rng.choice([1, 3, 9, 30, 200, 3000, 40000])] for i in (rng.randrange(len(content)) for _ in range(20))]
            grams.WINDOW = rng.choice([700, 40_000])
            picks = [(w, int(r), int(x)) for w, row, h in grams.picked(pa.array([b"", *parts], pa.binary())) for r, x in zip(row, h, strict=True)]
            grams.WINDOW = rng.choice([700, 40_000])
            wanted = np.zeros(1 << 15, np.uint8)
            for w, _, x in picks:
                for k in range(grams.hashes(w)):
                    bit = int(grams.bit_of(np.array([x], np.uint64), len(wanted) * 8, k)[0])
                    wanted[bit >> 3] |= 1 << (bit & 7)
            row, h = grams.asked(pa.array([b"no", content, b""], pa.binary()), sorted({w for w, _, _ in picks}), wanted)
            assert {r for _, r, _ in picks} == set(range(1, 21)) and {x for _, _, x in picks} <= set(h[row == 1].tolist())
    finally:
        grams.WINDOW = window
