"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from picmeta.llm import variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    """{word: (form, root, n, n_near, form_n)}"""
    form, near = {}, {}
    for w, n in words.items():
        own = [x for x in words if one_edit(w, x)]
        near[w] = len(own)
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, near[w], words[form[w]] if form[w] else None)
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def made(rng, letters, n):
    """Words of few letters, so that most have near ones, runs of one letter included."""
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 9)))
        words.add(w)
        at = rng.randrange(len(w))
        words.add(rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :], w[:at] + w[at + 1 :] + "ab"]))
    return {w: rng.choice([2, 3, 30, 400, 5000]) for w in words}


@pytest.mark.parametrize(("letters", "n", "per_trie"), [("ab", 300, 1 << 16), ("ab", 300, 9), ("abé", 500, 40), ("aÿ", 200, 1)])
def test_all_pairs(spark, letters, n, per_trie):
    words = made(random.Random(n + per_trie), letters, n)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert got(variants.variants(df, per_trie)) == plain(words)


def test_common_prefix_over_many_tries(spark):
    """Long words that part only behind 300 letters, some ends of others, and a chain of forms."""
    rng, head = random.Random(1), "x" * 300
    words = {head + "".join(rng.choice("pq") for _ in range(rng.randint(1, 6))): rng.choice([2, 50, 900]) for _ in range(120)} | {head: 7, head[:-1]: 70_000}
    words |= {"abcdefgh": 2, "abcdefghi": 20, "abcdefghij": 200, "abcdefghijk": 2000}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(variants.variants(df, 5)) == plain(words)


def test_hub_written_by_no_pairs(spark):
    """A word and all its variants of one place: they are near to each other all."""
    words = {"hubword": 9000} | {"hubwor" + chr(c): 2 for c in range(ord("a"), ord("z") + 1) if chr(c) != "d"}
    assert got(variants.variants(spark.createDataFrame(list(words.items()), "word string, n long"), 4)) == plain(words)


def test_counts(spark):
    rows = [(1, "Straßen straßen STRASSEN strasse"), (None, "straßen straßen"), (2, None), (3, ""), (4, "longwordhere-longwordhere longwordhere's"), (4, "longwordhere"), (5, "z" * 100_000 + " " + "z" * 100_000), (6, "Ärztinnen ärztinnen Ärztinnen")]
    rows += [(i, "sentences sentences particular") for i in range(10, 150)]
    want = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            x = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if x % 31 == 0:
                run = run[: x % len(run)] + run[x % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n")
    assert {r.word: r.n for r in variants.counted(df).collect()} == want
    assert got(variants.digest(df)) == plain(want)
    assert len(want) > 4 and any(len(w) in (8, 9) and w not in ("sentences", "particular") for w in want)
    assert variants.digest(df.limit(0)).collect() == []
