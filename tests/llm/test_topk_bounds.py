"""Bounds from shared columns: exact results, few pairs scored, shards read once for several blocks of queries."""

import random

import numpy as np
import pyarrow as pa
import pytest

from picmeta.llm import topk_search as ts


@pytest.fixture(scope="module")
def texts():
    """1,200 texts in four languages, some of them copies but for a word."""
    rng = random.Random(5)
    words = [[b"%s%d" % (b"abcd"[x : x + 1], i) for i in range(3000)] for x in range(4)]
    odds = [1 / (i + 5) for i in range(3000)]
    own = [rng.choices(words[i % 4], odds, k=rng.choice((30, 120, 400))) for i in range(1170)]
    return [b" ".join(x) for x in own + [own[i][1:] + [b"other"] for i in range(28)]] + [b"", b"alone"]


def hits(texts, asked, floors, k=10):
    """What a shard of texts finds, and what all pairs give."""
    s = ts.inverted([(list(range(len(texts))), ts.counted(texts))])
    q, term, n, _, words = ts.counted(asked)
    own = [dict(zip(w.split(), [0] * 9999)) for w in texts]
    df = np.array([sum(w.as_py() in x for x in own) for w in words])
    weights = n * np.log(1 + (len(texts) - df[term] + 0.5) / (df[term] + 0.5))
    lens = np.array([len(x.split()) for x in texts])
    shard = ts.Shard(s | {"ids": np.array(s["ids"])}, words, lens.mean())
    off = np.searchsorted(q, np.arange(len(asked) + 1))
    want, counts = np.zeros((len(asked), len(texts))), [ts.counted([x]) for x in texts]
    place = {w.as_py(): i for i, w in enumerate(words)}
    for d, (_, t, tf, _, own) in enumerate(counts):
        vector = np.zeros(len(words))
        for i, f in zip(t, tf):
            if own[int(i)].as_py() in place:
                vector[place[own[int(i)].as_py()]] = f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lens[d] / lens.mean()))
        want[:, d] = np.bincount(q, weights * vector[term], len(asked))
    best = [[(d, want[x, d]) for d in np.lexsort((np.arange(len(texts)), -np.round(want[x], 9)))[:k] if want[x, d] > 0] for x in range(len(asked))]
    if floors:
        least = np.array([x[k - 1][1] if len(x) == k else 0.0 for x in best])
    else:
        least = np.zeros(len(asked))
    got = {x: list(zip(shard.ids[at].tolist(), score)) for x, at, score in shard.searches(term, weights, off, least, k)}
    return shard, got, {x: own for x, own in enumerate(best) if own}


@pytest.mark.parametrize("widths, share, together", [((1, 2, 4), 0.5, 7), (ts.WIDTHS, ts.SHARE, ts.TOGETHER)])
def test_few_pairs_are_scored(texts, monkeypatch, widths, share, together):
    for name, value in (("WIDTHS", widths), ("SHARE", share), ("TOGETHER", together)):
        monkeypatch.setattr(ts, name, value)
    asked = texts[::40] + texts[-2:] + [b"not there"]
    for floors in (False, True):
        shard, got, want = hits(texts, asked, floors)
        assert got.keys() == want.keys()
        for x in want:
            assert [d for d, _ in got[x]] == [d for d, _ in want[x]]
            assert [s for _, s in got[x]] == pytest.approx([s for _, s in want[x]], abs=1e-8)
    if share == ts.SHARE and widths == ts.WIDTHS and together > 7:
        assert shard.scored < len(asked) * len(texts) / 20


def test_terms_with_one_hash(texts, monkeypatch):
    monkeypatch.setattr(ts, "BYTES", np.zeros_like(ts.BYTES))
    _, got, want = hits(texts[:200], texts[:200:40], False)
    assert {x: [d for d, _ in own] for x, own in got.items()} == {x: [d for d, _ in own] for x, own in want.items()}


def test_words_of_slices():
    whole = pa.array(["x", "An odd\x0bb an", None, "", " \u00c9 \u00e9 ", "\x1c a"])
    _, _, n, lens, terms = ts.counted(whole[1:])
    assert terms.to_pylist() == [b"an", b"odd", b"b", "\u00c9".encode(), "\u00e9".encode(), b"\x1c", b"a"] and lens.tolist() == [4, 0, 0, 2, 2] and n.tolist() == [2, 1, 1, 1, 1, 1, 1]


def test_shards_are_read_once_for_several_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 3} c{i}") for i in range(60)], "doc_id long, text string")
    read, own = [], ts.hits
    monkeypatch.setattr(ts, "hits", lambda *x: read.append(1) or own(*x))
    once = sorted(map(tuple, ts.top_k(docs, docs.filter("doc_id < 12"), 3).collect()))
    waves, read[:] = len(read), []
    assert sorted(map(tuple, ts.top_k(docs, docs.filter("doc_id < 12"), 3, queries_at_once=4).collect())) == once
    assert len(once) == 36 and len(read) == waves
