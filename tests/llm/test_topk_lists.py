"""A shard's longer lists are read only for documents that can still reach the threshold."""

import numpy as np
import pyarrow as pa
import pytest

from picmeta.llm import topk_search as ts


def test_long_lists_stay_closed():
    rng = np.random.default_rng(3)
    texts = [[b"w%d" % x for x in rng.integers(0, 9, 12)] for _ in range(1024)]
    for i in range(1024):
        texts[i] += [b"long"] * (i % 20 == 0) + [b"short"] * (i % 128 == 0)
    s = ts.inverted([(list(range(1024)), ts.counted([b" ".join(t) for t in texts]))])
    shard = ts.Shard(s | {"terms": pa.array(s["terms"]), "ids": np.array(s["ids"])}, pa.array([b"long", b"short"]), 12.1)
    score = np.zeros(1024)
    for x, w in ((0, 1.0), (1, 3.0)):
        own = slice(shard.begin[shard.local[x]], shard.begin[shard.local[x]] + shard.size[shard.local[x]])
        score[shard.at[own]] += w * shard.imp[own]
    order = np.lexsort((shard.ids, -np.round(score, 9)))[:3]
    floors = np.array([0.0, score[order[2]], 100.0])
    ask = (np.array([0, 1] * 3), np.array([1.0, 3.0] * 3), np.array([0, 2, 4, 6]), floors)
    got = {q: (place.tolist(), found.tolist()) for q, place, found in shard.searches(*ask, 3)}
    assert got.keys() == {0, 1}
    for q in (0, 1):
        assert got[q][0] == order.tolist() and got[q][1] == pytest.approx(score[order].tolist())
    every, short, both = 52 + 8, 8, sum(i % 20 == 0 for i in range(0, 1024, 128))
    assert shard.held == 3 * every and shard.read <= every + short + both  # nothing for the third query
