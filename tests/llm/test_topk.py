"""Top-k hits against BM25 of every query and document."""

import math
import random
import re
from collections import Counter

import pytest

from picmeta.llm import topk_search

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def brute(docs, queries, k):
    own = [(i, Counter(words(t))) for i, t in docs]
    df, n = Counter(w for _, c in own for w in c), len(own)
    mean = sum(sum(c.values()) for _, c in own) / n
    out = []
    for qid, text in queries:
        q, found = Counter(words(text)), []
        for i, c in own:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            score = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w, m in q.items() if w in c)
            if score:
                found.append((-round(score, 7), -1 if i is None else i))
        out += [(-1 if qid is None else qid, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocab, [1 / (x + 1) for x in range(400)], k=rng.choice((3, 40, 200))))) for i in range(1, 900)]
    rows += [(None, "w1 W2"), (900, None), (901, ""), (902, "x" * 9_000), (903, rows[5][1]), (904, rows[5][1]), rows[5]]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, score string")
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/topk_docs")
    docs = spark.read.parquet(path)
    asked = [r for r in rows if r[0] is None or r[0] % 100 == 0 or r[0] == 902] + [rows[5]]
    queries = spark.createDataFrame(asked, "doc_id long, text string")
    for at_once in (4096, 3):
        got = topk_search.top_k(docs, queries, queries_at_once=at_once).collect()
        have = sorted((-1 if r.query_id is None else r.query_id, r["rank"], -1 if r.doc_id is None else r.doc_id, round(r.score, 7)) for r in got)
        want = brute(rows, asked, 10)
        assert [x[:2] for x in have] == [x[:2] for x in want]
        assert [x[3] for x in have] == pytest.approx([x[3] for x in want], abs=1e-6)
        assert sum(a[2] != b[2] for a, b in zip(have, want)) == 0
    none = spark.createDataFrame([], "doc_id long, text string")
    assert topk_search.top_k(none, none).count() == topk_search.top_k(docs, none).count() == topk_search.top_k(none, queries).count() == 0
