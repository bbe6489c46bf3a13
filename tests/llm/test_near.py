"""Near-duplicate groups that only single links hold together."""

import random
from collections import Counter

import corpus_pipeline
from picmeta.llm import lsh_forest


def starred(n, changes):
    """A text of 404 words and n copies, each with some other words: all are near the text, few near each other."""
    rng = random.Random(7)
    hub = [f"w{i}" for i in range(404)]
    rows = [(0, " ".join(hub))]
    for i in range(1, n + 1):
        own = list(hub)
        for at in rng.sample(range(4, 400, 10), changes):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    return rows


def test_star_of_many_copies(spark):
    """Copies at 0.86 to the text and about 0.75 to each other."""
    rows = starred(400, 6) + [(1000 + i, " ".join(f"y{i}_{k}" for k in range(90))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i <= 400 else i for i, _ in rows}


def varied(base, n, at_once, rng, names):
    rows = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(len(base)), at_once):
            own[at] = f"{names}{i}_{at}"
        rows.append(" ".join(own))
    return rows


def test_star_of_4000(spark):
    """A text of 200 words and 4,000 copies with three words changed each; the truth is counted on all pairs with the text."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = list(enumerate([" ".join(base), *varied(base, 4000, 3, rng, "c")]))
    hub = lsh_forest.shingle_sets([rows[0][1].encode()])[0]
    far = [i for i, t in rows for s in lsh_forest.shingle_sets([t.encode()]) if 100 * len(set(hub) & set(s)) < 85 * len(set(hub) | set(s))]
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert not far and set(got.values()) == {0}


def test_chain(spark):
    """600 texts, each near the next one only."""
    words = [f"k{i}" for i in range(600 * 9 + 200)]
    rows = [(i, " ".join(words[9 * i : 9 * i + 200])) for i in range(600)]
    got = {r.component_id for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_unlinked_crowd(spark):
    """500 texts of one pattern at 0.8 to each other, with a link here and there: blocks against blocks, and nothing else is linked."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    texts = varied(base, 500, 5, rng, "d")
    texts += [t + " tail" for t in texts[::50]]
    rows = list(enumerate(texts))
    sets = [set(s.tolist()) for s in lsh_forest.shingle_sets([t.encode() for t in texts])]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: top(i) for i, _ in rows}


def test_one_id_with_two_texts(spark):
    """The text that stands for its own group stays, also where another text has its id."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (9, a), (5, b), (3, b), (None, None), (None, a + " more")]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in lsh_forest.deduplicated(spark.createDataFrame(rows[:4] + rows[4:5], "doc_id long, text string")).collect() if r.text)
    assert got == [(3, b), (5, a)]


def test_blocks_of_a_star(spark, monkeypatch):
    """The same with blocks against blocks, where one large component is dealt over several."""
    monkeypatch.setattr(lsh_forest, "BLOCK", 32)
    rows = starred(200, 6) + [(300 + i, starred(1, 6)[1][1] + f" z{i}") for i in range(100)]
    got = Counter(r.component_id for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {0: 301}


def test_near_stage_at_0_80(spark):
    """Against brute force: pairs at 0.82, which stay at 0.85, and pairs at 0.75."""
    rows = []
    for i in range(60):
        own = [f"v{i}_{k}" for k in range(104)]
        rows.append((2 * i, " ".join(own)))
        for at in (10, 40, 70)[: 2 + i % 2]:
            own[at] = "new"
        rows.append((2 * i + 1, " ".join(own)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    near = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    got = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert len(near) == 30 and sorted(r.doc_id for r in got.collect()) == sorted(set(sets) - near)
    assert lsh_forest.shallow(85) == lsh_forest.SHALLOW and (1 - 0.8 ** lsh_forest.shallow(80)) ** lsh_forest.TREES < lsh_forest.MISS
