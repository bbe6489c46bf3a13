"""Operators against brute force on small rows with nulls, empty texts, ties, repeats and extra columns."""

import itertools
import math
import re
import zlib
from collections import Counter

import pytest

from picmeta.llm import language_id, lm_score, lsh_forest, pieces, quality_rules, source_mix, token_rollup
from picmeta.llm import queries as llm
from picmeta.llm.lattice import MARK_BYTES, Lattice, Vocabulary
from picmeta.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_lines string, kept string"
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", " \n\t", "one two", "One two", BASE, BASE.upper(), BASE + " more", BASE.replace("word30", "other"), "▁ x  y\n\n ▁", "日本語 été ñ 😀", "x" * 30_000, "12 34 $$", "the house is red and the sea is blue"]
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], 0, "x", "y", "z") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows + [rows[5], (None, BASE, None, None, None, None, None, None)], SCHEMA).write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/llm_docs")
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_lattice_sums_all_segmentations():
    v = Vocabulary.load()
    score = {p: s for p, s, i in zip(v.pieces, v.scores, range(len(v.pieces))) if i not in set(v.bytes_at.tolist()) | {0, 1, 2}}
    for w in ("the", "house", "été"):
        text = MARK_BYTES + w.encode()
        cuts = [k for k in range(1, len(text)) if text[k] & 0xC0 != 0x80]
        total, best = 0.0, -math.inf
        for n in range(len(cuts) + 1):
            for c in itertools.combinations(cuts, n):
                parts = [text[a:b] for a, b in zip((0, *c), (*c, len(text)))]
                if all(p in score for p in parts):
                    s = sum(score[p] for p in parts)
                    total, best = total + math.exp(s), max(best, s)
        import numpy as np

        lattice = Lattice(v, [text])
        assert math.isclose(lattice.forward(np.append(v.scores, v.unknown_score)[:, None])[0, 0], math.log(total), rel_tol=1e-9)
        ids, _ = lattice.viterbi(v)
        assert math.isclose(sum(v.scores[ids]), best, rel_tol=1e-9)


def test_pieces_round_trip(docs, none):
    got = pieces.decode(pieces.encode(docs)).collect()
    assert len(got) == docs.count() and all(r.text == r.decoded for r in got)
    assert pieces.decode(pieces.encode(none)).count() == 0


def test_lm_base(docs, none):
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, ws in rows if not held[i] for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    want = Counter((i, held[i], len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None]), 6)) for i, ws in rows)
    for heavy in (lm_score.HEAVY, 1):  # all words broadcast, and all joined
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_score.lm_score(docs, heavy=heavy).collect()) == want
    assert lm_score.lm_score(none).count() == 0
    every = [sorted((str(r.doc_id), round(r.score, 6)) for r in lm_score.lm_score(docs, heavy=heavy).collect()) for heavy in (lm_score.HEAVY, 1)]
    assert every[0] == every[1] and all(math.isfinite(x) and x <= 0 for _, x in every[0])


def test_language_id(spark, none, docs):
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[12].lang_pred == "und" and got[0].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and language_id.language_id(none).count() == 0
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lang = {r.doc_id: r.lang for r in sample.collect()}
    held = [r for r in language_id.language_id(sample).collect() if r.held_out and r.lang_pred != "und"]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def linked(rows):
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}) for i, w in rows]
    low = lambda i: -1 if i is None else i
    comp = [low(i) for i, _ in sets]
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(sets)), 2):
            x, y = sets[a][1], sets[b][1]
            if x and y and comp[a] != comp[b] and 100 * len(x & y) >= 85 * len(x | y):
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return Counter((low(i), len(s), c) for (i, s), c in zip(sets, comp))


def test_near_duplicates(spark, docs, none):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (docs, sample):
        got = lsh_forest.near_duplicates(df).collect()
        low = lambda i: -1 if i is None else i
        assert Counter((low(r.doc_id), r.n_shingles, low(r.component_id)) for r in got) == linked([(r.doc_id, words(r.text)) for r in df.collect()])
    assert lsh_forest.near_duplicates(none).count() == 0


def test_line_dedup_both_ways(spark, docs):
    """Joined instead of broadcast, and with filters so full that most lines are suspects: the same rows."""
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    line = "a line of more than twenty characters"
    odd = spark.createDataFrame([(None, f"{line}\nx"), (None, f"y\n{line}"), (7, line), (8, f" {line.upper()}\t"), (8, "z")], "doc_id long, text string")
    for df in (sample.select("doc_id", "text"), odd):
        got = [sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(df, **o).collect()) for o in ({}, {"broadcast_keys": -1}, {"bits": 4096}, {"broadcast_keys": -1, "bits": 4096})]
        assert all(g == got[0] for g in got)
    assert sum(r[2] for r in got[0]) == 3  # null, 7 and 8 hold it; 8 keeps it


def test_other_operators_on_odd_rows(docs, none):
    n = docs.count()
    assert quality_rules.quality_rules(docs).count() == n and line_dedup(docs).count() == n and source_mix.mixture(docs).count() == n
    for f in (quality_rules.quality_rules, line_dedup, source_mix.mixture):
        assert f(none).count() == 0


def test_rollup(spark, docs, none, tmp_path, monkeypatch):
    """Against a recount of the documents that are left, with a retry, a lost job, two writers of one number, and a revision."""
    ids = {r.doc_id: r.n_pieces for r in pieces.round_trips(docs).collect()}
    rows, root = token_rollup.counted(docs).cache(), f"file://{tmp_path}/rollup"

    def want(keep, more=0, version=token_rollup.VERSION):
        found = Counter()
        for r in docs.collect():
            if keep(r):
                found[r.source, r.lang, version, "docs"] += 1
                found[r.source, r.lang, version, "tokens"] += max(ids[r.doc_id], 0) + more
        return found

    def have():
        return Counter({(r.source, r.lang, r.version, x): r[x] for r in token_rollup.totals(spark, root).collect() for x in ("docs", "tokens")})

    assert token_rollup.totals(spark, root).count() == 0 and token_rollup.counted(none).count() == 0
    assert token_rollup.commit(token_rollup.changes(None, rows), root, "1")
    assert have() == want(lambda r: True)
    gone = token_rollup.changes(rows.filter("source = 'a'"), None)
    with monkeypatch.context() as m:
        m.setattr(token_rollup, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            token_rollup.commit(gone, root, "2")
    assert have() == want(lambda r: True)
    assert [token_rollup.commit(gone, root, "2") for _ in range(2)] == [True, False]
    assert have() == want(lambda r: r.source != "a")
    publish = token_rollup.publish

    def raced(spark, root, number, batch, state):  # another writer takes the same number first
        if batch == "3" and number == 3:
            token_rollup.totals(spark, root).write.parquet(f"{root}/state/000000000003-0")
            publish(spark, root, 3, "other", "000000000003-0")
        return publish(spark, root, number, batch, state)

    with monkeypatch.context() as m:
        m.setattr(token_rollup, "publish", raced)
        new = rows.filter("source = 'b'").withColumn("n_tokens", rows.n_tokens + 5)
        assert token_rollup.commit(token_rollup.changes(rows.filter("source = 'b'"), new), root, "3")
    assert have() == want(lambda r: r.source is None) + want(lambda r: r.source == "b", 5)
    assert {r.batch for r in token_rollup.log(spark, root).collect()} == {"1", "2", "other", "3"}
    assert token_rollup.commit(token_rollup.changes(token_rollup.counted(none), None), root, "4") and have() == want(lambda r: r.source is None) + want(lambda r: r.source == "b", 5)


def test_fences_of_a_group_with_junk(spark):
    """A fifth of a group is junk: junk goes, clean texts stay, also in a group of three texts; repeats are counted as by hand."""
    clean = [" ".join(f"word{(i * 7 + k * k) % 997}" for k in range(80)) for i in range(200)]
    junk = [" ".join(f"word{(i * 5 + k) % 991}%%%&&" for k in range(80)) for i in range(50)]
    rows = [(i, t, "en", "a") for i, t in enumerate(clean)] + [(1000 + i, t, "en", "a") for i, t in enumerate(junk)] + [(2000, clean[0], "en", "b"), (2001, junk[0], "en", "b"), (2002, clean[1], None, None), (2003, None, "en", "a")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {i: t is not None and "%" not in t for i, t, *_ in rows}
    for t in [b"a b c a b c", b"a a a a", b"a b", b"x y z x y w z", b"a b c d a b c d a b c"]:
        w = t.split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert quality_rules.repeated_words(w) == len({k for i, x in enumerate(windows) if windows.count(x) > 1 for k in (i, i + 1, i + 2)})


def test_oracles(spark):
    import duckdb

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    for name, sql in llm.oracle_sql().items():
        got, want = llm.queries()[name](spark, sf), c.sql(sql)
        cols = sorted(got.columns)
        rows = sorted(str(tuple(r[k] for k in cols)) for r in got.collect())
        assert cols == sorted(want.columns) and rows == sorted(map(str, want.project(", ".join(cols)).fetchall())), name
