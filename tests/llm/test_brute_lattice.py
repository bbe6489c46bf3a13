"""Pieces, language-model scores and languages against plain recursions over characters."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from picmeta.llm import language_id, lm_score, pieces
from picmeta.llm import queries as llm
from picmeta.llm.lattice import Vocabulary

MARK, OWN = "▁", ""  # OWN stands for a marker of the text itself


@pytest.fixture(scope="module")
def vocab():
    v = Vocabulary.load()
    special = {0, 1, 2, *v.bytes_at.tolist()}
    ids = {p.decode(): i for i, p in enumerate(v.pieces) if i not in special}
    return v, ids, max(map(len, ids))


def arcs(text, vocab):
    """(start, stop, id) of all pieces; -1 for a character that is no piece."""
    _, ids, longest = vocab
    out = []
    for i in range(len(text)):
        out += [(i, j, ids[text[i:j]]) for j in range(i + 1, min(len(text), i + longest) + 1) if text[i:j] in ids]
        if text[i] not in ids:
            out.append((i, i + 1, -1))
    return out


def viterbi(text, vocab):
    v = vocab[0]
    best = {0: (0.0, [])}
    for i, j, k in sorted(arcs(text, vocab), key=lambda a: a[1]):
        score = best[i][0] + (v.unknown_score if k < 0 else v.scores[k])
        own = [v.bytes_at[b] for b in text[i].replace(OWN, MARK).encode()] if k < 0 else [k]
        if j not in best or score > best[j][0] + 1e-12:
            best[j] = (score, best[i][1] + own)
    return best[len(text)]


def summed(text, vocab, logp):
    """log10 of the sum over all segmentations, in plain probabilities scaled at each place."""
    total = defaultdict(lambda: -math.inf)
    total[0] = 0.0
    for i, j, k in sorted(arcs(text, vocab), key=lambda a: (a[1], a[0])):
        x, y = total[j], total[i] + logp[k]
        hi, lo = max(x, y), min(x, y)
        total[j] = hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))
    return total[len(text)]


ODD = ["the house is red", "  two  spaces\nand a line\n", "▁ own ▁▁ marker", "日本語 été ñ 😀 \x00\x7f", "x" * 300, "\t\r\n", "a", " ", "ﬁ Å ́combining", "1234567890 3.14159", "don't stop—never; ever…"]


def test_ids_against_plain_viterbi(spark, vocab):
    texts = ODD + [r.text[:400] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect() if r.text]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.round_trips(df).collect()}
    v = vocab[0]
    for i, t in enumerate(texts):
        score, ids = viterbi(MARK + t.replace(MARK, OWN).replace(" ", MARK), vocab)
        tied = got[i].ids != ids  # of segmentations with equal scores, any
        assert not tied or len(got[i].ids) == len(ids) and v.scores[got[i].ids].sum() == pytest.approx(v.scores[ids].sum(), rel=1e-12)
        assert not tied or len(set(t)) == 1 or i >= len(ODD)
        assert got[i].n_pieces == len(ids) and got[i].round_trip
    assert got[len(texts)].ids is None and got[len(texts)].n_pieces == -1 and got[len(texts) + 1].ids == []
    both = pieces.decode(pieces.encode(df))
    assert all(r.ids == got[r.doc_id].ids and r.decoded == r.text for r in both.collect())


def test_scores_against_all_segmentations(spark, vocab):
    v = vocab[0]
    rows = [(i, t) for i, t in enumerate([*ODD, None, ""])] + [(100 + i, r.text[:300]) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()) if r.text]
    logp = [*v.scores, v.unknown_score]
    df = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, word string, score double").repartition(3)
    for heavy in (lm_score.HEAVY, 1):
        got = {r.doc_id: r.score for r in lm_score.lm_score(df, heavy=heavy).collect()}
        for i, t in rows:
            words = [w.decode().lower() if w.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), w.decode()) for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())]
            want = sum(summed(MARK + w.replace(MARK, OWN), vocab, logp) for w in words) / math.log(10)
            if MARK not in (t or ""):
                assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_languages_against_expected_counts(spark, vocab):
    """One expectation step and the posterior, from plain recursions."""
    v = vocab[0]
    sample = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text][:30]
    rows = [(r.doc_id, r.text[:250], r.lang) for r in sample] + [(9000, None, "en"), (9001, "12 !", "en"), (9002, "plain words", None)]
    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    prior = [*v.scores, v.unknown_score]
    counts = defaultdict(lambda: defaultdict(float))
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            for w, n in Counter(language_id.letters((t or "").encode())).items():
                text = MARK + w
                all_, fore, back = arcs(text, vocab), defaultdict(float), defaultdict(float)
                fore[0] = back[len(text)] = 1.0
                for a, b, k in sorted(all_, key=lambda x: x[1]):
                    fore[b] += fore[a] * math.exp(prior[k])
                for a, b, k in sorted(all_, key=lambda x: -x[0]):
                    back[a] += back[b] * math.exp(prior[k])
                for a, b, k in all_:
                    counts[lang][k] += n * fore[a] * math.exp(prior[k]) * back[b] / fore[len(text)]
    logp = {}
    for lang, c in counts.items():
        p = [language_id.SMOOTHING] * (len(v.scores) + 1)
        for k, x in c.items():
            p[k] += x
        logp[lang] = [math.log(x / sum(p)) for x in p]
    for i, t, _ in rows:
        ws = language_id.letters((t or "").encode())
        if not ws:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        total = {x: sum(summed(MARK + w, vocab, logp[x]) for w in ws) for x in logp}
        best = max(sorted(total), key=total.get)
        temper = min(1, language_id.FIRM / len(ws))
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(math.exp((x - total[best]) * temper) for x in total.values()), rel=1e-3)


def test_end_tokens_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.lm_score(none).count() == pieces.round_trips(none).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_score.lm_score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score < 0
    assert set(llm.oracle_sql()) <= set(llm.queries())


def test_words_by_language_take_no_table_each():
    """Counts by word and language, languages and words coming in any order; 100,000 words took 20 MB and more in tables of their own."""
    import tracemalloc

    own, want = language_id.Words(), Counter()
    for k, words in ((0, ["a", "b"]), (3, ["b", "c"]), (1, []), (0, ["c", "b"]), (2, ["d"])):
        own.add(words, np.arange(1, len(words) + 1), k)
        want.update({(w, k): n for n, w in enumerate(words, 1)})
    assert {(w, k): int(n) for w, row in own.place.items() for k, n in enumerate(own.n[row]) if n} == dict(want)
    words, one = [f"word{i}" for i in range(100_000)], np.ones(100_000, np.int64)
    tracemalloc.start()
    own.clear()
    own.add(words, one, 0)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(own.place) == 100_000 and own.n[:100_000].sum() == 100_000 and held < 16e6
