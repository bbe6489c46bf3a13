"""op3: the base near a half, and the model that is learned from the training rows."""

import math
import zlib

from picmeta.llm import lm_score

HELD = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
TRAIN = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]


def test_base_isn_t_rounded_twice(spark):
    """The exact sum is -170.147499999680; to nine decimals it would be a half, and go down."""
    rows = [(TRAIN[0], "a " * 5 + "b " * 11 + "c"), (HELD[0], "a " * 64 + "b " * 206 + "z " * 54)]
    got = lm_score.base(lm_score.lm_score(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: r.base_thousandths for r in got}[HELD[0]] == -170147


def test_learned_scores_keep_up_with_the_base(spark):
    """On held-out rows too, with words that no training row has; all finite, none above 0. The base gives every such word what it leaves for all of them together, so it adds up to more than one and a distribution over words stays below it; the vocabulary's own scores came to 2.09 times the base here."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(5_000_000 + i, t) for i, t in enumerate((None, "", "▁ \U0001f600", "x" * 9_000, "日本 the"))], "doc_id long, text string")
    got = lm_score.lm_score(docs.unionByName(odd), fitted=True).collect()
    assert len(got) == docs.count() + 5 and all(r.score is not None and math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 5_000_000]
    assert sum(r.score for r in held) >= 1.25 * sum(r.base_score for r in held)


def test_learned_words_add_up(spark):
    """The probabilities of all seen words and the end leave the pieces what Witten and Bell leave; nothing to learn from is no error."""
    rows = [(TRAIN[0], "aa aa b"), (TRAIN[1], "b c"), *((HELD[i], w) for i, w in enumerate(("aa", "b", "c", "")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = [10**r.score for r in lm_score.lm_score(docs, fitted=True).collect() if r.held_out]
    end = min(p, key=lambda x: -x)  # the empty text has only its end
    tokens, v = 7, 4
    assert abs(end - (2 + v / (v + 1)) / (tokens + v)) < 1e-9
    seen = sum(x / end for x in p if x != end)
    assert 5 / (tokens + v) < seen < 1 - end
    none = lm_score.lm_score(spark.createDataFrame([(HELD[0], "a b")], "doc_id long, text string"), fitted=True).first()
    assert math.isfinite(none.score) and none.score < 0
