"""Language-model scores: the marginal probability of a text over a subword lattice.

The scores of a unigram vocabulary weigh every segmentation of every word; the
log-space forward recursion sums them. A text's log10 probability is the sum over
its words (no piece spans two). Beside it stands the base: add-one word unigrams
of the training rows. Text is lower-cased (A-Z) and cut at ASCII white space; for
the base, an end follows each text.

`lm_score` alone takes the public vocabulary's own scores, so it knows nothing of
the corpus. With `fitted` the scores are learned from the training rows:

* `learned` counts, by expectation over all segmentations, how often each piece
  stands in a distinct training word. Pieces that begin a word share one, the
  others and a word's end share another distribution, so that what the forward
  recursion gives the words adds up to no more than one.
* A training word is one more arc over its lattice, the whole word, with
  c / (N + V); V / (N + V) is left for the pieces. So words that were seen are
  told by their counts, others by what they are made of (Witten and Bell).
* The text's end is a token as for the base.

1. `word_counts`: tasks count their words, in training rows and in all, and Spark
   sums by word. So each distinct word is segmented once, by `scored`.
2. Words with at least 1 / HEAVY of all tokens are at most HEAVY in number; they
   are broadcast, with count and score, and looked up where the text is read.
3. The other words go out as one row per text and distinct word, are joined with
   the words' table and summed by text. Each text also sends one row of its own
   sums; its key begins with a space, as no word does, so it matches nothing and
   such rows are dealt evenly.

Null text counts as empty: one token, its end; its score is 0. A null doc_id
hashes as the empty text. Repeated rows are texts of their own. Without training
rows N and V are 0. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from picmeta.llm.lattice import MARK_BYTES, Lattice, Vocabulary
from picmeta.llm.shared import cut, numbered, raw, remainder, slices

HEAVY = 100_000
HELD = 100_000
CHUNK = 1 << 17  # bytes in a lattice
SLICE = 1 << 20
LN10 = math.log(10)
UNIT = 1_000_000
SMOOTHING = 0.01


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): the count of each word of docs (train, text) in training rows and in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}  # n, and c above the 32nd bit

        def out() -> pa.RecordBatch:
            both = np.array(list(counts.values()), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(both >> 32), pa.array(both & 0xFFFFFFFF)], names=["word", "c", "n"])

        for batch in batches:
            for b in slices(batch, 1, SLICE):
                own = [(t or b"").lower().split() for t in raw(b.column(1))]
                at, distinct = numbered([w for x in own for w in x])
                train = np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(bool), [len(x) for x in own])
                both = np.bincount(at, minlength=len(distinct)) + (np.bincount(at[train], minlength=len(distinct)) << 32)
                for w, n in zip(distinct, both.tolist(), strict=True):
                    counts[w] = counts.get(w, 0) + n
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select("train", F.col("text").cast("string")).mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def learned(counts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """The log probability of each piece, the last for unknown, in the distinct words with c > 0 of counts (word, c, n); that of a word's end is part of the pieces that begin one."""
    shared = counts.sparkSession.sparkContext.broadcast(vars(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(shared.value)
        prior = np.append(v.scores, v.unknown_score)[:, None]
        total = np.zeros(len(prior) + 1)  # the last: words
        for b in batches:
            for part in slices(b, 0, CHUNK):
                words = [MARK_BYTES + w for w in raw(part.column(0))]
                total[:-1] += Lattice(v, words).expected(prior, np.ones((len(words), 1)))[:, 0]
                total[-1] += len(words)
        whole = np.rint(total * UNIT).astype(np.int64)  # so that the order of additions doesn't matter
        at = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(whole[at])], names=["piece", "n"])

    sent = counts.filter("c > 0").select("word").mapInArrow(run, "piece int, n long")
    n = np.zeros(len(vocab.scores) + 2)
    for r in sent.groupBy("piece").agg(F.sum("n").alias("n")).toLocalIterator():  # pieces at most
        n[r.piece] = r.n / UNIT
    ordinary = np.append(np.isin(np.arange(len(vocab.scores)), vocab.value[vocab.value >= 0]), True)
    begins = np.array([*(p.startswith(MARK_BYTES) for p in vocab.pieces), False])
    p, words = n[:-1] + SMOOTHING, n[-1] + SMOOTHING
    inside = p[ordinary & ~begins].sum() + words
    logp = np.where(begins, np.log(p / p[ordinary & begins].sum()) + np.log(words / inside), np.log(p / inside))
    logp[-1] -= math.log(0x110000)  # whichever character it is
    return logp


def scored(counts: DataFrame, vocab: Vocabulary, mixed: tuple[np.ndarray, int, int] | None = None) -> DataFrame:
    """counts (word, c, n) with sub: the log10 of the summed probability of the word's segmentations. mixed: the log probabilities of pieces, the number of training tokens and of distinct ones; the whole word is then an arc too."""
    shared = counts.sparkSession.sparkContext.broadcast((vars(vocab), mixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, mixed = shared.value
        v = Vocabulary.of(plain)
        logp = (np.append(v.scores, v.unknown_score) if mixed is None else mixed[0])[:, None]
        for b in batches:
            for part in slices(b, 0, CHUNK):
                sub = Lattice(v, [MARK_BYTES + w for w in raw(part.column(0))]).forward(logp)[:, 0] / LN10
                if mixed is not None:
                    _, tokens, left = mixed
                    c = part.column(1).to_numpy().astype(float)
                    seen = np.log(c, out=np.full(len(c), -np.inf), where=c > 0)
                    sub = (np.logaddexp(seen, sub * LN10 + math.log(left * left / (left + 1))) - math.log(tokens + left)) / LN10
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sub)], names=["word", "c", "n", "sub"])

    return counts.mapInArrow(run, "word binary, c long, n long, sub double")


def lm_score(docs: DataFrame, path: str | None = None, heavy: int = HEAVY, fitted: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, base_thousandths) of each row of docs. fitted: the model's scores are learned from the training rows and its text has an end."""
    spark = docs.sparkSession
    flagged = docs.select((remainder("doc_id", 7) != 2).alias("train"), "text")
    counts, vocab = cut(word_counts(flagged)), Vocabulary.load(path)
    words, every, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = flagged.filter("train").count()
    tokens, v = words + ends, distinct + (ends > 0)
    left = max(v, 1)  # what is kept for the pieces, in tokens; one part of left + 1 of it for the end
    table = cut(scored(counts, vocab, (learned(counts, vocab), tokens, left) if fitted else None))
    last = math.log10((ends + left / (left + 1)) / (tokens + left)) if fitted else 0.0
    frequent = F.col("n") * heavy >= every
    common_words = spark.sparkContext.broadcast({bytes(r.word): (r.c, r.sub) for r in table.filter(frequent).toLocalIterator()})  # HEAVY at most
    less = math.log10(tokens + v + 1)
    ended = math.log10(ends + 1) - less

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, none = common_words.value, (-1, 0.0)
        for batch in batches:
            for b in slices(batch, 3, SLICE):
                own = [(t or b"").lower().split() for t in raw(b.column(3))]
                m, n = len(own), np.array([len(x) for x in own], np.int64)
                at, distinct = numbered([w for x in own for w in x])
                c, sub = (np.array(x) for x in zip(*[common.get(w, none) for w in distinct] or [none]))
                doc, c, sub = np.repeat(np.arange(m), n), c[at] if len(at) else at, sub[at] if len(at) else at
                sums, score = (np.bincount(doc, x, m).astype(float) for x in (np.log10(np.maximum(c, 0) + 1.0), sub))  # of no words at all it makes integers
                hits = np.bincount(doc, c > 0, m).astype(np.int64)
                rare, size = np.flatnonzero(c < 0), max(len(distinct), 1)
                pair, k = np.unique(doc[rare] * size + at[rare], return_counts=True)
                head = pa.StructArray.from_arrays([b.column(1), b.column(2), pa.array(n + 1), pa.array(hits), pa.array(sums), pa.array(score)], names=HEAD)
                uid = b.column(0)
                keys = pa.array([b" %d" % u for u in uid.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([uid, keys, pa.array(np.zeros(m, np.int64)), head], names=["uid", "word", "k", "head"])
                yield pa.RecordBatch.from_arrays([uid.take(pa.array(pair // size)), pa.array(distinct, pa.binary()).take(pa.array(pair % size)), pa.array(k.astype(np.int64)), pa.nulls(len(pair), head.type)], names=["uid", "word", "k", "head"])

    HEAD = ["doc_id", "held_out", "n_tokens", "hits", "sums", "score"]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), (remainder("doc_id", 7) == 2).alias("held_out"), F.col("text").cast("string"))
    sent = rows.mapInArrow(run, "uid long, word binary, k long, head struct<doc_id:long,held_out:boolean,n_tokens:long,hits:long,sums:double,score:double>")
    found = sent.join(table.filter(~frequent).select("word", "c", "sub"), "word", "left").groupBy("uid").agg(
        *(F.max(f"head.{x}").alias(x) for x in HEAD),
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"),
        F.sum(F.coalesce(F.col("k") * F.log10(F.col("c") + 1), F.lit(0.0))).alias("add"),
        F.sum(F.coalesce(F.col("k") * F.col("sub"), F.lit(0.0))).alias("sub"),
    )
    base = F.col("sums") + F.col("add") - (F.col("n_tokens") - 1) * less + ended
    return found.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hits") + F.col("more") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.round(base, 9).alias("base_score"),  # sums add in any order
        F.round(F.col("score") + F.col("sub") + last, 9).alias("score"),
        F.round(base * 1000).cast("long").alias("base_thousandths"),  # of the sum itself: rounding it to 9 decimals first can carry it over a half
    )


def base(scores: DataFrame) -> DataFrame:
    """What SQL can express of the scores; base_score in whole thousandths."""
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_thousandths")


#: held_out needs crc32, which DuckDB lacks; it is made here from a table of bytes by bitwise steps.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(coalesce(doc_id::VARCHAR, '')) + 1), lambda i: ascii(substr(coalesce(doc_id::VARCHAR, ''), i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws, xor({_CRC}, 4294967295) % 7 = 2 AS held_out FROM documents),
w AS (SELECT rid, held_out, unnest(list_append(ws, ' ')) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w),
t AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT any_value(doc_id) AS doc_id, any_value(d.held_out) AS held_out, count(*)::BIGINT AS n_tokens, count(c.c)::BIGINT AS n_known, any_value(t.n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (t.n + t.v + 1))) * 1000)::BIGINT AS base_thousandths
FROM d JOIN w USING (rid) LEFT JOIN c USING (w) CROSS JOIN t GROUP BY rid"""
