"""Language identification by unigrams over all segmentations of the words.

Every language has a probability for each piece of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces (forward
algorithm), a text's the product over its words; words are maximal runs of
letters, lower-cased.

`learn` takes one expectation step: with the vocabulary's own scores, it counts
how often each piece is expected in the training words of each language. Tasks
sum by piece before they send anything (at most pieces x languages numbers a
task), in whole millionths, so that the order of additions doesn't matter.

`predict` scores each distinct word once for all languages. `score` is the
posterior probability of the best language under equal priors; text is tempered
to at most FIRM words' worth of evidence so that it does not saturate.

Null text and text without a letter: `und`, score 0. Rows without a language
teach nothing. With nothing to learn from, all is `und`. Ties go to the language
first in code point order. Repeated rows count as often as they come; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from picmeta.llm.lattice import MARK_BYTES, Lattice, Vocabulary
from picmeta.llm.shared import numbered, raw, remainder, slices, tidy

LETTERS = re.compile(r"[^\W\d_]+")
CHUNK = 5_000  # words in a lattice
HELD = 300_000  # words that a task keeps; a task of 8,000 documents has about that many, and what is dropped is scored again
SLICE = 1 << 20  # bytes of text at once
UNIT = 1_000_000
SMOOTHING = 0.01
FIRM = 50
UNDETERMINED = "und"


def letters(text: bytes | None) -> list[str]:
    found = LETTERS.findall((text or b"").decode("utf-8", "replace").lower())
    return found if any(c.isalpha() for w in found for c in w[:64]) or any(c.isalpha() for w in found for c in w) else []


class Words:
    """Distinct words, and in n how often each comes in each language: a row and a column, so that a word takes no table of its own."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.n = np.zeros((1024, 1), np.int64)

    def add(self, words: list[str], n: np.ndarray, k: int) -> None:
        """Adds n (one for each of the words, which are distinct) in language k."""
        rows = np.array([self.place.setdefault(w, len(self.place)) for w in words], np.int64)
        if len(self.place) > len(self.n) or k >= self.n.shape[1]:
            self.n = grown(self.n, len(self.place), k + 1)
        self.n[rows, k] += n


def grown(table: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """table with zeros behind its rows and columns, at least so many of each; what isn't used yet takes no memory."""
    rows = len(table) if rows <= len(table) else max(rows, 2 * len(table))
    new = np.zeros((rows, max(columns, table.shape[1])), table.dtype)
    new[: len(table), : table.shape[1]] = table
    return new


def marked(words: list[str]) -> list[bytes]:
    return [MARK_BYTES + w.encode("utf-8", "replace") for w in words]


def learn(docs: DataFrame, vocab: Vocabulary) -> tuple[list[str], np.ndarray]:
    """Languages in code point order, and the log probability of each piece (a row; the last for unknown) in each (a column)."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(shared.value)
        prior = np.append(v.scores, v.unknown_score)[:, None]
        langs: dict[str, int] = {}
        words = Words()
        sums: dict[int, np.ndarray] = {}

        def flush() -> None:
            own = list(words.place)
            for at in range(0, len(own), CHUNK):
                part = own[at : at + CHUNK]
                got = Lattice(v, marked(part)).expected(prior, words.n[at : at + len(part), : len(langs)].astype(float))
                for k in range(len(langs)):
                    sums[k] = sums.get(k, 0) + got[:, k]
            words.clear()

        for batch in batches:
            for b in slices(batch, 1, SLICE):
                by: dict[int, list[str]] = {}
                for lang, t in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                    by.setdefault(langs.setdefault(lang, len(langs)), []).extend(letters(t))
                for k, found in by.items():
                    at, distinct = numbered(found)
                    words.add(distinct, np.bincount(at, minlength=len(distinct)), k)
                if len(words.place) > HELD:
                    flush()
        flush()
        for lang, k in langs.items():
            total = np.rint(sums.get(k, np.zeros(len(prior))) * UNIT).astype(np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "piece": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    sent = docs.filter("lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(tidy(run), "lang string, piece int, n long")
    summed = sent.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toLocalIterator()  # pieces x languages at most
    counts: dict[str, np.ndarray] = {}
    for r in summed:
        counts.setdefault(r.lang, np.zeros(len(vocab.scores) + 1))[r.piece] = r.n / UNIT
    langs = sorted(counts)
    p = np.stack([counts[x] + SMOOTHING for x in langs], axis=1) if langs else np.zeros((len(vocab.scores) + 1, 0))
    return langs, np.log(p / p.sum(axis=0))


def predict(docs: DataFrame, vocab: Vocabulary, langs: list[str], logp: np.ndarray, text_in: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words) of each row of docs (doc_id, held_out, text). text_in: the field of doc_id, a struct, that has the text; docs then has none."""
    shared = docs.sparkSession.sparkContext.broadcast((vars(vocab), langs, logp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, langs, logp = shared.value
        v = Vocabulary.of(plain)
        place: dict[str, int] = {}
        known = np.zeros((1024, len(langs)))
        for batch in batches:
            if text_in:  # the text is a field of the row, so that it comes once
                batch = batch.append_column("text", pc.struct_field(batch.column(0), text_in))
            for b in slices(batch, 2, SLICE):
                own = [letters(t) for t in raw(b.column(2))]
                at, distinct = numbered([w for x in own for w in x])
                if len(place) > HELD:
                    place.clear()
                new = [w for w in distinct if w not in place]
                if len(place) + len(new) > len(known):
                    known = grown(known, len(place) + len(new), len(langs))
                for i in range(0, len(new), CHUNK):
                    part = new[i : i + CHUNK]
                    known[len(place) : len(place) + len(part)] = Lattice(v, marked(part)).forward(logp)
                    place.update(zip(part, range(len(place), len(place) + len(part)), strict=True))
                rows = np.array([place[w] for w in distinct], np.int64)[at]
                n = np.array([len(x) for x in own], np.int64)
                doc = np.repeat(np.arange(len(own)), n)
                total = np.stack([np.bincount(doc, known[rows, k], len(own)) for k in range(len(langs))], axis=1) if langs else np.zeros((len(own), 1))
                best = total.argmax(axis=1)
                temper = np.minimum(1, FIRM / np.maximum(n, 1))[:, None]
                score = 1 / np.exp((total - total.max(axis=1, keepdims=True)) * temper).sum(axis=1)
                none = (n == 0) | (not langs)
                names = [UNDETERMINED if x else langs[k] for x, k in zip(none, best, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(n)], names=["doc_id", "held_out", "lang_pred", "score", "n_words"])

    own = docs.select("doc_id", "held_out") if text_in else docs.select("doc_id", "held_out", F.col("text").cast("string"))
    return own.mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, n_words long")


def language_id(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Learns from the rows with a language whose crc32(doc_id) mod 4 is not 2 and predicts all rows."""
    vocab = Vocabulary.load(path)
    langs, logp = learn(docs.filter(remainder("doc_id", 4) != 2), vocab)
    return predict(docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text"), vocab, langs, logp)


def accepted(docs: DataFrame, least: float = 0.5, path: str | None = None) -> DataFrame:
    """The rows of docs, all columns, whose language is determined with a score of `least` or more."""
    vocab = Vocabulary.load(path)
    langs, logp = learn(docs.filter(remainder("doc_id", 4) != 2), vocab)
    row = F.struct(*docs.columns)
    judged = predict(docs.select(row.alias("doc_id"), F.lit(False).alias("held_out")), vocab, langs, logp, "text")
    return judged.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("doc_id.*")
