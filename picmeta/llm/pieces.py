"""SentencePiece encoding and decoding with a unigram model.

`encode` finds the best segmentation (Viterbi over the arcs that a double-array
trie of pieces gives, by their log scores), `decode` undoes it. As in
SentencePiece, a space is written as the marker and one is put before the text;
characters that no piece covers become the pieces of their UTF-8 bytes. A marker
character of the text itself is written as bytes too, so that every text comes
back unchanged.

No piece of the vocabulary has a marker behind another character, or a line
end, so the text is cut there and each distinct part is segmented once.

Null text: null ids. Empty text: no ids. Repeated rows are encoded each; an
empty table gives an empty result. Other columns pass through, but for one named
ids (or decoded), which the result replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from picmeta.llm.lattice import MARK, MARK_BYTES, Lattice, Vocabulary
from picmeta.llm.shared import numbered, raw, slices, tidy

PARTS = re.compile(rf" +[^ \n{MARK}]*|[^ \n{MARK}]+|\n|{MARK}")
CHUNK = 10_000  # parts in a lattice
HELD = 50_000  # parts that a task remembers
SLICE = 1 << 20  # bytes of text at once


class Encoder:
    """Ids of texts; remembers the parts it has segmented."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.begin, self.n = [np.empty(0, np.int32)], [], []
        self.flat = np.empty(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        total = len(self.flat)
        grown = [self.flat]
        for i in range(0, len(new), CHUNK):
            part = new[i : i + CHUNK]
            ids, off = Lattice(self.vocab, [w.encode("utf-8", "replace").replace(b" ", MARK_BYTES) for w in part]).viterbi(self.vocab)
            grown.append(ids)
            self.begin += (off[:-1] + total).tolist()
            self.n += np.diff(off).tolist()
            total += len(ids)
            self.place.update(zip(part, range(len(self.place), len(self.place) + len(part)), strict=True))
        if MARK in new:
            at = self.place[MARK]
            grown.append(self.vocab.bytes_at[list(MARK_BYTES)].astype(np.int32))
            self.begin[at], self.n[at] = total, len(MARK_BYTES)
        self.flat = np.concatenate(grown)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end to end, and the offsets of the texts."""
        own = [PARTS.findall(" " + t.decode("utf-8", "replace")) if t else [] for t in texts]
        at, distinct = numbered([w for x in own for w in x])
        if len(self.place) > HELD:
            self.forget()
        self._learn([w for w in distinct if w not in self.place])
        rows = np.array([self.place[w] for w in distinct], np.int64)[at]
        begin, n = np.array(self.begin, np.int64), np.array(self.n, np.int64)
        lens = n[rows] if len(rows) else np.empty(0, np.int64)
        first = np.cumsum(lens) - lens
        ids = self.flat[np.repeat(begin[rows] - first, lens) + np.arange(lens.sum())] if len(rows) else np.empty(0, np.int32)
        sums = np.concatenate([[0], np.cumsum(lens)])
        return ids, sums[np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)]


def written(vocab: Vocabulary) -> list[bytes]:
    """What each id stands for."""
    out = [p.replace(MARK_BYTES, b" ") for p in vocab.pieces]
    for b, i in enumerate(vocab.bytes_at):
        out[i] = bytes([b])
    return out


def encode(docs: DataFrame, path: str | None = None, scores: str = "zipf") -> DataFrame:
    """All columns of docs, then ids (a clashing column is replaced)."""
    docs = docs.drop("ids")
    shared = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary.load(path, scores)))
    schema = StructType(list(docs.schema.fields)).add("ids", ArrayType(IntegerType()))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.of(shared.value))
        for batch in batches:
            for b in slices(batch, at, SLICE):
                texts = raw(b.column(at))
                ids, off = encoder(texts)
                mask = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()), mask=mask)
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def decoded(said: list[bytes], ids: list[int]) -> bytes:
    return b"".join([said[k] for k in ids]).removeprefix(b" ")


def round_trips(docs: DataFrame, path: str | None = None, scores: str = "zipf", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(the columns keep, ids, n_pieces, round_trip) of each row of docs: encoded, decoded and compared with the text in one pass. For null text: null ids, -1 pieces, true."""
    own = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = StructType(list(own.schema.fields)[:-1]).add("ids", ArrayType(IntegerType())).add("n_pieces", "long").add("round_trip", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary.load(path, scores)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, said = Encoder(Vocabulary.of(shared.value)), written(Vocabulary.of(shared.value))
        for batch in batches:
            for b in slices(batch, len(keep), SLICE):
                texts = raw(b.column(len(keep)))
                ids, off = encoder(texts)
                same = [t is None or decoded(said, ids[i:j].tolist()) == t for t, i, j in zip(texts, off[:-1], off[1:], strict=True)]
                none = pa.array([t is None for t in texts])
                n = np.where(none.to_numpy(zero_copy_only=False), -1, np.diff(off))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()), mask=none), pa.array(n.astype(np.int64)), pa.array(same, pa.bool_())], names=schema.names)

    return own.mapInArrow(tidy(run), schema)


def lengths(docs: DataFrame, path: str | None = None, scores: str = "zipf", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(the columns keep, n_tokens) of each row of docs; 0 for null text. The ids stay in the task."""
    own = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = StructType(list(own.schema.fields)[:-1]).add("n_tokens", "long")
    shared = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary.load(path, scores)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.of(shared.value))
        for batch in batches:
            for b in slices(batch, len(keep), SLICE):
                _, off = encoder(raw(b.column(len(keep))))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.diff(off).astype(np.int64))], names=schema.names)

    return own.mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of encoded, then decoded: the text of ids (null for null; ids outside the vocabulary are an error)."""
    encoded = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(written(Vocabulary.load(path)))
    schema = StructType(list(encoded.schema.fields)).add("decoded", "string")
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [None if x is None else decoded(said, x).decode("utf-8", "replace") for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(tidy(run), schema)
