"""Line dedup with two Bloom filters.

Lines that many documents share (menus, notices, boilerplate) are cut out of
all but one of them. Only lines that can be repeats are ever shuffled:

1. `filters`: each task hashes the keys of its lines, once per document, to
   HASHES bit positions, and emits the positions hit once and those hit twice,
   cut into segments of SEGMENT bits. Merging adds the hits: a position that two
   tasks hit is a position of the second filter. `sized` gives the filters
   BITS_A_LINE bits for each line counted, from LEAST_BITS to MOST_BITS; so a
   segment holds about as much whatever the input, up to 2^26 lines. Beyond that
   the filters fill up and more lines count as suspects. Only the second, the
   twice-seen filter, is broadcast (MOST_BITS / 8 bytes at most). It has no false
   negatives: a key in two documents hits its positions twice.
2. `suspects`: lines whose positions are all in the twice-seen filter go, as
   (key digest, doc_id), through an exact count of distinct documents.
3. keys in at least MIN_DOCS documents are repeats; the largest doc_id that has
   one keeps it. While there are at most BROADCAST_KEYS of them they are
   broadcast (40 bytes each) and applied where the text is read. Beyond it, the
   lines to drop are grouped by document and joined with the documents.

A key is the line stripped of ASCII white space at both ends with A-Z
lower-cased; keys under MIN_CHARS code points never count. Keys are compared by
128-bit digests.

Null text is one empty line; its result text is empty. Rows with a null doc_id
count as one document that sorts below all ids. Rows that repeat a doc_id count
as one document and each keep or lose the same lines. An empty table gives an
empty result. Other columns pass through, but for those named n_lines, n_dropped
and kept_text, which the result replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from picmeta.llm.shared import SPACE, cut, raw, tidy

MIN_CHARS = 20
MIN_DOCS = 3
BITS_A_LINE = 16
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 30
HASHES = 2
SEGMENT = 1 << 20
BROADCAST_KEYS = 1 << 18

STRIP = SPACE.encode()


def line_key(line: bytes) -> bytes | None:
    """The 128-bit digest of a line's key; None if the key is too short to count."""
    key = line.strip(STRIP)
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def keys_of(text: bytes | None) -> set[bytes]:
    """The digests of the keys of one document."""
    found = {line_key(x) for x in (text or b"").split(b"\n")}
    found.discard(None)
    return found


def positions(digests: list[bytes], bits: int) -> np.ndarray:
    """HASHES bit positions of each digest, one row per digest."""
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return (words[:, :HASHES] % np.uint64(bits)).astype(np.int64)


def sized(docs: DataFrame) -> int:
    """The filters' bits, a power of two, for the lines of docs."""
    text = F.col("text").cast("string")
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    return min(max(1 << (BITS_A_LINE * lines).bit_length(), LEAST_BITS), MOST_BITS)


def filters(docs: DataFrame, bits: int) -> bytes:
    """The twice-seen filter: bits // 8 bytes."""
    size = min(SEGMENT, bits)

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.empty(0, np.int64)
        hits2 = np.empty(0, np.int64)
        for b in batches:
            digests = [k for t in raw(b.column(0)) for k in keys_of(t)]
            if digests:
                found, n = np.unique(np.concatenate([hits, positions(digests, bits).ravel()]), return_counts=True)
                hits, hits2 = found, np.union1d(hits2, found[n > 1])
        for twice, at in ((False, hits), (True, hits2)):
            own = at // size
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            parts = [(int(own[i]), at[i:j] - own[i] * size) for i, j in zip(heads, [*heads[1:], len(at)], strict=True)] if len(at) else []
            if parts:
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s for s, _ in parts], pa.int32()), "twice": pa.array([twice] * len(parts)), "at": pa.array([p.astype(np.uint32).tobytes() for _, p in parts], pa.binary())})

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(size, bool), np.zeros(size, bool)
        for is_twice, at in zip(group["twice"], group["at"], strict=True):
            p = np.frombuffer(at, np.uint32)
            if is_twice:
                twice[p] = True
            else:
                twice[p[once[p]]] = True
                once[p] = True
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    hits = docs.select(F.col("text").cast("string")).mapInArrow(tidy(hit), "segment int, twice boolean, at binary")
    out = bytearray(bits // 8)
    for r in hits.groupBy("segment").applyInPandas(merge, "segment int, bits binary").toLocalIterator():
        out[r.segment * size // 8 : (r.segment + 1) * size // 8] = r.bits
    return bytes(out)


def suspects(docs: DataFrame, twice: bytes, bits: int) -> DataFrame:
    """(key, doc_id, mark) of the lines that may be repeats, once per row and key; mark is a hash of the row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            keys, rows = [], []
            for i, t in enumerate(raw(b.column(1))):
                own = keys_of(t)
                keys += own
                rows += [i] * len(own)
            if keys:
                p = positions(keys, bits)
                hit = np.flatnonzero(((seen[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.binary()), *(b.column(c).take(pa.array([rows[i] for i in hit], pa.int64())) for c in (0, 2))], names=["key", "doc_id", "mark"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("mark")).mapInArrow(tidy(run), "key binary, doc_id long, mark long")


def repeats(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, keeper) of the keys in at least min_docs documents. Both counts are combined before they shuffle."""
    pairs = found.select("key", "doc_id").distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs).select("key", "keeper")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """All columns of docs, then n_lines, n_dropped and kept_text (clashing input columns are replaced)."""
    docs = docs.drop("n_lines", "n_dropped", "kept_text", "__drop", "__id", "__mark")
    bits = bits or sized(docs)
    found = suspects(docs, filters(docs, bits), bits)
    rep = cut(repeats(found, min_docs))
    schema = StructType(list(docs.schema.fields)).add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")
    names, width = schema.names, len(docs.columns)

    def edited(b: pa.RecordBatch, lost) -> pa.RecordBatch:
        """lost(row, key): whether that row loses lines with that key."""
        n_lines, n_dropped, kept = [], [], []
        for i, t in enumerate(raw(b.column(at_text).cast(pa.string()))):
            lines = (t or b"").split(b"\n")
            stay = [x for x in lines if (k := line_key(x)) is None or not lost(i, k)]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay).decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=names)

    if rep.count() <= broadcast_keys:
        keepers = docs.sparkSession.sparkContext.broadcast({bytes(r.key): r.keeper for r in rep.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = keepers.value
            for b in batches:
                ids = b.column(at_id).cast(pa.int64()).to_pylist()
                yield edited(b, lambda i, k, ids=ids: k in own and own[k] != ids[i])

        return docs.mapInArrow(tidy(run), schema)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drops = [set(x or ()) for x in b.column(width).to_pylist()]
            yield edited(b, lambda i, k, drops=drops: k in drops[i])

    lost = found.join(rep, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drop = lost.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_set("key").alias("__drop"))  # of one text
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__mark"))
    return docs.join(drop, own, "left").select(*docs.columns, "__drop").mapInArrow(tidy(run_joined), schema)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select(F.col("doc_id").cast("long"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= {MIN_DOCS}),
j AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid"""
