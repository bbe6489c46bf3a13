"""Exact top-k search: BM25 over an inverted index in shards, pruned by bounds from columns that terms share.

1. `index`: tasks cut their documents into shards of at most SHARD documents and
   POSTINGS postings (one longer text is a shard of its own) and invert each
   where it was read. A shard is one row: terms by a hash of 64 bits, their
   postings, and the documents' ids and lengths. Inside a shard, documents that
   use the same common words (one language, say) stand together in a group.
2. `statistics`: document frequencies, number of documents and mean length of all
   shards; scores of different shards are comparable and merge exactly.
3. Shards are searched in waves, each about WAVE times as large as all before it.
   The k-th score that a query has so far is its floor in the next wave, so a
   wave returns about WAVE * k hits a query however many shards there are. A
   wave reads each shard once for BLOCKS blocks of queries.
4. `Shard.searches`, for many queries at once, each against its threshold (the
   floor, or the k-th score that the task has found since):
   a. a query whose terms' maxima don't reach the threshold is done; for the
      others, the shard's rare terms are added up from their lists;
   b. a group stays closed to a query if that and the maxima of the other terms
      in the group don't reach the threshold;
   c. in open groups, one matrix product bounds what the other terms give: those
      that many documents have are columns of their own, the others share
      columns, so that a column stands for SHARE of the documents or more. What a
      document and a query have in different terms of one column is counted too
      high, but few pairs still reach the threshold by it;
   d. only these are scored, in single precision, and what then reaches the
      threshold, with its error allowed for, exactly.
   Where a query has no threshold yet, the documents with its highest bounds are
   scored first and give one.
5. The k best of each task are merged by query.

Queries go out in blocks of about QUERIES queries and QUERY_TERMS terms, each
broadcast on its own and BLOCKS at a time, so that what is sent doesn't grow with
the number of queries. Documents are never shuffled; only hits are.

A query's term counts as often as it stands in the query. Words are lower-cased
(A-Z) runs of anything but ASCII white space. Documents without a common word
are no hits. Ties go to the smaller doc_id, null first. Null and empty texts
have no words: as queries they find nothing. Repeated rows are documents, and
queries, of their own. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from picmeta.llm.shared import SPACE, cut, raw, scratch, slices, tidy

K, K1, B = 10, 1.2, 0.75
SHARD, POSTINGS = 2048, 1_000_000
GROUPS = 16  # of a shard's documents, at most
QUERIES, QUERY_TERMS = 4096, 2_000_000
BLOCKS = 4  # of queries for which shards are read once
PER_FILE = 8  # shards in a file
WAVE = 8
WIDTHS = (1, 2, 4, 8, 12, 16, 24, 32)  # of the tables of lists; terms that more documents of a shard have are in matrices
SHARE = 0.12  # of a group's documents, on average, that a column stands for at least
TOGETHER, CELLS = 512, 1 << 22  # queries in a matrix product, and most cells of a table of them
READ = 1 << 14  # postings that are read from lists at once
SLACK = 1 - 1e-9  # bounds and scores are sums in different orders
NONE = np.iinfo(np.int64).min  # stands for a null id
SHARDS = "terms array<binary>, df array<int>, at array<int>, tf array<int>, ids array<long>, lens array<int>, groups array<int>"
SPACES, LOWER = np.isin(np.arange(256), list(SPACE.encode())), np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTES = np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # for `hashed`, by place and byte
for _shift, _factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
    BYTES = (BYTES ^ (BYTES >> np.uint64(_shift))) * np.uint64(_factor)


def spread(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text (string or binary) begins, and the last ends, in their bytes; and these."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)


def counted(texts: list[bytes | None] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text, term and count of each pair that occurs (by text, then term), the texts' lengths, and the terms."""
    if not isinstance(texts, pa.Array) or texts.null_count:
        texts = pa.array([x or b"" for x in (raw(texts) if isinstance(texts, pa.Array) else texts)], pa.large_binary())
    begin, data = spread(texts)
    space = SPACES[data]
    first = np.zeros(len(data) + 1, bool)
    first[begin] = True
    words = np.flatnonzero(~space & (np.append(True, space[:-1]) | first[:-1])) if len(data) else np.empty(0, np.int64)
    at = np.searchsorted(begin, words, "right") - 1
    solid = LOWER[data[~space]]
    ends = np.append(words - np.cumsum(space)[words], len(solid))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(solid)]).dictionary_encode()
    code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary())
    pair, n = np.unique(at * max(len(terms), 1) + code, return_counts=True)
    return pair // max(len(terms), 1), pair % max(len(terms), 1), n, np.bincount(at, minlength=len(texts)), terms


def hashed(terms: pa.Array) -> np.ndarray:
    """64 bits for each term: the sum of a fixed random number for each byte and its place."""
    begin, data = spread(terms)
    size = np.diff(begin)
    place = (np.arange(len(data)) - np.repeat(begin[:-1], size)) & 63
    out, some = np.zeros(len(terms), np.uint64), np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(BYTES[place * 256 + data], begin[some])
    return out


def alike(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, df: np.ndarray) -> np.ndarray:
    """A group for each of n documents: GROUPS means of those terms that many documents have, moved a few times."""
    often = np.flatnonzero(df * 16 >= n)
    if n < 8 * GROUPS or not len(often):
        return np.zeros(n, np.int64)
    col = np.full(len(df), -1)
    col[often] = np.arange(len(often))
    own = np.flatnonzero(col[term] >= 0)
    x = np.zeros((n, len(often)), np.float32)
    x[doc[own], col[term[own]]] = np.sqrt(tf[own])
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    means = x[np.linspace(0, n - 1, GROUPS).astype(int)]
    for _ in range(6):
        group = np.argmax(x @ means.T, axis=1)
        means = np.stack([x[group == i].sum(axis=0) for i in range(GROUPS)])
        means /= np.maximum(np.linalg.norm(means, axis=1), 1e-9)[:, None]
    return np.argmax(x @ means.T, axis=1)


def inverted(parts: list[tuple]) -> dict:
    """One shard of parts: ids and what `counted` gives, some texts each."""
    coded = pa.concat_arrays([c[4] for _, c in parts]).dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    docs, terms, first, seen = [], [], 0, 0
    for ids, (doc, term, _, _, own) in parts:
        docs.append(doc + first)
        terms.append(code[seen : seen + len(own)][term])
        first, seen = first + len(ids), seen + len(own)
    doc, term, tf = np.concatenate(docs), np.concatenate(terms), np.concatenate([c[2] for _, c in parts])
    lens, ids = np.concatenate([c[3] for _, c in parts]), [i for own, _ in parts for i in own]
    by_hash = np.argsort(hashed(names), kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[by_hash] = np.arange(len(names))
    df = np.bincount(term, minlength=len(names))
    group = alike(doc, term, tf, first, df)
    seats = np.lexsort((lens, group))
    seat = np.empty(first, np.int64)
    seat[seats] = np.arange(first)
    at, term = seat[doc], rank[term]
    order = np.argsort(term * first + at)
    sizes = np.bincount(group)
    return {"terms": names.take(pa.array(by_hash)), "df": df[by_hash], "at": at[order], "tf": tf[order], "ids": [ids[i] for i in seats], "lens": lens[seats], "groups": sizes[sizes > 0]}


def wave() -> Column:
    """How often WAVE divides a random number: 0 for most shards, each further number for one in WAVE of those before."""
    h = F.abs(F.xxhash64(F.array_join(F.slice("ids", 1, 8), ",", "-"), F.size("ids"), F.spark_partition_id()) % WAVE**12)
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(11)), lambda i: h % F.pow(F.lit(WAVE), i).cast("long") == 0))


def index(docs: DataFrame) -> DataFrame:
    """The shards of docs (doc_id, text), written to the shared folder."""

    def row(parts: list[tuple]) -> pa.RecordBatch:
        s = inverted(parts)
        flat = {k: v if k == "terms" else pa.array(v, pa.int64() if k == "ids" else pa.int32()) for k, v in s.items()}
        return pa.RecordBatch.from_pydict({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in flat.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, postings = [], 0, 0
        for batch in batches:
            for large in slices(batch, 1):
                for i in range(0, large.num_rows, 256):
                    b = large.slice(i, 256)
                    c = counted(b.column(1))
                    if parts and (held + b.num_rows > SHARD or postings + len(c[0]) > POSTINGS):
                        yield row(parts)
                        parts, held, postings = [], 0, 0
                    parts.append((b.column(0).to_pylist(), c))
                    held, postings = held + b.num_rows, postings + len(c[0])
        if parts:
            yield row(parts)

    return cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), SHARDS).withColumn("wave", wave()), per_file=PER_FILE, by="wave")


def statistics(shards: DataFrame) -> tuple[DataFrame, int, float]:
    """(term, df) over all shards, the number of documents, and their mean length."""
    df = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    n, total = shards.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    return df, n, total / n if n and total else 1.0


def weighed(queries: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """(uid, query_id, terms: array of (term, weight) in byte order) of the queries that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 2):
                q, term, c, _, terms = counted(b.column(2))
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), terms.take(pa.array(term)), pa.array(c.astype(np.int64))], names=["uid", "query_id", "term", "c"])

    rows = queries.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("query_id"), F.col("text").cast("string"))
    known = rows.mapInArrow(run, "uid long, query_id long, term binary, c long").join(df, "term")
    weight = F.col("c") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return known.groupBy("uid", "query_id").agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("weight")))).alias("terms"))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; ties by id."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= edge)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))


def of_docs(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of the postings of each of n documents, if they are put in the documents' order."""
    many = np.bincount(at, minlength=n)
    return np.cumsum(many) - many, many


class Shard:
    """One shard for queries: lists of the rare terms, and for each group of documents a matrix of the others, the usual ones. Of terms that share a column, it has the highest impact that a document gives to one."""

    def __init__(self, s: dict, words: pa.Array | None = None, mean: float = 1.0):
        df, self.at, lens, self.ids, self.terms = s["df"], s["at"], s["lens"], s["ids"], s["terms"]
        self.n, groups = len(lens), len(s["groups"])
        self.imp = s["tf"] * (K1 + 1) / (s["tf"] + (K1 * (1 - B + B * lens / mean))[self.at])
        self.keys = hashed(self.terms)
        self.edges = [0, *np.cumsum(s["groups"]).tolist()]
        kind = np.searchsorted(WIDTHS, df)  # terms are numbered by it
        order = np.argsort(kind, kind="stable")
        self.number = np.empty(len(df), np.int32)
        self.number[order] = np.arange(len(df))
        self.size, self.begin = df[order], (np.cumsum(df) - df)[order]
        self.highest = np.maximum.reduceat(self.imp, np.cumsum(df) - df)[order] if len(df) else self.imp
        self.starts, self.lists = np.searchsorted(kind[order], np.arange(len(WIDTHS) + 1)).tolist(), []
        for i, width in enumerate(WIDTHS):
            own = slice(self.starts[i], self.starts[i + 1])
            void = np.arange(width) >= self.size[own][:, None]
            post = np.where(void, 0, self.begin[own][:, None] + np.arange(width))
            self.lists.append((np.where(void, self.n, self.at[post]).astype(np.int32), np.where(void, 0, self.imp[post]).astype(np.float32)))
        usual = len(df) - self.starts[-1]
        term = np.repeat(self.number, df)
        post = np.flatnonzero(term >= self.starts[-1])
        row, at, imp = term[post].astype(np.int64) - self.starts[-1], self.at[post], self.imp[post].astype(np.float32)
        group = np.repeat(np.arange(groups), s["groups"])[at]
        cell = row * groups + group
        heads = np.flatnonzero(np.diff(cell, prepend=-1))
        many, self.most = np.zeros(usual * groups, np.int64), np.zeros(usual * groups, np.float32)
        if len(heads):
            many[cell[heads]], self.most[cell[heads]] = np.diff(heads, append=len(cell)), np.maximum.reduceat(imp, heads)
        many, self.most, self.whole = many.reshape(-1, groups), self.most.reshape(-1, groups), []
        for g, n in enumerate(s["groups"].tolist()):
            own = np.argsort(-many[:, g], kind="stable")[: np.count_nonzero(many[:, g])]
            part = many[own, g] / n
            alone = int(np.count_nonzero(part >= SHARE))
            column = np.full(usual, -(1 << 40))
            column[own[:alone]], column[own[alone:]] = np.arange(alone), alone + (np.cumsum(part[alone:]) / SHARE).astype(np.int64)
            x = np.flatnonzero(group == g)
            table = np.zeros((max(0, int(column.max(initial=-1)) + 1), n), np.float32)
            np.maximum.at(table.ravel(), column[row[x]] * n + at[x] - self.edges[g], imp[x])
            self.whole.append((column, table))
        order = np.argsort(self.at.astype(np.uint16) if self.n < 1 << 16 else self.at, kind="stable")
        self.own = of_docs(self.at, self.n), term[order], self.imp[order]
        order = np.argsort(at.astype(np.uint16) if self.n < 1 << 16 else at, kind="stable")
        self.own_usual = of_docs(at, self.n), row[order], imp[order]
        self.read = self.held = self.scored = 0  # impacts that were read from lists, that the queries' terms have, and pairs of a query and a document that were scored
        if words is not None:
            keys = hashed(words)
            order = np.argsort(keys)
            self.ask(words.take(pa.array(order)), keys[order])
            self.local = self.local[np.argsort(order)]

    def ask(self, words: pa.Array, keys: np.ndarray) -> None:
        """From now on codes of terms are places in words, whose hashes are keys, ascending."""
        self.local = np.full(len(words), -1, np.int32)
        found = np.searchsorted(keys, self.keys)
        found[found == len(keys)] = 0
        own = np.flatnonzero(keys[found] == self.keys) if len(keys) else np.empty(0, np.int64)
        self.local[found[own]] = self.number[own]
        same = pc.equal(words.take(pa.array(found[own])), self.terms.take(pa.array(own)))
        if (self.keys[1:] == self.keys[:-1]).any() or (keys[1:] == keys[:-1]).any() or pc.any(pc.invert(same)).as_py():  # two terms with one hash
            own = pc.fill_null(pc.index_in(words, self.terms), -1).to_numpy()
            self.local = np.append(self.number, -1)[own]

    def searches(self, codes: np.ndarray, weights: np.ndarray, off: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Query number, places and scores of the k best documents of each query with hits at or above its floor. Terms of query q: codes[off[q]:off[q + 1]], places in the queries' words."""
        step = max(1, min(TOGETHER, CELLS // max(self.n + 1, len(self.most))))
        for first in range(0, len(off) - 1, step):
            last = min(first + step, len(off) - 1)
            t, w = self.local[codes[off[first] : off[last]]], weights[off[first] : off[last]]
            q = np.repeat(np.arange(last - first), np.diff(off[first : last + 1]))
            here = np.flatnonzero(t >= 0)
            yield from ((first + x, place, score) for x, place, score in self.search(t[here], w[here], q[here], floors[first:last], k))

    def add(self, about: np.ndarray, t: np.ndarray, w: np.ndarray, q: np.ndarray) -> None:
        """Adds what lists of terms t give query q's documents to about (queries by documents, and a last column that means nothing)."""
        flat, base, w = about.ravel(), q * (self.n + 1), w.astype(np.float32)
        for (at, imp), low, high in zip(self.lists, self.starts, self.starts[1:]):
            own = np.flatnonzero((t >= low) & (t < high))
            for first in range(0, len(own), READ // at.shape[1]):
                x = own[first : first + READ // at.shape[1]]
                row = t[x] - low
                key = at.take(row, axis=0).ravel() + np.repeat(base[x], at.shape[1])
                np.add.at(flat, key, imp.take(row, axis=0).ravel() * np.repeat(w[x], at.shape[1]))
                self.read += int(self.size[t[x]].sum())

    def refined(self, x: np.ndarray, docs: np.ndarray, table: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """Scores, in single precision, of documents docs for queries x."""
        (first, many), row, imp = self.own_usual
        self.scored += len(x)
        begin = first[docs]
        score = [table[i].take(row[a:b]) @ imp[a:b] for i, a, b in zip(x.tolist(), begin.tolist(), (begin + many[docs]).tolist())]
        return rare[x, docs] + np.array(score, np.float32)

    def search(self, t: np.ndarray, w: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number, places and scores of the k best documents of each of some queries. t, w, q: their terms in the shard, by query."""
        m = len(floors)
        self.held += int(self.size.take(t).sum())
        least = np.maximum(0.0, floors * SLACK - 1e-9)
        sure = max(0.0, 1 - (len(self.most) + 2 * np.bincount(q, minlength=1).max() + 8) * 2.0**-23)  # in single precision; all that is added up is positive
        enough = np.maximum(least * sure * (1 - 2.0**-22), 1e-30).astype(np.float32)
        able = np.bincount(q, w * self.highest[t], m) >= enough
        t, w, q = (x[able[q]] for x in (t, w, q))
        rare = np.zeros((m, self.n + 1), np.float32)
        self.add(rare, t, w, q)
        rare[:, self.n] = 0
        own = np.flatnonzero(t >= self.starts[-1])
        row, of, weight = t[own] - self.starts[-1], q[own], w[own].astype(np.float32)
        table = np.zeros((m, len(self.most)), np.float32)
        table[of, row] = weight
        open_ = table @ self.most + np.maximum.reduceat(rare[:, : self.n], self.edges[:-1], axis=1) >= enough[:, None]
        bound = np.zeros((m, self.n), np.float32)
        for g, (column, given) in enumerate(self.whole):
            x = np.flatnonzero(open_[:, g])
            if len(x):
                part = slice(self.edges[g], self.edges[g + 1])
                seat = np.full(m, -(1 << 40))
                seat[x] = np.arange(len(x)) * len(given)
                cell = seat.take(of) + column.take(row)
                z = np.flatnonzero(cell >= 0)
                weights = np.zeros((len(x), len(given)), np.float32)
                np.add.at(weights.ravel(), cell[z], weight[z])
                bound[x, part] = weights @ given
        bound += rare[:, : self.n]
        both = np.flatnonzero(bound >= enough[:, None])
        x = np.flatnonzero(np.bincount(both // self.n, minlength=m) > 4 * k)
        if len(x):  # those whose bounds are highest give a threshold
            docs = np.argpartition(bound[x], self.n - k, axis=1)[:, self.n - k :]
            score = self.refined(np.repeat(x, k), docs.ravel(), table, rare).reshape(-1, k)
            enough[x] = np.maximum(enough[x], score.min(axis=1) * sure**2 - 4e-9)
            both = np.flatnonzero(bound >= enough[:, None])
        x, docs = both // self.n, both % self.n
        score = self.refined(x, docs, table, rare)
        good = np.flatnonzero(score >= enough[x])
        x, docs, score = x[good], docs[good], score[good]
        ends, begin = np.searchsorted(x, np.arange(m + 1)), np.searchsorted(q, np.arange(m + 1))
        weight, ((first, many), term, imp) = np.zeros(len(self.size)), self.own
        for x in np.flatnonzero(np.diff(ends)).tolist():
            near, own = docs[ends[x] : ends[x + 1]], slice(begin[x], begin[x + 1])
            if len(near) > 2 * k:
                about = score[ends[x] : ends[x + 1]]
                near = near[about >= np.partition(about, len(near) - k)[len(near) - k] * sure**2 - 4e-9]
            weight[t[own]] = w[own]
            exact = np.array([(imp[i:j] * weight.take(term[i:j])).sum() for i, j in zip(first[near].tolist(), (first[near] + many[near]).tolist())])
            weight[t[own]] = 0
            exact = np.round(exact, 9)  # terms come in one order: equal texts score alike in all shards
            good = (exact >= least[x]) & (exact > 0)
            near, exact = near[good], exact[good]
            kept = best(exact, self.ids[near], k)
            if len(kept):
                yield x, near[kept], exact[kept]


def sent(block: pa.Table) -> tuple:
    """What tasks get of a block of queries: its words by their hashes, these, the queries' terms as places in the words, weights, ends of queries, uids and ids."""
    block = block.combine_chunks()
    lists = block.column("terms").combine_chunks() if block.num_rows else pa.array([], block.schema.field("terms").type)
    flat = lists.flatten()
    coded = pa.array(flat.field("term").cast(pa.binary())).dictionary_encode()
    keys = hashed(coded.dictionary)
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.arange(len(keys))
    off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))])
    return coded.dictionary.take(pa.array(order)), keys[order], rank[coded.indices.to_numpy()], flat.field("weight").to_numpy(), off, block.column("uid").to_numpy(), block.column("query_id").combine_chunks()


def hits(shards: DataFrame, blocks: list[Broadcast], floors: list[np.ndarray], mean: float, k: int) -> DataFrame:
    """(uid, query_id, doc_id, score): the k best of each task's shards for each query of blocks, without those below their floor (by block and query)."""
    shared = shards.sparkSession.sparkContext.broadcast(floors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [x.copy() for x in shared.value]
        found: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in blocks]
        for b in batches:
            for i in range(b.num_rows):
                own = {c: b.slice(i, 1).column(j).flatten() for j, c in enumerate(b.schema.names)}
                s = {c: own[c].to_numpy().astype(np.int64) for c in ("df", "at", "tf", "lens", "groups")} | {"terms": own["terms"].cast(pa.binary()), "ids": pc.fill_null(own["ids"], NONE).to_numpy()}
                shard = Shard(s, mean=mean)
                for at, block in enumerate(blocks):
                    words, keys, codes, weights, off = block.value[:5]
                    shard.ask(words, keys)
                    for q, place, score in shard.searches(codes, weights, off, least[at], k):
                        before = found[at].get(q, (np.empty(0), np.empty(0, np.int64)))
                        both, ids = np.concatenate([before[0], score]), np.concatenate([before[1], s["ids"][place]])
                        kept = best(both, ids, k)
                        found[at][q] = both[kept], ids[kept]
                        if len(kept) == k:
                            least[at][q] = max(least[at][q], both[kept[-1]])
        for block, own in zip(blocks, found):
            if own:
                at = pa.array(np.repeat(np.fromiter(own, np.int64, len(own)), [len(x) for x, _ in own.values()]))
                score, ids = (np.concatenate([x[j] for x in own.values()]) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(block.value[5]).take(at), block.value[6].take(at), pa.array(ids, mask=ids == NONE), pa.array(score, pa.float64())], names=["uid", "query_id", "doc_id", "score"])

    return shards.select(*(c.split()[0] for c in SHARDS.split(", "))).mapInArrow(tidy(run), "uid long, query_id long, doc_id long, score double")


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, queries_at_once: int = QUERIES) -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents with the highest BM25 score for each row of queries (doc_id, text)."""
    spark = docs.sparkSession
    shards = index(docs)
    df, n, mean = statistics(shards)
    asked = cut(weighed(queries, df, n))
    count, terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, math.ceil(count / queries_at_once), math.ceil(terms / QUERY_TERMS))
    waves = sorted((r.wave for r in shards.select("wave").distinct().collect()), reverse=True) or [0]  # twelve at most
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    for i in range(0, blocks, BLOCKS):
        uids, shared = [], []
        for j in range(i, min(i + BLOCKS, blocks)):
            block = sent(asked.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == j).toArrow())
            uids.append(block[5])
            shared.append(spark.sparkContext.broadcast(block))
        floors: dict[int, float] = {}
        so_far = None
        for w in waves:
            part = hits(shards.filter(F.col("wave") == w), shared, [np.array([floors.get(u, 0.0) for u in x.tolist()]) for x in uids], mean, k)
            part = part if so_far is None else part.unionByName(so_far)
            so_far = cut(part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"))
            floors = {r.uid: r.score for r in so_far.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k).collect()}  # of the queries of BLOCKS blocks
        so_far.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
        for block in shared:
            block.destroy()
    return spark.read.schema("query_id long, rank int, doc_id long, score double").parquet(path)
