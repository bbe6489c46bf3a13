"""Spelling variants: words that are one edit apart, by merging tries with errata.

A trie of all words is cut into heavy paths: of each node's children the one
with the most words below it (ties: the smallest character) is heavy. The other
children's subtrees, and a word that ends at the node, are light; a word has a
logarithmic number of light places. Two words that are one edit apart have one
node v where they part, and at least one of them is light there. So at each node
the light subtrees are merged, small into large, with one character in error:

* skipped: v + c + rest meets v + rest (the light word is the longer one);
* inserted: v + rest meets v + heavy + rest (the light word is the shorter one);
* replaced: v + c + rest meets all v + * + rest, of light subtrees and the heavy
  one. Those that meet are near to each other all; each gets the group's size and
  its best word, so pairs aren't written out. A group has at most one word for
  each letter.

Each pair of near words meets in exactly one of these ways, at one node.

Words are dealt to tries by ranges, PER_TRIE each: a range is one task, and nodes
inside it are merged there (`merged`). Only nodes that reach over the end of a
range, such as the root, need other tasks: their heavy children are agreed on
first (`agreed`: a few dozen prefixes for each range, broadcast), and what their
light words turn into goes through joins with all words. So no prefix is too
common: a trie is split wherever it is too large.

`forms`: a word's form is its near word with the most occurrences, if they are
RATIO times its own; the root is where the forms lead. Occurrences grow by RATIO
with each step, so a few rounds of pointer doubling find all roots.

Null or empty text has no words; a null doc_id hashes as the empty text. Repeated
rows count again. Texts and words of any length are taken whole. An empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from picmeta.llm.shared import crc32_sql, cut, raw, slices

LEAST = 7  # code points of a word
MIN_N = 2
EVERY = 31
RATIO = 10
PER_TRIE = 1 << 16
COUNTED = 64  # prefixes up to this length are counted in every range; longer ones only where they branch
HELD = 200_000
SLICE = 1 << 20


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of docs (doc_id, text): runs of letters, A-Z lower-cased, one in EVERY of a document's distinct runs without one letter; from LEAST code points and MIN_N occurrences."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for b in slices(batch, 1, SLICE):
                for doc, t in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                    begun = crc32(b":" if doc is None else b"%d:" % doc)
                    own = Counter(m[0] for m in runs.finditer((t or b"").lower().decode("utf-8", "replace")))
                    for w, k in own.items():
                        h = crc32(w.encode(), begun)
                        if h % EVERY == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < LEAST:
                                continue
                        counts[w] += k
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_N)


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is common, a[:hi] isn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def reaching(words: list[str], before: int, after: int) -> list[str]:
    """The prefixes whose nodes reach over the ends of sorted words: before and after are the lengths that the first and the last word share with the neighbouring ranges; -1: none."""
    return sorted({words[0][:d] for d in range(before + 1)} | {words[-1][:d] for d in range(after + 1)})


def children(words: list[str], lo: int, hi: int, d: int) -> list[tuple[int, int]]:
    """The ranges of the children of the node of depth d that has the sorted words lo to hi; a word that ends there is left out."""
    found, at = [], lo + (len(words[lo]) == d)
    while at < hi:
        end = bisect_left(words, words[at][:d] + chr(ord(words[at][d]) + 1), at, hi)
        found.append((at, end))
        at = end
    return found


def under(words: list[str], prefix: str) -> tuple[int, int]:
    return bisect_left(words, prefix), bisect_left(words, prefix[:-1] + chr(ord(prefix[-1]) + 1)) if prefix else len(words)


class Nearest:
    """How many near words each word has, and the best of them: the most occurrences, then the smallest."""

    def __init__(self, words: list[str], n: list[int]):
        self.key = [(-k, w) for w, k in zip(words, n, strict=True)]
        self.n, self.best = [0] * len(words), [None] * len(words)

    def add(self, i: int, others: int, best: tuple[int, str]) -> None:
        self.n[i] += others
        if self.best[i] is None or best < self.best[i]:
            self.best[i] = best

    def pair(self, i: int, j: int) -> None:
        self.add(i, 1, self.key[j])
        self.add(j, 1, self.key[i])

    def group(self, members: list[int]) -> None:
        first, second = sorted(self.key[i] for i in members)[:2]
        for i in members:
            self.add(i, len(members) - 1, second if self.key[i] == first else first)


MERGED = pa.schema([("kind", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_m", pa.int64()), ("best", pa.string()), ("probe", pa.string()), ("star", pa.string())])


def merge(words: list[str], n: list[int], before: int, after: int, heavy: dict[str, str]) -> pa.Table:
    """The near words inside one range, and the probes of the nodes that reach over its ends."""
    place = {w: i for i, w in enumerate(words)}
    near, over = Nearest(words, n), set(reaching(words, before, after))
    probes: list[tuple[str, int, str, str | None]] = []
    for v in over & heavy.keys():
        h, d = heavy[v], len(v)
        for i in range(*under(words, v)):
            x = words[i]
            if len(x) == d:
                probes.append(("edit", i, v + h, None))
            elif x[d] != h:
                rest = x[d + 1 :]
                probes.append(("edit", i, v + h + x[d:], None))
                if rest[:1] != x[d]:
                    probes.append(("edit", i, v + rest, None))
                probes.append(("star", i, v + h + rest, f"{v}*{rest}"))
    todo = [(0, len(words))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        d = shared_prefix(words[lo], words[hi - 1])
        kids = children(words, lo, hi, d)
        todo += kids
        v = words[lo][:d]
        if v in over:
            continue
        large = max(kids, key=lambda k: (k[1] - k[0], -k[0]))
        h = words[large[0]][d]
        if len(words[lo]) == d and (j := place.get(v + h)) is not None:
            near.pair(lo, j)
        stars: dict[str, list[int]] = {}
        for k in kids:
            if k == large:
                continue
            for i in range(*k):
                x, rest = words[i], words[i][d + 1 :]
                if (j := place.get(v + h + x[d:])) is not None:
                    near.pair(i, j)
                if rest[:1] != x[d] and (j := place.get(v + rest)) is not None:
                    near.pair(i, j)
                stars.setdefault(rest, []).append(i)
        for rest, members in stars.items():
            if (j := place.get(v + h + rest)) is not None:
                members.append(j)
            if len(members) > 1:
                near.group(members)
    own = [i for i, k in enumerate(near.n) if k]
    cols = [
        ["near"] * len(own) + [p[0] for p in probes],
        [words[i] for i in own] + [words[p[1]] for p in probes],
        [n[i] for i in own] + [n[p[1]] for p in probes],
        [near.n[i] for i in own] + [None] * len(probes),
        [near.best[i][0] for i in own] + [None] * len(probes),
        [near.best[i][1] for i in own] + [None] * len(probes),
        [None] * len(own) + [p[2] for p in probes],
        [None] * len(own) + [p[3] for p in probes],
    ]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, MERGED.types, strict=True)], schema=MERGED)


def taken(table: pa.Table) -> tuple[list[str], list[int]]:
    rows = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
    return [w for w, _ in rows], [k for _, k in rows]


def agreed(dealt: DataFrame, ends: dict[int, tuple[int, int]]) -> dict[str, str]:
    """The heavy child of each node that reaches over the end of a range."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        words, _ = taken(table)
        before, after = ends[key[0].as_py()]
        out = []
        for v in reaching(words, before, after):
            lo, hi = under(words, v)
            kids = children(words, lo, hi, len(v))
            if len(v) <= COUNTED or len(v) in (before, after) or len(kids) + (words[lo] == v) > 1:
                out += [(v, words[i][len(v)], j - i) for i, j in kids]
        v, c, k = zip(*out, strict=True) if out else ((), (), ())
        return pa.Table.from_arrays([pa.array(v, pa.string()), pa.array(c, pa.string()), pa.array(k, pa.int64())], names=["v", "c", "k"])

    found = dealt.groupBy("trie").applyInArrow(run, "v string, c string, k long").groupBy("v", "c").agg(F.sum("k").alias("k"))
    return {r.v: r.c for r in found.groupBy("v").agg(F.min_by("c", F.struct(-F.col("k"), "c")).alias("c")).collect()}


def merged(words: DataFrame, per_trie: int = PER_TRIE) -> DataFrame:
    """Rows (kind, word, n, ...): near words inside each range of words (word, n), and probes for the joins with other ranges."""
    tries = max(1, -(-words.count() // per_trie))
    dealt = cut(words.repartitionByRange(tries, "word").withColumn("trie", F.spark_partition_id()))
    spans = sorted((r.trie, r.first, r.last) for r in dealt.groupBy("trie").agg(F.min("word").alias("first"), F.max("word").alias("last")).collect())  # one row a trie
    common = [-1, *(shared_prefix(a[2], b[1]) for a, b in zip(spans, spans[1:], strict=False)), -1]
    ends = {s[0]: (common[k], common[k + 1]) for k, s in enumerate(spans)}
    heavy = agreed(dealt, ends) if len(spans) > 1 else {}
    known = words.sparkSession.sparkContext.broadcast((ends, heavy))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ends, heavy = known.value
        return merge(*taken(table), *ends[key[0].as_py()], heavy)

    schema = "kind string, word string, n long, n_near long, best_m long, best string, probe string, star string"
    return cut(dealt.groupBy("trie").applyInArrow(run, schema))


def neighbours(words: DataFrame, per_trie: int = PER_TRIE) -> DataFrame:
    """(word, n_near, best struct<m, w>): of the words (word, n) that have any."""
    found = merged(words, per_trie)
    own = found.filter("kind = 'near'").select("word", "n_near", F.struct(F.col("best_m").alias("m"), F.col("best").alias("w")).alias("best"))
    every = words.select(F.col("word").alias("probe"), F.col("n").alias("probe_n"))
    met = found.filter("kind = 'edit'").select("word", "n", "probe").join(every, "probe")
    sides = F.array(F.struct("word", F.struct((-F.col("probe_n")).alias("m"), F.col("probe").alias("w")).alias("best")), F.struct(F.col("probe").alias("word"), F.struct((-F.col("n")).alias("m"), F.col("word").alias("w")).alias("best")))
    edits = met.select(F.inline(sides)).select("word", F.lit(1).cast("long").alias("n_near"), "best")
    starred = found.filter("kind = 'star'").select("star", "word", "n", "probe")
    members = starred.select("star", F.struct((-F.col("n")).alias("m"), F.col("word").alias("w")).alias("x")).unionByName(starred.join(every, "probe").select("star", F.struct((-F.col("probe_n")).alias("m"), F.col("probe").alias("w")).alias("x")))
    groups = members.groupBy("star").agg(F.array_sort(F.collect_set("x")).alias("all")).filter(F.size("all") > 1)  # at most one for each letter
    swaps = groups.select("all", F.explode("all").alias("x")).select(F.col("x.w").alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), F.when(F.col("x") == F.col("all")[0], F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    return own.unionByName(edits).unionByName(swaps).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), by pointer doubling."""
    now, open_ = cut(forms.select("word", F.col("form").alias("root"))), True
    while open_:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        now = cut(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        open_, now = not now.filter("moved").isEmpty(), now.drop("moved")
    return now


def variants(words: DataFrame, per_trie: int = PER_TRIE, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), each once."""
    near = neighbours(words, per_trie)
    best_n = -F.col("best.m")
    formed = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(best_n >= ratio * F.col("n"), F.struct(F.col("best.w").alias("form"), best_n.alias("form_n"))).alias("f")).select("word", "n", "n_near", "f.form", "f.form_n"))
    ends = roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return variants(cut(counted(docs)))


ORACLE = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{{LEAST},}}')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY ALL),
h AS (SELECT run, k, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM c),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % {EVERY} = 0 THEN concat(substr(run, 1, (h % length(run))::INTEGER), substr(run, (h % length(run))::INTEGER + 2)) ELSE run END AS word, k FROM h) WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= {MIN_N}),
v AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM w)),
d AS (SELECT DISTINCT word, n, concat(a, b) AS s FROM v),
p AS (SELECT d.word, w.word AS other, w.n AS m FROM d JOIN w ON w.word = d.s
  UNION ALL SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.s
  UNION ALL SELECT x.word, y.word, y.n FROM v x JOIN v y ON x.a = y.a AND x.b = y.b AND x.word <> y.word),
b AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(w := other, n := m), struct_pack(m := -m, w := other)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= {RATIO} * w.n THEN best.w END AS form, CASE WHEN best.n >= {RATIO} * w.n THEN best.n END AS form_n FROM w LEFT JOIN b USING (word)),
g AS (SELECT word, word AS root, 0 AS far FROM f UNION ALL SELECT g.word, f.form, far + 1 FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, far) AS root FROM g GROUP BY word) USING (word)"""
