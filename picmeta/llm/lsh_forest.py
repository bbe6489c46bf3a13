"""Near-duplicates by MinHash and an LSH forest, confirmed on full sets.

1. `signed`: every text becomes its set of 5-word shingles (with fewer words, the
   sequence as one). What is kept is the set's size, a digest, and the minima
   under TREES x DEEP hash functions, 16 bits each: the signature orders of TREES
   sorted trees. Texts with equal sets are one class from here on, represented by
   its smallest doc_id. The shingles themselves are not stored.
2. `placed`: a region of a tree holds the sets with a common prefix of SHALLOW
   minima. Regions of more than REGION sets are cut at DEEP minima instead
   (adaptive depth); one that is large even there is dealt in salted parts.
3. `neighbours`: in each part, in the order of the rest of the signature, a set
   and the next one (longest common prefix) are a candidate pair. In a region of
   more than REGION sets, each set is also paired with the one that has the most
   company in all trees: the original of a star of copies.
4. Each set confirms its best pair of either kind on full sets, shingled again
   from the texts concerned; linked sets form components.
5. `crossing`: what still crosses components inside a region is looked at in
   full, whatever the region's size. Regions of up to REGION sets are compared
   in pairs. Larger ones are dealt into blocks of about BLOCK sets by component,
   and block meets block where components differ. Pairs whose signatures agree
   in fewer places than all but FALSE of the linked pairs do are left out; the
   others are confirmed on full sets.

Nothing is capped. A group of n sets that share regions but aren't linked costs
(n / BLOCK)^2 block pairs, each a comparison of signatures.

SHALLOW is for a similarity of 0.85 and more; below, `shallow` takes as many
minima as keep the chance that two sets share no region in any tree under MISS
(at 0.85 it is 8e-6, at 0.80, with four minima, 3e-5).

Null text and text without words: n_shingles 0, linked with nothing, kept.
Repeated rows are linked like copies, and all rows with the kept doc_id are kept.
A null doc_id sorts before all and stays null. An empty table gives an empty
result. Other columns are ignored by `near_duplicates` and pass through
`deduplicated`. The input must be re-readable.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from picmeta.llm.shared import cut, discard, hinted, numbered, raw, slices, tidy

WORDS = 5
PERCENT = 85
TREES = 20
SHALLOW = 5
DEEP = 8
REST = 12  # minima that order a region
MISS = 5e-5
FALSE = 1e-7
REGION = 48
BLOCK = 256
SEED = 20260101


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    own = [(t or b"").lower().split() for t in texts]
    at, distinct = numbered([w for x in own for w in x])
    hashes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in distinct), np.uint64)[at]
    factor = constants(words, SEED + 1)
    out, begin = [], 0
    for x in own:
        h, n = hashes[begin : begin + len(x)], len(x)
        begin += n
        if n >= words:
            total = np.zeros(n - words + 1, np.uint64)
            for k in range(words):
                total += mixed(h[k : n - words + 1 + k] * factor[k])
            out.append(np.unique(mixed(total)))
        else:
            out.append(np.frombuffer(hashlib.blake2b(b" ".join(x), digest_size=8).digest(), np.uint64) if n else np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The minimum of s under each of the hash functions."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(best, ((s[i : i + 1024, None] ^ (s[i : i + 1024, None] >> np.uint64(32))) * a).min(axis=0), out=best)
    return best


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, mark, n_shingles, digest, orders) of each row; mark tells texts of one doc_id apart, the last two are null for empty sets. orders: TREES x DEEP minima of 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, spread = constants(TREES * DEEP), constants(TREES * DEEP, SEED + 2)
        for batch in batches:
            for b in slices(batch, 2, 1 << 20):
                sets = shingle_sets(raw(b.column(2)), words)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                orders = [mixed(signature(s, a) * spread).astype(">u2").tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(orders, pa.binary())], names=["doc_id", "mark", "n_shingles", "digest", "orders"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), marked("text").alias("mark"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, mark long, n_shingles long, digest binary, orders binary")


def marked(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def shingled(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(digest, shingles) of each row of docs with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 0, 1 << 20):
                sets = [s for s in shingle_sets(raw(b.column(0)), words) if len(s)]
                off = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
                lists = pa.ListArray.from_arrays(off, pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), lists], names=["digest", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "digest binary, shingles array<long>")


def fetched(docs: DataFrame, sets: DataFrame, digests: DataFrame, words: int = WORDS) -> DataFrame:
    """(digest, shingles) of the digests asked for, from the texts of their representatives. The table is small where few texts have near-duplicates."""
    asked = cut(sets.join(digests.distinct(), "digest", "left_semi").select("digest", "rep"))
    ids = hinted(cut(asked.select(F.col("rep").alias("__rep")).distinct()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")
    return cut(shingled(texts, words).join(asked.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("shingles").alias("shingles")))


def shallow(percent: int) -> int:
    """The minima of a region's key: SHALLOW, or fewer where sets of that similarity would be missed too often."""
    return max(k for k in range(1, SHALLOW + 1) if k == 1 or (1 - (percent / 100) ** k) ** TREES < MISS)


def agreeing(percent: int, n: int = TREES * DEEP) -> int:
    """The places of n in which two signatures agree at least; sets of that similarity agree in fewer with a chance below FALSE."""
    p, below, k = percent / 100, 0.0, 0
    while (below := below + math.comb(n, k) * p**k * (1 - p) ** (n - k)) < FALSE:
        k += 1
    return k


def placed(sets: DataFrame, depth: int = SHALLOW) -> DataFrame:
    """(digest, company, places: array of (tree, region, deep, rest, n)) of the sets that share a region with others; n: the region's sets, company: their sum."""
    order = F.expr(f"substring(orders, tree * {2 * DEEP} + 1, {2 * DEEP})")
    rest = F.expr(f"substring(concat(orders, orders), tree * {2 * DEEP} + {2 * depth + 1}, {2 * REST})")  # goes on in the next tree's minima
    each = sets.select("digest", "orders", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("digest", "tree", order.alias("order"), rest.alias("rest"))
    each = each.select("digest", "tree", F.xxhash64("tree", F.substring("order", 1, 2 * depth)).alias("region"), F.xxhash64("tree", "order").alias("deep"), F.col("rest"))
    shared = cut(each.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1"))
    own = each.join(shared, "region").groupBy("digest").agg(F.sum("n").alias("company"), F.collect_list(F.struct("tree", "region", "deep", "rest", "n")).alias("places"))  # TREES at most
    return cut(own)


def neighbours(member: DataFrame) -> DataFrame:
    """(x, y): for each set the neighbour that most trees propose, and, from regions of more than REGION sets, the one with the most company. member: `placed`."""
    each = member.select("digest", "company", F.explode("places").alias("p")).select("digest", "company", "p.*")
    hot = each.filter(F.col("n") > REGION)
    counts = cut(hot.groupBy("deep").agg(F.count("*").alias("m")).filter("m > 1"))
    cutting = hot.join(counts, "deep").select("digest", F.col("deep").alias("part"), "rest", F.pmod(F.xxhash64("digest", "tree"), F.ceil(F.col("m") / REGION)).alias("salt"))
    parts = each.filter(F.col("n") <= REGION).select("digest", F.col("region").alias("part"), "rest", F.lit(0).cast("long").alias("salt")).unionByName(cutting)
    ordered = parts.groupBy("part", "salt").agg(F.sort_array(F.collect_list(F.struct("rest", "digest"))).alias("m")).filter(F.size("m") > 1)  # about REGION sets in each
    both = F.transform(F.sequence(F.lit(2), F.size("m")), lambda i: F.struct(F.element_at("m", i - 1)["digest"].alias("a"), F.element_at("m", i)["digest"].alias("b")))
    pairs = ordered.select(F.explode(both).alias("p")).select("p.*")
    sides = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    best = sides.groupBy("x", "y").agg(F.count("*").alias("trees")).groupBy("x").agg(F.max_by("y", F.struct("trees", "y")).alias("y"))
    centre = hot.groupBy("region").agg(F.max(F.struct("company", "digest")).alias("c")).select("region", F.col("c.digest").alias("y"))
    stars = hot.join(centre, "region").filter(F.col("digest") != F.col("y")).groupBy(F.col("digest").alias("x"), "y").agg(F.count("*").alias("trees")).groupBy("x").agg(F.max_by("y", F.struct("trees", "y")).alias("y"))
    return best.unionByName(stars).groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.first("x").alias("x")).select("x", F.when(F.col("x") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("y"))


def screened(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose sizes and signatures don't rule a link out."""
    least = agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(i, 1024) for batch in batches for i in range(0, batch.num_rows, 1024)):
            one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, TREES * DEEP) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(pa.array((one == two).sum(axis=1) >= least))

    one = sets.select(F.col("digest").alias("x"), F.col("orders").alias("ox"), F.col("n_shingles").alias("nx"))
    two = sets.select(F.col("digest").alias("y"), F.col("orders").alias("oy"), F.col("n_shingles").alias("ny"))
    both = pairs.join(one, "x").join(two, "y").filter(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
    return both.select("x", "y", "ox", "oy").mapInArrow(tidy(run), "x binary, y binary")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, counted on the whole sets. pairs: (x, y), x in few pairs; full: (digest, shingles)."""
    one = full.select(F.col("digest").alias("x"), F.col("shingles").alias("sx"))
    two = full.select(F.col("digest").alias("y"), F.col("shingles").alias("sy"))
    common = F.size(F.array_intersect("sx", "sy")).cast("long")
    near = pairs.join(one, "x").join(two, "y").filter(common * 100 >= (F.size("sx") + F.size("sy") - common) * percent)
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(digest, comp): for each end of an edge (a, b), a digest that stands for all it reaches. In each round nodes go to their least neighbour, the rest of the graph contracts."""
    label, edges = None, cut(edges.select("a", "b").distinct())
    while label is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("digest")).agg(F.min("b").alias("b")).select("digest", F.least("digest", "b").alias("comp")))
        next_ = least.select(F.col("digest").alias("comp"), F.col("comp").alias("to"))
        to = cut(least.join(next_, "comp").select("digest", F.col("to").alias("comp")))
        into = to.select(F.col("digest").alias("comp"), F.col("comp").alias("to"))
        label = to if label is None else cut(label.join(into, "comp", "left").select("digest", F.coalesce("to", "comp").alias("comp")))
        ends = [to.select(F.col("digest").alias(x), F.col("comp").alias(f"to_{x}")) for x in "ab"]
        edges = cut(edges.join(ends[0], "a").join(ends[1], "b").filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    return label


def forest(links: Iterator[tuple[int, int]], n: int) -> list[int]:
    """The places of those links that join what earlier ones have not joined."""
    root, kept = list(range(n)), []

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for i, (a, b) in enumerate(links):
        a, b = top(a), top(b)
        if a != b:
            root[a] = b
            kept.append(i)
    return kept


def alike(orders: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets left x right may be linked, by their signatures (rows of orders) and sizes n."""
    same = np.zeros((len(left), len(right)), np.int16)
    for k in range(orders.shape[1]):
        same += orders[left, k][:, None] == orders[right, k][None]
    few, many = np.minimum(n[left][:, None], n[right][None]), np.maximum(n[left][:, None], n[right][None])
    return (same >= agreeing(percent, orders.shape[1])) & (few * 100 >= many * percent)


def crossing(own: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(x, y): the pairs of different components in regions of up to REGION sets that signatures don't rule out. own: (region, digest, comp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(i, 64) for batch in batches for i in range(0, batch.num_rows, 64)):
            found: tuple[list, list] = ([], [])
            for group in b.column(0).to_pylist():
                orders = np.frombuffer(b"".join(g["orders"] for g in group), np.uint16).reshape(len(group), -1)
                comp, every = numbered([g["comp"] for g in group])[0], np.arange(len(group))
                near = alike(orders, np.array([g["n_shingles"] for g in group]), every, every, percent) & (comp[:, None] < comp[None])
                for i, j in np.argwhere(near):
                    found[0].append(group[i]["digest"])
                    found[1].append(group[j]["digest"])
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()) for f in found], names=["x", "y"])

    groups = own.join(sets.select("digest", "orders", "n_shingles"), "digest").groupBy("region").agg(F.collect_list(F.struct("digest", "comp", "orders", "n_shingles")).alias("m"))
    return groups.select("m").mapInArrow(tidy(run), "x binary, y binary").distinct()


def dealt(own: DataFrame) -> DataFrame:
    """(digest, comp, block): blocks of about BLOCK sets, of one component or of several small ones. own: (region, n, digest, comp)."""
    one = cut(own.groupBy("digest").agg(F.first("comp").alias("comp"), F.max_by("region", F.struct("n", "region")).alias("place")))
    counted = one.groupBy("place", "comp").agg(F.count("*").alias("c"))
    rest = counted.groupBy("place").agg(F.sum(F.when(F.col("c") < BLOCK, F.col("c"))).alias("r"))
    sizes = cut(counted.join(rest, "place"))
    block = F.when(F.col("c") >= BLOCK, F.xxhash64("place", "comp", F.pmod(F.xxhash64("digest"), F.ceil(F.col("c") / BLOCK)))).otherwise(F.xxhash64("place", F.pmod(F.xxhash64("comp"), F.ceil(F.col("r") / BLOCK))))
    return cut(one.join(sizes, ["place", "comp"]).select("digest", "comp", block.alias("block")))


def facing(t: pa.Table, percent: int) -> pa.Table:
    """(x, y, block, digest, comp): the sets of block x and block y that signatures don't rule out as linked across components. t: (x, y, block, members), one or two rows."""
    rows = t.to_pylist()
    one, two = rows[0], rows[-1]
    members = one["members"] if one is two else one["members"] + two["members"]
    blocks = np.array([one["block"]] * len(one["members"]) + [two["block"]] * (len(members) - len(one["members"])))
    comp = numbered([m["comp"] for m in members])[0]
    left, right = np.flatnonzero(blocks == one["x"]), np.flatnonzero(blocks == one["y"])
    orders = np.frombuffer(b"".join(m["orders"] for m in members), np.uint16).reshape(len(members), -1)
    near = alike(orders, np.array([m["n_shingles"] for m in members]), left, right, percent) & (comp[left][:, None] != comp[right][None])
    own = np.unique(np.concatenate([left[near.any(axis=1)], right[near.any(axis=0)]]))
    return pa.table({"x": pa.array([one["x"]] * len(own), pa.int64()), "y": pa.array([one["y"]] * len(own), pa.int64()), "block": pa.array(blocks[own]), **{c: pa.array([members[i][c] for i in own], pa.binary()) for c in ("digest", "comp")}})


def joining(t: pa.Table, percent: int) -> pa.Table:
    """(a, b): links between components, as a forest, of the sets of block x with those of block y, on full sets. t: (x, y, block, digest, comp, shingles)."""
    t = t.combine_chunks()
    lists, digests = t["shingles"].combine_chunks(), t["digest"].to_pylist()
    n, blocks, (comp, names) = lists.value_lengths().to_numpy().astype(np.int64), t["block"].to_numpy(), numbered(t["comp"].to_pylist())
    left, right = (np.flatnonzero(blocks == t[c][0].as_py()) for c in ("x", "y"))
    _, at, times = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(n)), n), times > 1  # what one set has alone is in no intersection
    number = np.cumsum(shared) - 1
    row, at = row[shared[at]], number[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2^24
    for k in range(0, int(shared.sum()), 2048):
        part = slice(*np.searchsorted(at, (k, k + 2048)))
        has = np.zeros((len(n), 2048), np.float32)
        has[row[part], at[part] - k] = 1
        common += has[left] @ has[right].T
    both = common.astype(np.int64)
    near = np.argwhere((both * 100 >= (n[left][:, None] + n[right][None] - both) * percent) & (comp[left][:, None] != comp[right][None]))
    links = [sorted((digests[left[near[i, 0]]], digests[right[near[i, 1]]])) for i in forest(((int(comp[left[i]]), int(comp[right[j]])) for i, j in near), len(names))]
    return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})


def hot_links(own: DataFrame, docs: DataFrame, sets: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(a, b): links between components in regions of more than REGION sets. own: (region, n, digest, comp)."""
    seats = dealt(own)
    touch = cut(own.select("region", "digest").join(seats, "digest").groupBy("region", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    x, y = touch.select("region", F.col("block").alias("x"), F.col("lo").alias("lx"), F.col("hi").alias("hx")), touch.select("region", F.col("block").alias("y"), F.col("lo").alias("ly"), F.col("hi").alias("hy"))
    meeting = cut(x.join(y, "region").filter("x <= y AND least(lx, ly) <> greatest(hx, hy)").select("x", "y").distinct())
    blocks = cut(seats.join(sets.select("digest", "orders", "n_shingles"), "digest").groupBy("block").agg(F.collect_list(F.struct("digest", "comp", "orders", "n_shingles")).alias("members")))
    sides = meeting.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block")).join(blocks, "block")
    maybe = cut(sides.select("x", "y", "block", "members").groupBy("x", "y").applyInArrow(lambda t: facing(t, percent), "x long, y long, block long, digest binary, comp binary"))
    full = fetched(docs, sets, maybe.select("digest"), words)
    return maybe.join(full, "digest").select("x", "y", "block", "digest", "comp", "shingles").groupBy("x", "y").applyInArrow(lambda t: joining(t, percent), "a binary, b binary")


def classes(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, kept), one row per row of docs."""
    rows = cut(signed(docs, words))
    sets = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max(F.col("doc_id").isNull()).alias("nameless"), F.first("orders").alias("orders"), F.first("n_shingles").alias("n_shingles"))
    sets = cut(sets)
    member = placed(sets, shallow(percent))
    pairs = cut(screened(cut(neighbours(member)), sets, percent))
    sure = cut(confirmed(pairs, fetched(docs, sets, pairs.select(F.explode(F.array("x", "y")).alias("digest")), words), percent))
    label = components(sure)
    each = member.select("digest", F.explode("places").alias("p")).select("digest", "p.region", "p.n").join(label, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    each = cut(each)
    split = cut(each.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("region"))
    own = cut(each.join(split, "region"))
    discard(each, split, member)
    few = cut(crossing(own.filter(F.col("n") <= REGION), sets, percent))
    more = cut(confirmed(few, fetched(docs, sets, few.select(F.explode(F.array("x", "y")).alias("digest")), words), percent))
    hot = own.filter(F.col("n") > REGION)
    links = sure.unionByName(more)
    if not hot.isEmpty():
        links = links.unionByName(cut(hot_links(hot, docs, sets, percent, words)))
    final = components(links)
    named = sets.select("digest", "rep", "nameless").join(final, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component"), F.max("nameless").alias("nameless"))
    ids = named.select("digest", "comp").join(least, "comp").select("digest", F.when(~F.col("nameless"), F.col("component")).alias("component"), F.lit(True).alias("found"))
    all_rows = rows.select("doc_id", "mark", "n_shingles", "digest").join(ids, "digest", "left").withColumn("component_id", F.when(F.col("found"), F.col("component")).otherwise(F.col("doc_id")))
    return all_rows.select("doc_id", "mark", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs."""
    return classes(docs, percent, words).drop("mark")


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without those that a document with a smaller doc_id stands for. Rows of one doc_id with different texts are judged each."""
    lost = cut(classes(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__lost"), F.col("mark").alias("__mark")).distinct())
    return docs.join(hinted(lost), F.col("doc_id").cast("long").eqNullSafe(F.col("__lost")) & (marked("text") == F.col("__mark")), "left_anti")


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(ws) >= {WORDS} THEN list_transform(range(1, len(ws) - {WORDS} + 2), lambda i: array_to_string(ws[i:i + {WORDS} - 1], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid, rid AS other FROM d UNION SELECT r.rid, e.y FROM r JOIN e ON r.other = e.x),
c AS (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN d o ON o.rid = r.other GROUP BY r.rid)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c ON c.rid = d.rid LEFT JOIN n ON n.rid = d.rid"""
