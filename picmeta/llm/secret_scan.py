"""Secret scans: patterns, and the cost of guessing what stands where credentials stand.

The base finds secrets by form: values assigned to a credential's name, access
keys, long hexadecimal runs. The method adds what has no such form: every value
in a credential's context (a wider list of names, "is" and ":=" as well as ":"
and "=", bearer tokens, the password of an address with user and password) gets
the least cost, in powers of ten, of guessing it. A dynamic program finds the
cheapest segmentation into

* words of a public vocabulary: the rank, times 2 for each odd case or letter
  written as a digit or sign;
* dates and years: days times years;
* repeats of a block of up to BLOCK characters: the block's own cost and the
  count; only runs that can't be made longer, from each place of their first block;
* walks over neighbouring keys, of three keys or more: the first key, and a
  choice among its neighbours at each turn;
* brute force: the size of the value's alphabet for each character.

Each segment costs KIND more, the choice of its kind. Words end with the longest
word of the vocabulary, dates are short, and walks and brute force go on from one
character to the next, so the program is linear in the value's length.

Values that cost GUESSES or more, and PER_CHAR or more for each character (so
phrases of plain words aren't secrets, nor placeholders), are spans of the kind
`guess`, unless they lie inside a span of the base. A span of the base is the whole
match, name included; that of a guess is the value.

Null and empty texts have no secrets. Rows are scanned one by one: ties, repeated
rows, null ids and an empty table need nothing. Texts and values of any length are
read whole. Other columns pass through, but for one named secrets, which the
result replaces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from picmeta.llm.lattice import MARK, default_path
from picmeta.llm.shared import raw, slices

KINDS = ("assign", "access", "hex", "guess")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
GUESSES = 10.0
PER_CHAR = 1.2
KIND = math.log10(5)
BLOCK = 8
NAMES = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|api[_-]?key|access[_-]?key|private[_-]?key)"
SAID = rf"{NAMES}[\"']?(?: *(?::=|=>|[:=]) *| +(?:is|was) +)[\"']?([^\s\"'<>,;]+)"
BEARER = r"bearer +([^\s\"'<>,;]+)"
ADDRESS = r"://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@"
AFTER = ".:!?)]}"  # at the end of a value: of the sentence
YEARS = (1900, 2099)
DATES = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|[12]\d|3[01])\2(?:19|20)?\d\d|(?:19|20)\d\d)(?!\d)")
KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!$57", "aaeoiisst")


def _places() -> dict[str, tuple[int, int]]:
    shifted = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./", strict=True))
    at = {c: (2 * i + (0, 3, 4, 5)[r], r) for r, row in enumerate(KEYS) for i, c in enumerate(row)}  # in halves of a key
    at |= {c.upper(): p for c, p in at.items() if c.isalpha()}
    return at | {c: at[k] for c, k in shifted.items()}


PLACES = _places()
FIRST_KEY, TURN = math.log10(len(PLACES) / 2), math.log10(6)


def step(a: str, b: str) -> tuple[int, int] | None:
    """The direction from a key to a neighbouring one; None if they aren't neighbours."""
    if a not in PLACES or b not in PLACES:
        return None
    (x, y), (p, q) = PLACES[a], PLACES[b]
    d = (p - x, q - y)
    return d if d in ((2, 0), (-2, 0)) or (abs(d[1]) == 1 and abs(d[0]) <= 2 and d != (0, 0)) else None


def ranked_words(path: str | None = None) -> dict[str, float]:
    """word: the log10 of its rank in a public vocabulary; letters only, three or more, in lower case."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    found: dict[str, float] = {}
    order = sorted(range(sp.get_piece_size()), key=lambda i: -sp.get_score(i))
    for i in order:
        w = sp.id_to_piece(i)
        if w.startswith(MARK) and len(w) > 3 and (w := w[1:].lower()).isalpha() and w not in found:
            found[w] = math.log10(len(found) + 1)
    return found


def alphabet(value: str) -> float:
    """The log10 of the number of characters of the kinds that value has."""
    size = 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 10 * any("0" <= c <= "9" for c in value)
    size += 33 * any(c.isascii() and not c.isalnum() for c in value) + 100 * (not value.isascii())
    return math.log10(max(size, 10))


def word_cost(part: str, ranks: dict[str, float]) -> float | None:
    """The cost of part as one word; None if it is none."""
    low = part.lower()
    plain = ranks.get(low)
    odd = 0
    if plain is None:
        turned = low.translate(LEET)
        plain = ranks.get(turned) if turned != low else None
        if plain is None:
            return None
        odd = sum(a != b for a, b in zip(low, turned, strict=True))
    upper = sum(c.isupper() for c in part)
    if upper:
        odd += 1 if part[0].isupper() and upper == 1 or part.isupper() else min(upper, len(part) - upper) + 1
    return plain + odd * math.log10(2)


def date_cost(part: str) -> float:
    year = next((int(y) for y in re.findall(r"(?:19|20)\d\d", part)), 2000)
    years = math.log10(max(abs(year - 2000), 20))
    return years if len(part) == 4 and part.isdigit() else math.log10(366) + years + (math.log10(4) if not part.isdigit() else 0)


def repeats(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, block) of the longest runs of each block length, from each place of their first block."""
    n = len(value)
    for p in range(1, min(BLOCK, n // 2) + 1):
        at = 0
        while at + p < n:
            end = at + p
            while end < n and value[end] == value[end - p]:
                end += 1
            for i in range(at, min(at + p, end)):
                times = (end - i) // p
                if times > 1 and times * p > 2:
                    yield i, i + times * p, p
            at = end - p + 1


def guess_cost(value: str, ranks: dict[str, float], longest: int | None = None, again: bool = True) -> float:
    """The log10 of the guesses that the cheapest segmentation of value takes; again: whether repeats count."""
    n, longest = len(value), longest or max(map(len, ranks), default=0)
    inf, each = math.inf, alphabet(value)
    best = [0.0] + [inf] * n
    spans: dict[int, list[tuple[int, float]]] = {}  # by end
    for i, c in enumerate(value):
        if "0" <= c <= "9" and (m := DATES.match(value, i)):
            spans.setdefault(m.end(), []).append((i, date_cost(m[0])))
    if again:
        for i, j, p in repeats(value):
            spans.setdefault(j, []).append((i, guess_cost(value[i : i + p], ranks, longest, False) + math.log10((j - i) // p)))
    forced = walk2 = walk3 = inf  # brute force, a walk of two keys, of more
    before = None
    for j in range(1, n + 1):
        forced = min(forced, best[j - 1] + KIND) + each
        now = step(value[j - 2], value[j - 1]) if j > 1 else None
        if now is None:
            walk2 = walk3 = inf
        else:
            turn = 0 if now == before else TURN
            walk3 = min(walk3, walk2) + turn
            walk2 = best[j - 2] + KIND + FIRST_KEY + TURN
        before = now
        cost = min(forced, walk3)
        for i in range(max(0, j - longest), j - 2):
            if best[i] < cost and (w := word_cost(value[i:j], ranks)) is not None:
                cost = min(cost, best[i] + KIND + w)
        for i, c in spans.get(j, ()):
            cost = min(cost, best[i] + KIND + c)
        best[j] = cost
    return best[n]


class Scanner:
    """Spans (kind, start, end, cost) of texts, in order of start and kind."""

    def __init__(self, ranks: dict[str, float]):
        self.ranks, self.longest = ranks, max(map(len, ranks), default=0)
        self.assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
        self.access = re.compile(rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}")
        self.hex = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
        self.contexts = [re.compile(p) for p in (SAID, BEARER, ADDRESS)]

    def base(self, text: str, low: str) -> list[tuple[str, int, int]]:
        found = [("assign", m.start(), m.end()) for m in self.assign.finditer(low) if m.end(2) - m.start(2) >= LEAST_VALUE]
        found += [("access", m.start(), m.end()) for m in self.access.finditer(text)]
        return found + [("hex", m.start(), m.end()) for m in self.hex.finditer(text)]

    def values(self, text: str, low: str) -> set[tuple[int, int]]:
        """Where values stand in credentials' contexts."""
        found = set()
        for pattern in self.contexts:
            for m in pattern.finditer(low):
                s, e = m.span(1)
                e = s + len(text[s:e].rstrip(AFTER))
                if e - s >= LEAST_VALUE:
                    found.add((s, e))
        return found

    def __call__(self, raw_text: bytes | None) -> tuple[list[tuple[str, int, int, float | None]], float | None]:
        """The spans, and the highest cost of a value in a credential's context."""
        if not raw_text:
            return [], None
        text, low = raw_text.decode("utf-8", "replace"), raw_text.lower().decode("utf-8", "replace")
        found: list[tuple[str, int, int, float | None]] = [(*x, None) for x in self.base(text, low)]
        base, most = [(s, e) for _, s, e, _ in found], None
        for s, e in self.values(text, low):
            cost = guess_cost(text[s:e], self.ranks, self.longest)
            most = cost if most is None else max(most, cost)
            if cost >= GUESSES and cost >= PER_CHAR * (e - s) and not any(a <= s and e <= b for a, b in base):
                found.append(("guess", s, e, cost))
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2])), most


SPAN = StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType()).add("log10_guesses", DoubleType())


def secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of docs, then secrets (array of spans) and most_guesses; clashing columns are replaced."""
    docs = docs.drop("secrets", "most_guesses")
    shared = docs.sparkSession.sparkContext.broadcast(ranked_words(path))  # the vocabulary's size
    schema = StructType(list(docs.schema.fields)).add("secrets", ArrayType(SPAN)).add("most_guesses", DoubleType())
    at = docs.columns.index("text")
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(shared.value)
        for batch in batches:
            for b in slices(batch, at):
                rows = [scan(t) for t in raw(b.column(at).cast(pa.string()))]
                spans = pa.array([[dict(zip(item.names, s, strict=True)) for s in found] for found, _ in rows], pa.list_(item))
                yield pa.RecordBatch.from_arrays([*b.columns, spans, pa.array([m for _, m in rows], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, most_guesses)"""

    def n(kind: str):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    found = secrets(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    base = F.filter("secrets", lambda x: x["kind"] != "guess")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), n("guess").alias("n_guess"), F.round("most_guesses", 6).alias("most_guesses"))


def base(digested: DataFrame) -> DataFrame:
    """What SQL can express of the digest."""
    return digested.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _found_sql(kind: str, pattern: str, group: int, least: int) -> str:
    """Matches with their places: between two matches lies one piece of the split text."""
    return f"SELECT rid, '{kind}' AS kind, {KINDS.index(kind)} AS k, len_before AS s, len_before + length(m) AS e FROM (SELECT rid, m, v, sum(length(piece)) OVER w + sum(length(m)) OVER w - length(m) AS len_before FROM (SELECT rid, i, piece, m, v FROM (SELECT rid, unnest(range(1, len(ms) + 1)) AS i, unnest(ps[1:len(ms)]) AS piece, unnest(ms) AS m, unnest(vs) AS v FROM (SELECT rid, regexp_split_to_array(t, '{pattern}') AS ps, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs FROM d))) WINDOW w AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE length(v) >= {least}"


_NAMES = "|".join("".join("_?" if c == "_" else f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
_ASSIGN = rf"({_NAMES})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"  # within quotes of SQL
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_found_sql("assign", _ASSIGN, 2, LEAST_VALUE)} UNION ALL {_found_sql("access", "(AKIA[A-Z0-9]+)", 1, LEAST_ACCESS)} UNION ALL {_found_sql("hex", "([0-9a-f]+)", 1, LEAST_HEX)})
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (kind = 'access')::BIGINT AS n_access, count(*) FILTER (kind = 'hex')::BIGINT AS n_hex, sha256(coalesce(string_agg(concat(kind, ':', s::BIGINT, ':', e::BIGINT), ',' ORDER BY s, k) FILTER (kind IS NOT NULL), '')) AS base_sha256
FROM d LEFT JOIN f USING (rid) GROUP BY rid"""
