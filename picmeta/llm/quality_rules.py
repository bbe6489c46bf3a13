"""Quality rules whose thresholds adapt to each language and source.

The fixed cutoffs of rule lists (mean word length between 3 and 10, at most a
tenth of symbols, ...) are replaced by fences that come from the corpus itself:

1. one pass measures every text (`measure`);
2. a mergeable quantile sketch per (lang, source, signal): counts of buckets
   with 6 significant bits, i.e. a relative error below 1/64. Sketches merge by
   adding counts, so partial sums on the map side, per-source sketches, and the
   roll-ups to language and to the whole corpus are the same operation;
3. fences from the sketches: `outer + REACH * (outer - median) + slack` above
   and the mirror image below, where outer is the upper (lower) quartile, so that
   junk moves a fence only if it is a quarter of a group. To a group's sketch its
   language's is added with the weight of PRIOR texts, and to a language's that
   of the corpus: small groups lean on what is known of others, without a jump;
4. the measurements joined with the fences of their group, null-safe.

Null text: all counts 0, base_failed. Null lang or source: a group of its own.
Repeated rows are measured and returned once each. An empty table gives an
empty result. Columns other than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from picmeta.llm.shared import cut, numbered, raw, slices

SYMBOLS = b"#*$%&|<>"
REACH = 3
PRIOR = 200
UNIT = 64  # sketches are added in this part of a text
SLICE = 1 << 20
MEASURED = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"

#: signal -> (numerator, denominator, scale, slack in scaled units, has a lower fence)
SIGNALS = {
    "word_length": ("word_chars", "n_words", 1000, 1500, True),
    "symbols": ("n_symbols", "n_words", 1000, 600, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 400, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 200, False),
}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has at least twice."""
    if len(words) < 4:
        return 0
    at, distinct = numbered(words)
    pair = np.unique(at[:-1] * len(distinct) + at[1:], return_inverse=True)[1]
    _, window, times = np.unique(pair[:-1] * len(distinct) + at[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= again
    return int(inside.sum())


def signals_of(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measure(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 3, SLICE):
                rows = [signals_of(t) for t in raw(b.column(3))]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, pa.int64()) for c in cols)], names=[x.split()[0] for x in MEASURED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, MEASURED)


def scaled(name: str) -> Column:
    num, den, scale, _, _ = SIGNALS[name]
    return F.when(F.col(den) > 0, F.expr(f"({num} * {scale}) div {den}")).otherwise(F.lit(0))


def bucket(v: Column) -> Column:
    """The lower end of v's bucket: its 6 leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, signal, bucket, n) of the texts that pass the base rules."""
    pairs = F.array(*(F.struct(F.lit(s).alias("signal"), bucket(scaled(s)).alias("bucket")) for s in SIGNALS))
    return measured.filter(~base_failed()).select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.signal", "p.bucket").agg(F.count("*").alias("n"))


def leaning(sk: DataFrame, by: list[str], parent: DataFrame, on: list[str]) -> DataFrame:
    """(by..., signal, bucket, n): the sketches of the groups, in UNITs, each with its parent's (on..., signal, bucket, n) of the weight of PRIOR texts added."""
    own = sk.groupBy(*by, "signal", "bucket").agg((F.sum("n") * UNIT).alias("n"))
    total = parent.groupBy(*on, "signal").agg(F.sum("n").alias("total"))
    renamed = {c: f"p_{c}" for c in [*on, "signal"]}
    same = F.col("signal") == F.col("p_signal")
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    share = parent.withColumnsRenamed(renamed)
    whole = total.withColumnsRenamed({c: f"t_{c}" for c in [*on, "signal"]})
    both = F.col("p_signal") == F.col("t_signal")
    for c in on:
        both = both & F.col(f"p_{c}").eqNullSafe(F.col(f"t_{c}"))
    share = share.join(whole, both).select(*renamed.values(), "bucket", F.expr(f"(n * {PRIOR * UNIT}) div total").alias("n"))
    lent = own.select(*by, "signal").distinct().join(share, same).select(*by, "signal", "bucket", "n")
    return own.unionByName(lent).groupBy(*by, "signal", "bucket").agg(F.sum("n").alias("n"))


def fences(merged: DataFrame, by: list[str]) -> DataFrame:
    """(by..., signal, low, high) of the sketches of each group of `by`."""
    group = Window.partitionBy(*by, "signal")
    run = merged.withColumn("cum", F.sum("n").over(group.orderBy("bucket"))).withColumn("docs", F.sum("n").over(group))

    def at(percent: int) -> Column:
        return F.min(F.when(F.col("cum") * 100 >= F.col("docs") * percent, F.col("bucket")))

    q = run.groupBy(*by, "signal").agg(at(25).alias("lower"), at(50).alias("median"), at(75).alias("upper"))
    slack = F.element_at(F.create_map(*(F.lit(x) for s in SIGNALS for x in (s, SIGNALS[s][3]))), F.col("signal"))
    return q.select(*by, "signal", (F.col("lower") - REACH * (F.col("median") - F.col("lower")) - slack).alias("low"), (F.col("upper") + REACH * (F.col("upper") - F.col("median")) + slack).alias("high"))


def thresholds(sk: DataFrame) -> DataFrame:
    """One row per (lang, source): the fences of the SIGNALS, and the texts of the group's own sketch."""
    sk = cut(sk)
    corpus = sk.groupBy("signal", "bucket").agg((F.sum("n") * UNIT).alias("n"))
    lang = cut(leaning(sk, ["lang"], corpus, []))
    own = fences(leaning(sk, ["lang", "source"], lang, ["lang"]), ["lang", "source"])
    docs = sk.filter(F.col("signal") == next(iter(SIGNALS))).groupBy(F.col("lang").alias("d_lang"), F.col("source").alias("d_source")).agg(F.sum("n").alias("group_docs"))
    wide = own.groupBy("lang", "source").agg(*(F.max(F.when(F.col("signal") == s, F.col(x))).alias(f"{x[0]}_{s}") for s in SIGNALS for x in ("low", "high")))
    return wide.join(docs, F.col("lang").eqNullSafe(F.col("d_lang")) & F.col("source").eqNullSafe(F.col("d_source"))).drop("d_lang", "d_source")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def verdict() -> Column:
    ok = F.lit(True)
    for s, (*_, lower) in SIGNALS.items():
        ok = ok & (scaled(s) <= F.col(f"h_{s}"))
        ok = ok & (scaled(s) >= F.col(f"l_{s}")) if lower else ok
    return ~F.col("base_failed") & F.coalesce(ok, F.lit(True))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, base_failed, kept, and the number of texts in the sketch of the text's own group."""
    m = cut(measure(docs))
    t = thresholds(sketch(m)).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    judged = m.withColumn("base_failed", base_failed()).join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict().alias("kept"), F.coalesce("group_docs", F.lit(0)).cast("long").alias("group_docs"))


def _leaning_sql(name: str, by: list[str], parent: str, on: list[str]) -> str:
    """SQL of `leaning`."""
    cols, same = "".join(f"{c}, " for c in by), "".join(f" AND g.{c} IS NOT DISTINCT FROM p.{c}" for c in on)
    over = "".join(f"{c}, " for c in on)
    return f"""{name}_o AS (SELECT {cols}signal, bucket, sum(n)::BIGINT * {UNIT} AS n FROM sk GROUP BY {cols}signal, bucket),
{name}_p AS (SELECT {over}signal, bucket, (n * {PRIOR * UNIT}) // (sum(n) OVER (PARTITION BY {over}signal))::BIGINT AS n FROM {parent}),
{name} AS (SELECT {cols}signal, bucket, sum(n)::BIGINT AS n FROM (SELECT * FROM {name}_o UNION ALL SELECT {"".join(f"g.{c}, " for c in by)}g.signal, p.bucket, p.n FROM (SELECT DISTINCT {cols}signal FROM {name}_o) g JOIN {name}_p p ON g.signal = p.signal{same}) GROUP BY {cols}signal, bucket)"""


def oracle() -> str:
    ratio = {s: f"(CASE WHEN {v[1]} > 0 THEN ({v[0]} * {v[2]}) // {v[1]} ELSE 0 END)" for s, v in SIGNALS.items()}
    slack = " ".join(f"WHEN '{s}' THEN {v[3]}" for s, v in SIGNALS.items())
    judge = " AND ".join(f"{ratio[s]} <= h_{s}" + (f" AND {ratio[s]} >= l_{s}" if v[4] else "") for s, v in SIGNALS.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM tri) WHERE k > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
m AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
v AS (SELECT lang, source, signal, x, greatest(length(bin(x)) - 6, 0)::INTEGER AS s FROM (
  {" UNION ALL ".join(f"SELECT lang, source, '{s}' AS signal, {r}::BIGINT AS x FROM b WHERE NOT base_failed" for s, r in ratio.items())})),
sk AS (SELECT lang, source, signal, (x >> s) << s AS bucket, count(*) AS n FROM v GROUP BY ALL),
corp AS (SELECT signal, bucket, sum(n)::BIGINT * {UNIT} AS n FROM sk GROUP BY signal, bucket),
{_leaning_sql("lng", ["lang"], "corp", [])},
{_leaning_sql("own", ["lang", "source"], "lng", ["lang"])},
run AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, signal ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY lang, source, signal) AS docs FROM own),
q AS (SELECT lang, source, signal, min(CASE WHEN cum * 100 >= docs * 25 THEN bucket END) AS q1, min(CASE WHEN cum * 100 >= docs * 50 THEN bucket END) AS q2, min(CASE WHEN cum * 100 >= docs * 75 THEN bucket END) AS q3 FROM run GROUP BY lang, source, signal),
f AS (SELECT lang, source, signal, q1 - {REACH} * (q2 - q1) - (CASE signal {slack} END) AS low, q3 + {REACH} * (q3 - q2) + (CASE signal {slack} END) AS high FROM q),
n AS (SELECT lang, source, sum(n)::BIGINT AS group_docs FROM sk WHERE signal = '{next(iter(SIGNALS))}' GROUP BY lang, source),
t AS (SELECT f.lang, f.source, any_value(n.group_docs) AS group_docs, {", ".join(f"max(CASE WHEN f.signal = '{s}' THEN {x} END) AS {x[0]}_{s}" for s in SIGNALS for x in ("low", "high"))} FROM f JOIN n ON f.lang IS NOT DISTINCT FROM n.lang AND f.source IS NOT DISTINCT FROM n.source GROUP BY f.lang, f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce({judge}, TRUE)) AS kept, coalesce(group_docs, 0)::BIGINT AS group_docs
FROM b LEFT JOIN t ON b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source"""
