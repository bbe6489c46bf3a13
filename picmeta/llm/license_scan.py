"""Licence scans by a trained paragraph classifier. DataFrame functions and Spark ML only.

1. `train` fits a sparse (elastic net) multinomial logistic regression on word
   uni- and bigrams. Families are taught by statements made from FRAMES and NAMES
   and by notices; the class `unknown` by plain sentences that use licence words
   and by NEGATIVES distinct paragraphs of the corpus (those lowest by hash) that
   no template matches. That number is the bound of the sample.
2. The unknown class is calibrated on all paragraphs that no template matches: a
   family is believed from the probability (in thousandths) that all but FALSE of
   them stay below. A template has to confirm in any case.
3. A paragraph (line) can only leave `unknown` if it has an n-gram with a weight
   for a family above that for unknown. Such n-grams' rarest words are the
   anchors; paragraphs without an anchor are unknown and aren't scored further.
   This drops no paragraph that the model would accept. Anchors are looked for in
   the text itself, before it is cut into words.
4. A predicted family is confirmed by a template: CONFIRM of a template's bigrams
   stand in the paragraph. Every other family is found too if its odds against
   unknown pass the threshold and a whole template stands there.
5. Wrapped notices: the last SPAN words up to a line's end and the first SPAN words
   after it are judged like a line (`wrapped`), where no line without words lies
   between. SPAN is the longest template's length, so a template lies whole in one
   of these pieces, however short the lines are. A family found there counts for
   the line before the break, once for each run of breaks, and only if no line in
   reach has it by itself. Breaks don't calibrate, so only those that a template
   confirms are scored, and they are only looked for in texts with a sign: CONFIRM
   of a template's bigrams leave out few, so one of its (few + 1) rarest, its signs,
   stands in all that it confirms.

Rows are told apart by doc_id and a hash of the text (mark): rows that repeat
both are scanned once and get the same result each. Null and empty texts have no
paragraphs. Lines without a word aren't paragraphs. An empty table gives an empty
result; the model is then fitted on the statements alone. Other columns are
ignored. The input must be re-readable.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from picmeta.llm.shared import cut, hinted

NEGATIVES = 2000
VOCABULARY = 20_000
FALSE = 0.001
STEPS = 1000  # of the threshold
CONFIRM = 0.7
UNKNOWN = "unknown"

#: How each family is named.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL", "AGPL-3.0"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0"],
    "bsd": ["BSD License", "3-Clause BSD License", "2-Clause BSD License", "BSD-3-Clause"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License", "CC BY 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"],
    "cc0": ["CC0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero License"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GPL", "GPLv3", "GPL-2.0"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL", "LGPL-2.1"],
    "mit": ["MIT License", "MIT Licence", "Expat License"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, Version 2.0", "MPL 2.0", "MPL-2.0"],
}
FRAMES = [
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This project is made available under the terms of the {}.",
    "The code is distributed under the {}; see the file LICENSE.", "You may use it under the terms of the {}.", "License: {}", "Published under {}", "This file is subject to the {}.", "SPDX-License-Identifier: {}", "All content here is shared under a {}.",
]
#: Sentences of the families' own notices.
NOTICES = {
    "agpl": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "gpl": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License. If a copy of the MPL was not distributed with this file"],
}
#: Licence words in sentences that license nothing.
PLAIN = [
    "The driver showed his license to the officer.", "She has a license to teach and a fishing licence.", "The work was released under great pressure.", "Apache helicopters flew over the valley.", "He studied physics at MIT for four years.",
    "The public was granted permission to enter the garden.", "Version 2.0 of the report is available.", "Version 3 of the plan is out.", "The general public was not informed.", "Creative people share a common goal.", "The gnu is a large animal of the plain.",
    "Attribution of the painting is not certain.", "The terms of the contract were made available.", "The file is subject to change.", "This project is made for you.", "All content here is new.", "The code is distributed to all members.", "You may use it under the table.",
    "Redistribution of wealth was the topic of the day.", "Free software is a matter of liberty.", "The foundation published the letters.", "A copy of this letter was sent to any person who asked.", "The common market was created in spring.", "Published under a pen name", "This work is done.",
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def bigrams(own: Column) -> Column:
    return F.zip_with(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def featured(rows: DataFrame) -> DataFrame:
    """rows with grams of their column words."""
    return rows.withColumn("pairs", F.array_distinct(bigrams(F.col("words")))).withColumn("grams", F.concat(F.array_distinct("words"), "pairs"))


def templates() -> dict[str, list[str]]:
    return {f: [*names, *NOTICES.get(f, ())] for f, names in NAMES.items()}


def fixed(values: list) -> Column:
    """An array literal; arrays inside stay arrays."""
    return F.array(*(fixed(v) if isinstance(v, list) else F.lit(v) for v in values))


def template_bigrams() -> dict[str, list[list[str]]]:
    out = {}
    for family, texts in templates().items():
        own = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
        out[family] = [[f"{a} {b}" for a, b in zip(w, w[1:])] or w for w in own]
    return out


SPAN = max(len(re.findall("[a-z0-9]+", t.lower())) for texts in templates().values() for t in texts)


def likeness(family: str, grams: str = "grams") -> Column:
    """The largest share of a template's n-grams (bigrams, or its only word) that stand in grams."""
    return F.greatest(F.lit(0.0), *(F.size(F.array_intersect(F.col(grams), fixed(t))) / len(set(t)) for t in template_bigrams()[family]))


def likenesses(grams: str = "grams") -> Column:
    """The likeness to each of NAMES. grams: those that stand in a template; most paragraphs have none."""
    return F.when(F.size(grams) == 0, fixed([0.0] * len(NAMES))).otherwise(F.array(*(likeness(f, grams) for f in NAMES)))


def in_templates() -> Column:
    """What of grams stands in any template, found by one look each."""
    every = sorted({g for ts in template_bigrams().values() for t in ts for g in t})
    return F.filter("grams", lambda g: g.isin(every))


def spelled(grams: list[str]) -> str:
    """A pattern for lower-cased texts, a space before them, that have any of grams (words of a-z and 0-9 with a space between). Common beginnings are tried once, and first letters by halves."""
    tree: dict = {}
    for g in grams:
        at = tree
        for c in g:
            at = at.setdefault(c, {})
        at[""] = {}

    def below(at: dict) -> str:
        ways = [("[^a-z0-9]+" if c == " " else c) + below(rest) if c else "(?![a-z0-9])" for c, rest in sorted(at.items(), reverse=True)]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    def begun(firsts: list[str]) -> str:
        if len(firsts) < 4:
            return "|".join(c + below(tree[c]) for c in firsts)
        half = len(firsts) // 2
        return "|".join(f"(?=[{''.join(own)}])(?:{begun(own)})" for own in (firsts[:half], firsts[half:]))

    return f"[^a-z0-9](?:{begun(sorted(tree))})" if grams else "(?!)"


def has(text: Column, grams: list[str]) -> Column:
    """Whether any of grams stands in text, as `words` and `bigrams` cut it; true also for two words with lines between."""
    return F.concat(F.lit(" "), F.lower(text)).rlike(spelled(grams))


def signs(often: dict[str, int]) -> list[str]:
    """Grams of which one stands wherever CONFIRM of a template's do: of each template the rarest, by how often their rarer word is."""
    out = set()
    for grams in (set(t) for ts in template_bigrams().values() for t in ts):
        least = min(k for k in range(len(grams) + 1) if k / len(grams) >= CONFIRM)
        out |= set(sorted(grams, key=lambda g: (min(often.get(w, 0) for w in g.split()), g))[: len(grams) - least + 1])
    return sorted(out)


def marked() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line, text) of every line with a word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), marked().alias("mark"), F.col("text").cast("string").alias("whole"))
    lines = rows.select("doc_id", "mark", F.posexplode(F.split("whole", "\n")).alias("line", "text"))
    return lines.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def wrapped(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line, text, words) of every line that another follows: the words around the break. The names are those of `paragraphs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), marked().alias("mark"), F.transform(F.split(F.col("text").cast("string"), "\n"), words).alias("w"))
    ends = rows.filter(F.size("w") > 1).select(
        "doc_id", "mark", F.transform("w", lambda w: F.slice(w, F.greatest(F.size(w) - SPAN + 1, F.lit(1)), F.lit(SPAN))).alias("tails"), F.transform("w", lambda w: F.slice(w, 1, SPAN)).alias("heads")
    )
    none = F.array().cast("array<string>")

    def broken(n: Column) -> Column:
        """What stands around the break behind line n; no row carries more than that."""
        first = F.greatest(n - SPAN + 1, F.lit(1))
        before = F.aggregate(F.slice("tails", first, n - first + 1), none, lambda acc, w: F.when(F.size(w) == 0, none).otherwise(F.concat(acc, w)))
        after = F.aggregate(F.reverse(F.slice("heads", n + 1, F.lit(SPAN))), none, lambda acc, w: F.when(F.size(w) == 0, none).otherwise(F.concat(w, acc)))
        tail, head = F.element_at("tails", n), F.element_at("heads", n + 1)  # a line of SPAN words needs no other
        b = F.when(F.size(tail) == SPAN, tail).otherwise(F.slice(before, F.greatest(F.size(before) - SPAN + 1, F.lit(1)), F.lit(SPAN)))
        a = F.when(F.size(head) == SPAN, head).otherwise(F.slice(after, 1, SPAN))
        return F.struct((n - 1).alias("line"), b.alias("b"), a.alias("a"))

    held = F.filter(F.sequence(F.lit(1), F.size("tails") - 1), lambda n: (F.size(F.element_at("tails", n)) > 0) & (F.size(F.element_at("heads", n + 1)) > 0))
    both = ends.select("doc_id", "mark", F.inline(F.transform(held, broken)))
    return both.select("doc_id", "mark", "line", F.concat("b", "a").alias("words")).withColumn("text", F.array_join("words", " "))


@dataclass
class Model:
    counts: CountVectorizerModel
    weights: LogisticRegressionModel
    classes: list[str]
    least: float  # what a paragraph without an anchor stays below
    anchors: list[str] | None
    signs: list[str]


def taught(spark: SparkSession) -> DataFrame:
    """(class, text) of the statements, notices and plain sentences."""
    rows = [(f, frame.format(n)) for f, names in NAMES.items() for n in names for frame in FRAMES]
    rows += [(f, t) for f, texts in NOTICES.items() for t in texts for _ in range(4)]
    rows += [(UNKNOWN, t) for t in PLAIN for _ in range(4)]
    return spark.createDataFrame(rows, "class string, text string")


def sampled(docs: DataFrame, most: int = NEGATIVES) -> DataFrame:
    """(text): the `most` distinct paragraphs lowest by hash. Only about twice as many are shuffled."""
    lines = paragraphs(docs).select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"))
    distinct = lines.agg(F.approx_count_distinct("h")).first()[0]
    low = lines.filter(F.col("h") <= min(int(2.5 * most / max(distinct, 1) * 2**63), 2**63 - 1))
    return low.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(most).select("text")


def train(docs: DataFrame) -> Model:
    spark, classes = docs.sparkSession, [UNKNOWN, *sorted(NAMES)]
    lines = featured(sampled(docs).withColumn("words", words(F.col("text"))))
    plain = lines.filter(F.greatest(*(likeness(f) for f in NAMES)) < CONFIRM).select(F.lit(UNKNOWN).alias("class"), "text", "words", "grams")
    rows = cut(plain.unionByName(featured(taught(spark).withColumn("words", words(F.col("text")))).select("class", "text", "words", "grams")).withColumn("label", F.array_position(fixed(classes), F.col("class")).cast("double") - 1))
    counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2, vocabSize=VOCABULARY).fit(rows)
    weights = LogisticRegression(family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=60).fit(counts.transform(rows))
    over = weights.coefficientMatrix.toArray()
    over = (over[1:] - over[0]).max(axis=0) > 0
    bias = weights.interceptVector.toArray()
    odds = sum(math.exp(b - bias[0]) for b in bias[1:])
    told = {w for g, up in zip(counts.vocabulary, over) if up for w in g.split()} | {w for ts in template_bigrams().values() for t in ts for g in t for w in g.split()}
    often = {r.w: r.n for r in rows.filter(F.col("class") == UNKNOWN).select(F.explode(F.array_distinct("words")).alias("w")).filter(F.col("w").isin(sorted(told))).groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most VOCABULARY words and the templates'
    anchors = sorted({min(g.split(), key=lambda w: (often.get(w, 0), w)) for g, up in zip(counts.vocabulary, over) if up})
    return Model(counts, weights, classes, odds / (1 + odds), anchors, signs(often))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, mark, line, text, wrapped, p, like) of the paragraphs with an anchor, and of the line breaks with an anchor that a template confirms: the classes' probabilities, and the likeness to each of NAMES."""
    lines, breaks = paragraphs(docs), wrapped(docs.filter(has(F.col("text").cast("string"), model.signs))).filter(has(F.col("text"), model.signs))
    if model.anchors is not None:
        lines, breaks = (x.filter(has(F.col("text"), model.anchors)) for x in (lines, breaks))

    def liked(rows: DataFrame) -> DataFrame:
        return featured(rows).withColumn("told", in_templates()).withColumn("like", likenesses("told")).drop("told")

    rows = liked(lines.withColumn("words", words(F.col("text")))).withColumn("wrapped", F.lit(False))
    rows = rows.unionByName(liked(breaks).filter(F.array_max("like") >= CONFIRM).withColumn("wrapped", F.lit(True)))
    judged = model.weights.transform(model.counts.transform(rows)).withColumn("p", vector_to_array("probability"))
    return judged.select("doc_id", "mark", "line", "text", "wrapped", F.transform("p", lambda x: F.round(x, 9)).alias("p"), "like")


def calibrated(rows: DataFrame, docs: DataFrame, model: Model) -> float:
    """The threshold: all but FALSE of the paragraphs without a template stay below it. rows: `scored`; the other paragraphs stay below model.least."""
    n = paragraphs(docs).count()
    unlike = rows.filter(~F.col("wrapped") & (F.array_max("like") < CONFIRM))
    tail = unlike.groupBy(F.floor((1 - F.col("p")[0]) * STEPS).cast("int").alias("step")).agg(F.count("*").alias("n"))
    left, least = FALSE * n, 0
    for step, k in sorted(((r.step, r.n) for r in tail.collect()), reverse=True):  # STEPS + 1 rows at most
        left -= k
        if left < 0:
            least = step + 1
            break
    return max(min(least, STEPS) / STEPS, model.least)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, mark, line, text, family, probability, likeness) of the paragraphs whose family is predicted and confirmed."""
    model = model or train(docs)
    rows = cut(scored(docs, model))
    threshold = calibrated(rows, docs, model)
    judged = rows.filter(1 - F.col("p")[0] >= threshold)
    likely = F.element_at(fixed(model.classes), F.array_position(F.slice("p", 2, len(model.classes) - 1), F.array_max(F.slice("p", 2, len(model.classes) - 1))).cast("int") + 1)

    def passes(f: str, like: Column) -> Column:
        p = F.col("p")[model.classes.index(f)]
        return F.when(likely == f, like >= CONFIRM).otherwise((p >= threshold * (p + F.col("p")[0])) & (like >= 1))

    each = F.array(*(F.struct(F.lit(f).alias("family"), F.col("like")[i].alias("likeness"), passes(f, F.col("like")[i]).alias("passes")) for i, f in enumerate(NAMES)))
    found = judged.withColumn("probability", 1 - F.col("p")[0]).withColumn("found", F.explode(F.filter(each, lambda x: x["passes"])))
    found = found.groupBy("doc_id", "mark", "found.family", "line", "wrapped").agg(F.first("text").alias("text"), F.max("probability").alias("probability"), F.max("found.likeness").alias("likeness"))  # once for repeated rows
    lines = Window.partitionBy("doc_id", "mark", "family").orderBy("line")
    told = F.max((~F.col("wrapped")).cast("int")).over(lines.rangeBetween(1 - SPAN, SPAN)) == 1  # a line says so itself
    again = F.coalesce(F.max(F.col("wrapped").cast("int")).over(lines.rangeBetween(-1, -1)), F.lit(0)) == 1  # the break before it does
    new = found.withColumns({"told": told, "again": again}).filter(~F.col("wrapped") | ~(F.col("told") | F.col("again")))
    return new.select("doc_id", "mark", F.col("line").cast("int").alias("line"), "text", "family", "probability", "likeness")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families (in order, with commas; empty if none) and the least probability, one row for each row of docs."""
    found = scan(docs).groupBy(F.col("doc_id").alias("f_id"), F.col("mark").alias("f_mark")).agg(F.count_distinct("line").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.min("probability").alias("probability"))
    found = hinted(cut(found))
    lines = F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), marked().alias("mark"), F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_paragraphs"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("mark") == F.col("f_mark")), "left")
    return joined.select("doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"), "probability")
