"""Licence paragraphs planted among plain ones, and documents with known statements."""

import pytest
from pyspark.sql import functions as F

from picmeta.llm import license_scan

ROWS = [
    (1, "Plain first line.\nReleased under the MIT License.\nThe end", "mit"),
    (2, "Licensed under the Apache License, Version 2.0.", "apache"),
    (3, "This work is licensed under the GNU General Public License, version 3.", "gpl"),
    (4, "Some words\n\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "cc-by-nc,mit"),
    (5, "She lost her fishing licence and the Apache helicopter flew by.", ""),
    (6, "The general public asked for the license of the driver.", ""),
    (7, None, ""),
    (8, "", ""),
    (9, "x" * 20_000 + " license", ""),
    (None, "Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    (2, "Licensed under the Apache License, Version 2.0.", "apache"),
]


def test_families(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in ROWS], "doc_id long, text string, words string")
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/license_docs")
    docs = spark.read.parquet(path)
    low = lambda i: -1 if i is None else i
    got = license_scan.digest(docs).collect()
    assert sorted((low(r.doc_id), r.families) for r in got) == sorted((low(i), f) for i, _, f in ROWS)
    assert license_scan.digest(docs.limit(0)).count() == 0


def test_all_statements_of_the_documents(spark):
    """Each line that names one of the four licences of the test tables is found, and the screen by anchors drops none."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = license_scan.train(docs)
    found = {(r.doc_id, r.line): r.family for r in license_scan.scan(docs, model).collect()}
    for r in license_scan.paragraphs(docs).collect():
        named = [f for f, x in (("mit", "under the MIT License"), ("apache", "under the Apache License"), ("gpl", "under the GNU General Public License"), ("cc-by-nc", "under CC BY-NC")) if x in r.text]
        assert ([found[r.doc_id, r.line]] if (r.doc_id, r.line) in found else []) == named
    assert model.anchors
    model.anchors = None
    assert {(r.doc_id, r.line): r.family for r in license_scan.scan(docs, model).collect()} == found


WRAPPED = [
    (1, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal", "mit"),
    (2, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", "bsd"),
    (3, "Some text.\n\nPermission is hereby\ngranted, free of charge,\nto any person obtaining\na copy of this software\nand associated\ndocumentation files", "mit"),
    (4, "Licensed under the MIT License or the Apache License.", "apache,mit"),
    (5, "Licensed under the GNU Lesser General Public License, version 3.", "lgpl"),
    (6, "Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    (7, "Permission is hereby granted, free of charge, to any person obtaining a\n\nfishing rod.\nThe officer showed a copy", ""),
    (8, "Released under the MIT License.\nThe end of it.\nLicensed under the Apache License, Version 2.0.", "apache,mit"),
]


def test_wrapped_notices_and_several_families(spark):
    spark.createDataFrame([(i, t) for i, t, _ in WRAPPED], "doc_id long, text string").write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/license_wrapped")
    got = {r.doc_id: (r.families, r.n_licensed) for r in license_scan.digest(spark.read.parquet(path)).collect()}
    assert got == {i: (f, 2 if i == 8 else bool(f)) for i, _, f in WRAPPED}


HELD_OUT = ["Distributed under the {}", "Code in this repository is available under the {}", "Copyright 2020 the authors. See the {} for details.", "{} (see COPYING)"]
NO_LICENCE = ["A licence to fish costs ten euros a year.", "The public library is open to the general reader.", "Version 2.0 of this creative work is common.", "He was granted permission to copy the book.", "The foundation published a list of conditions."]


def test_held_out_statements_by_family(spark):
    """Sentences that no frame has: recall and precision by family, for the longest name of each."""
    rows = [(f"{f}", s.format(max(names, key=len))) for f, names in license_scan.NAMES.items() for s in HELD_OUT] + [("", t) for t in NO_LICENCE]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/license_held_out")
    got = {r.doc_id: r.families for r in license_scan.digest(spark.read.parquet(path)).collect()}
    right = sum(got[i] == f for i, (f, _) in enumerate(rows))
    assert right >= 0.9 * len(rows), [(f, t, got[i]) for i, (f, t) in enumerate(rows) if got[i] != f]
    assert all(got[i] == "" for i, (f, _) in enumerate(rows) if not f)


def test_many_lines(spark):
    """A document of 100,000 lines, with notices wrapped over lines in it: work grows with the lines."""
    notice = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files"]
    lines = [f"line {i} of words" for i in range(100_000)]
    lines[50_000:50_002] = notice
    rows = [(1, "\n".join(lines)), (2, "\n".join(notice)), (3, "x")]
    got = license_scan.wrapped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 100_000 - 1 + 1 and got.agg({"line": "max"}).first()[0] == 99_998
    assert got.filter("doc_id = 2").first().words == " ".join(notice).lower().replace(",", "").split()[: 2 * license_scan.SPAN]


def test_likenesses_of_what_stands_in_templates(spark):
    """Looking a paragraph's grams up once gives the likeness that each template's own comparison gives."""
    texts = ["", "the sea", "Licensed under the MIT License.", "GPL", "GNU General Public License, version", *[t for ts in license_scan.NOTICES.values() for t in ts]]
    rows = license_scan.featured(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("words", license_scan.words(F.col("text"))))
    each = F.array(*(license_scan.likeness(f) for f in license_scan.NAMES))
    got = rows.withColumn("told", license_scan.in_templates()).select(each.alias("want"), license_scan.likenesses("told").alias("got")).collect()
    assert all(r.want == r.got for r in got) and max(max(r.got) for r in got) == 1 and got[1].got == [0.0] * len(license_scan.NAMES)


def test_breaks_that_no_template_confirms_are_not_scored(spark):
    """Plain lines with licence words: their breaks made more than half of what was scored."""
    plain = "All of this file\nis under the terms of the sea.\nYou may use it\nas a public copy."
    rows = [*((i, plain) for i in range(20)), (20, "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software and associated documentation files")]
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/license_breaks")
    docs = spark.read.parquet(path)
    model = license_scan.train(docs)
    got = license_scan.scored(docs, model).collect()
    assert [(r.doc_id, r.line) for r in got if r.wrapped] == [(20, 0)]
    assert {r.doc_id for r in got if not r.wrapped} == set(range(21))


def test_signs_stand_in_all_that_a_template_confirms(spark):
    """Templates with as many words left out as CONFIRM allows, in any case, with any separators and letters next to them."""
    signs, texts = license_scan.signs({"software": 3, "license": 9, "notice": 2}), []
    for t in (t for ts in license_scan.templates().values() for t in ts):
        w = t.split()
        texts += [t, t.upper(), "\n, ".join(w), f"\u00e9{t}\u00e9", *(" ".join(w[:i] + w[i + k :]) for i in range(len(w)) for k in (1, 2, 3))]
    texts += ["the sea", "", "mits licenses", "amit license", "gplx", "copies"]
    rows = license_scan.featured(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("words", license_scan.words(F.col("text")))).withColumn("told", license_scan.in_templates())
    got = rows.select("text", "grams", (F.array_max(license_scan.likenesses("told")) >= license_scan.CONFIRM).alias("like"), license_scan.has(F.col("text"), signs).alias("has")).collect()
    assert all(r.has for r in got if r.like) and sum(r.like for r in got) > 500
    assert all(r.has == bool(set(r.grams) & set(signs)) for r in got)
