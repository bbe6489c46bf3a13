"""The pipeline's stages on odd rows, and run() against a plain version of each stage's decisions."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
LONG = " ".join(f"river{i}" for i in range(90))
SHARED = "this line stands in several of the documents"


@pytest.fixture(scope="module")
def rows():
    own = [(i, "\n".join([SHARED, " ".join(f"word{i}x{k}" for k in range(60)), f"the end of text {i}"]), "en", "ab"[i % 2], 0, "x") for i in range(40)]
    own += [(100, LONG, "en", "a", 0, "x"), (101, LONG.replace("river50", "lake"), "en", "b", 0, "x"), (102, LONG, "en", None, 0, "x"), (103, None, None, None, None, None), (104, "", "en", "a", 0, "x"), (105, "12 34", "en", "a", 0, "x")]
    return own + [(None, "a row without an id " + "z" * 30_000, None, None, None, None), own[3], own[3]]


def test_run_against_plain_stages(spark, rows):
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/pipeline"
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    stages, docs = {}, spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, path))
        stages[name] = docs.collect()
        assert name == "encode" or docs.columns == SCHEMA.replace(",", "").split()[::2]
    kept = {r.doc_id for r in stages["language_id"]}
    assert kept == {i for i, t, *_ in rows if t and re.search("[a-z]", t)}
    dedup = Counter((r.doc_id, r.text) for r in stages["line_dedup"])
    want = Counter()
    for i, t, *_ in rows:
        if i in kept:
            want[i, t if i is None or i >= 39 else t.removeprefix(SHARED + "\n")] += 1
    assert dedup == want
    near = Counter(r.doc_id for r in stages["near_dedup"])
    assert near == Counter({i: n for i, n in Counter(i for i, *_ in rows if i in kept).items() if i not in (101, 102)})
    words, size = Counter(), defaultdict(int)
    for r in stages["near_dedup"]:
        size[r.source] += len(r.text.split())
    for r in stages["source_mix"]:
        words[r.source] += len(r.text.split())
    assert all(words[s] <= 2 * size[s] for s in size) and sum(words.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.1)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in stages["encode"])
    assert Counter(r.doc_id for r in stages["encode"]) == Counter(r.doc_id for r in stages["source_mix"])
    again = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, path).collect())
    assert again == Counter((r.doc_id, tuple(r.ids)) for r in stages["encode"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_whole_texts_go_to_python_in_small_batches(spark, rows):
    """Stages of whole texts get ROWS rows at most at once, the others what the session says, also when that is set before."""
    docs, key = spark.createDataFrame(rows, SCHEMA), "spark.sql.execution.arrow.maxRecordsPerBatch"
    said, stages = spark.conf.get(key), dict(corpus_pipeline.STAGES)
    seen = {}
    for name in ("language_id", "line_dedup", "near_dedup", "source_mix", "encode", "line_dedup"):
        stages[name](spark, docs, "")
        seen[name] = spark.conf.get(key)
    assert seen == {n: str(corpus_pipeline.ROWS) if n in ("language_id", "encode") else said for n in stages} and int(said) > corpus_pipeline.ROWS
