"""The mixture's whole rows are shuffled once and not written; rows alike find one place each in the list of their copies."""

from collections import Counter

from pyspark.sql import functions as F

from picmeta.llm import source_mix


def test_whole_rows_are_not_written(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    odd = [(None, "twice, without an id", None, "a"), (None, "twice, without an id", None, "b"), (3, None, "src0", "c"), (3, "", "src0", "d"), (None, None, None, "e")]
    same = [(None, "one and the same row", "src0", f"row {i}") for i in range(source_mix.CHUNK)]
    schema = "doc_id long, text string, source string, note string"
    written, cut = [], source_mix.cut
    monkeypatch.setattr(source_mix, "cut", lambda df, *a, **k: cut(written.append(df.columns) or df, *a, **k))
    for extra in ([], [(None, "one and the same row", "src0", f"more {i}") for i in range(500)]):
        every = docs.withColumn("note", F.lit("clash")).unionByName(spark.createDataFrame(odd + same + extra, schema))
        every.repartition(5).write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/mix_disk_{len(extra)}")
        every = spark.read.parquet(path)
        want = Counter()
        for r in source_mix.mixture(every.drop("note").withColumn("mark", F.lit(0))).collect():
            want[r.doc_id, r.size] += r.copies
        written.clear()
        rows = source_mix.mix(every).collect()
        got = Counter((r.doc_id, len((r.text or "").split())) for r in rows)
        assert got == Counter({k: n for k, n in want.items() if n})
        by_row = Counter(map(tuple, rows))
        assert by_row.keys() <= set(map(tuple, every.collect()))  # every row with its own note
        assert max(by_row.values()) <= source_mix.CAP
        assert ["text" in c for c in written].count(True) == bool(extra)  # only rows with more than CHUNK alike
