"""Commits of the rollup that meet, and executors without this package."""

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from picmeta.llm import lm_score, source_mix, token_rollup

ROWS = "source string, lang string, version string, n_tokens long"


def signed(spark, n):
    return token_rollup.changes(None, spark.createDataFrame([("s", "en", "v", n)], ROWS))


def sums(df):
    return df.groupBy(*token_rollup.BY).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("tokens"))


def test_late_publisher(spark, tmp_path):
    """B reads the empty log and stalls; A and C commit; B's entry is refused, and B starts anew."""
    root = f"file://{tmp_path}/r"
    number, state = token_rollup.built(spark, root, sums(signed(spark, 1000)))
    assert token_rollup.commit(signed(spark, 10), root, "A") and token_rollup.commit(signed(spark, 100), root, "C")
    assert not token_rollup.publish(spark, root, number, "B", state)
    assert token_rollup.totals(spark, root).first().tokens == 110
    assert token_rollup.commit(signed(spark, 1000), root, "B")
    assert not token_rollup.commit(signed(spark, 10), root, "A") and not token_rollup.commit(signed(spark, 1000), root, "B")
    assert token_rollup.totals(spark, root).first().tokens == 1110
    assert sorted((r.number, r.batch) for r in token_rollup.log(spark, root).collect()) == [(1, "A"), (2, "C"), (3, "B")]


def test_killed_writers(spark, tmp_path):
    """Lost with its state written, and lost with its entry drafted: nothing counts, and a retry counts once."""
    root = f"file://{tmp_path}/r"
    assert token_rollup.commit(signed(spark, 10), root, "A")
    token_rollup.built(spark, root, sums(signed(spark, 5)))
    os.makedirs(tmp_path / "r" / "draft", exist_ok=True)
    (tmp_path / "r" / "draft" / "x.json").write_text('{"number": 2, "bat')
    assert token_rollup.totals(spark, root).first().tokens == 10
    assert token_rollup.commit(signed(spark, 5), root, "B")
    assert token_rollup.totals(spark, root).first().tokens == 15


def test_words_of_sql(spark, tmp_path):
    """Vertical tab, form feed and carriage return part words in the code and in the SQL."""
    import duckdb

    rows = [(2, "a b\r\nc d\x0be", "en", "s", 1), (3, "x\r\ny\x0cz", "en", "t", 1), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    for got, sql in ((lm_score.base(lm_score.lm_score(df)), lm_score.ORACLE), (source_mix.goals(source_mix.mixture(df)), source_mix.ORACLE)):
        want = c.sql(sql).df()
        found = got.toPandas()[list(want.columns)]
        assert sorted(map(str, found.astype(object).where(found.notna(), None).values.tolist())) == sorted(map(str, want.astype(object).where(want.notna(), None).values.tolist()))


ALONE = """
import sys, tempfile
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp()).getOrCreate()
def there(b):
    try:
        import picmeta
        yield from ([1] for _ in b)
    except ImportError:
        yield from ([0] for _ in b)
assert [r[0] for r in spark.sparkContext.parallelize([0], 1).mapPartitions(there).collect()] == [0]
from picmeta.llm import language_id, lm_score, merkle, pieces, secret_scan, token_rollup, variants
docs = spark.createDataFrame([(i, "Some sentences of a text, token = 0123456789abcdef01234567", "en", "s", 5) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
for f in (pieces.round_trips, lm_score.lm_score, language_id.language_id, language_id.accepted, token_rollup.counted, secret_scan.digest, merkle.digest):
    assert len(f(docs).collect()) == 8, f
assert len(variants.digest(docs).collect()) >= 1
assert len(pieces.decode(pieces.encode(docs)).collect()) == 8
print("all ran")
"""


def test_executors_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", ALONE, str(Path(__file__).resolve().parents[2])], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in ran.stdout, ran.stderr[-3000:]
