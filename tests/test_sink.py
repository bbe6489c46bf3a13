"""Files come whole or not at all."""

import time
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from picmeta.sources.sink import FileSink, FileWriter


def there(path):
    return {p.name: p.read_bytes() for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_sink(spark, tmp_path):
    spark.dataSource.register(FileSink)
    rows = [(f"f{i}.png", bytes([i]) * i) for i in range(40)]
    df = spark.createDataFrame(rows, "name string, content binary").withColumn("more", F.lit(1)).repartition(5)
    target = tmp_path / "out"
    df.write.format("picmeta_files").mode("append").save(f"file://{target}")
    assert there(target) == dict(rows) and not list(target.glob("_staging*"))
    df.limit(0).write.format("picmeta_files").mode("append").save(f"file://{target}")
    assert there(target) == dict(rows)
    for bad in [("x", None), (None, b"x"), ("../x", b"x"), ("_x", b"x")]:
        with pytest.raises(Exception, match="name"):
            spark.createDataFrame([*rows, bad], "name string, content binary").repartition(3).write.format("picmeta_files").mode("append").save(f"file://{tmp_path}/bad")
        end = time.time() + 20  # tasks of a failed job may still be stopping
        while time.time() < end and list((tmp_path / "bad").glob("_staging*")):
            time.sleep(0.2)
        assert there(tmp_path / "bad") == {} and not list((tmp_path / "bad").glob("_staging*"))


def test_killed_and_repeated_attempts(tmp_path):
    """An attempt that was killed and one that was repeated leave nothing beside what counts."""
    w = FileWriter(f"file://{tmp_path}/o")
    first, again = (w.write(iter([Row(name="a", content=b"1")])) for _ in range(2))
    killed = Path(tmp_path / "o" / w.staging.rpartition("/")[2] / "part-killed")
    killed.mkdir(parents=True)
    (killed / "half").write_bytes(b"?")
    w.commit([again, None])
    assert there(tmp_path / "o") == {"a": b"1"} and not list((tmp_path / "o").glob("_staging*")) and first.folder != again.folder


def test_half_a_task(tmp_path):
    w = FileWriter(f"file://{tmp_path}/o")
    with pytest.raises(ValueError, match="name"):
        w.write(iter([Row(name="a", content=b"1"), Row(name="a", content=b"2")]))
    w.abort([])
    assert there(tmp_path) == {}
