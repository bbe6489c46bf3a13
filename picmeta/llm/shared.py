"""Helpers that several training-data operators use."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without; it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    kept = spark.conf.get("picmeta.checkpoint.dir", None)
    if not kept:
        kept = "file://" + tempfile.mkdtemp(prefix="picmeta-checkpoint-")
        spark.conf.set("picmeta.checkpoint.dir", kept)
        spark.sparkContext.setCheckpointDir(kept)
    return kept


def scratch(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/picmeta/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, per_file: int = 0, by: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lost executors cost no recomputation. per_file: rows in a file, for large rows; by: a last column whose values are folders."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("maxRecordsPerFile", per_file)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"/picmeta/{spark.sparkContext.applicationId}/" in path:
                delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has cut; for when results that read it are stored elsewhere."""
    delete(spark, scratch(spark))


def hinted(df: DataFrame, most: int = 1 << 18) -> DataFrame:
    """df (a few fixed-width columns) with a broadcast hint if it has at most so many rows; else joined by shuffling."""
    return F.broadcast(df) if df.count() <= most else df


def batches(spark: SparkSession, most: int = 0) -> None:
    """From now on Python gets at most so many rows at once, for tables of whole texts: a batch is held several times, by the JVM too. 0: as many as the session says. What runs later runs with it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    said = spark.conf.get("picmeta.arrow.rows", None)
    if said is None:
        spark.conf.set("picmeta.arrow.rows", said := spark.conf.get(key))
    spark.conf.set(key, str(most) if most and not 0 < int(said) < most else said)


def remainder(doc_id: str | Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes, which DuckDB lacks: by bitwise steps; null for null."""
    byte = f"('0x' || substr(hex(encode({text})), (2 * i - 1)::INTEGER, 2))::BIGINT"
    steps = "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({text}) + 1), lambda i: {byte})), {steps}), 4294967295)"


def raw(col: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text; bytes.split() and bytes.lower() then act on ASCII only."""
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    return col.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def slices(b: pa.RecordBatch, at: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """b in pieces whose texts, in column `at`, hold about limit bytes; a longer text is a piece of its own."""
    begin, held = 0, 0
    for i, n in enumerate(pc.binary_length(b.column(at)).to_pylist()):
        if held and held + (n or 0) > limit:
            yield b.slice(begin, i - begin)
            begin, held = i, 0
        held += n or 0
    if begin < b.num_rows:
        yield b.slice(begin)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and what its worker process holds but no longer uses goes back to the machine at the end: Spark keeps idle workers, and the next stage's memory adds to theirs."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim:
            trim(0)

    return tidied


def numbered(words: list) -> tuple[np.ndarray, list]:
    """The number of each word among the distinct words, and those."""
    if not words:
        return np.empty(0, np.int64), []
    d = pa.array(words).dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary.to_pylist()
