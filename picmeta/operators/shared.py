"""Cutting lineage in the folder that driver and executors share; dealing out rows; memory of Python workers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and checkpointed in spark.checkpoint.dir. Only a local session may do without that setting; it gets a folder of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="picmeta-checkpoint-"))
    return df.checkpoint()


def dealt(df: DataFrame, rows: int = 5000) -> DataFrame:
    """df in partitions of about so many rows, for work that is dear by the row: a small file, read as it is, would be one task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at its end the worker gives back what it no longer uses, as `picmeta.llm.shared.tidy` does."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied
