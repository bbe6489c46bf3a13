"""Chunks of files put together in order, and copies that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_MS, SKEW_MS = 600_000, 5_000
CLIPBOARD_MS = 120_000
CHUNK = 256 << 10


def expired(age_ms: Column, ttl_ms: int = TTL_MS) -> Column:
    """As old as its time to live, or more than SKEW_MS in the future."""
    return (age_ms >= ttl_ms) | (age_ms < -SKEW_MS)


def next_due(copies: DataFrame, now_ms: Column, ttl_ms: int = CLIPBOARD_MS) -> DataFrame:
    """(owner, due_ms): in how many milliseconds the owner's oldest live copy expires, 0 to ttl_ms. copies: (owner, ts_ms)."""
    live = copies.filter(~expired(now_ms - F.col("ts_ms"), ttl_ms))
    return live.groupBy("owner").agg(F.greatest(F.lit(0), F.least(F.lit(ttl_ms), F.min("ts_ms") + ttl_ms - now_ms)).cast("long").alias("due_ms"))


def newest(copies: DataFrame, now_ms: Column, ttl_ms: int = CLIPBOARD_MS) -> DataFrame:
    """(owner, file): the newest live copy. copies: (owner, ts_ms, file)."""
    return copies.filter(~expired(now_ms - F.col("ts_ms"), ttl_ms)).groupBy("owner").agg(F.max_by("file", F.struct("ts_ms", "file")).alias("file"))


def assembled(chunks: DataFrame) -> DataFrame:
    """(file, n_chunks, size, whole) of chunks (file, idx, size, total): whole if they are numbered from 0 without gap or repeat, none is empty or above CHUNK, and their sizes add up to the total announced."""
    return chunks.groupBy("file").agg(
        F.count("*").alias("n_chunks"), F.sum("size").alias("size"),
        ((F.min("idx") == 0) & (F.max("idx") == F.count("*") - 1) & (F.count_distinct("idx") == F.count("*")) & (F.min("size") > 0) & (F.max("size") <= CHUNK) & (F.sum("size") == F.max("total"))).alias("whole"),
    )


def assembling(chunks: DataFrame, idle_ms: int = TTL_MS) -> DataFrame:
    """The same for a stream: one row (file, size, status) when a file is whole, broken (a chunk out of order, empty or too much) or idle for too long. State is two numbers a file; in a micro-batch the chunks of a file are taken by index."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"file": [key[0]], "size": [0], "status": ["idle"]})
            return
        next_, size = state.get if state.exists else (0, 0)
        if next_ < 0:  # decided before
            return
        for r in pd.concat(batches).sort_values("idx").itertuples():
            if r.idx != next_ or not 0 < r.size <= CHUNK or size + r.size > r.total:
                state.update((-1, 0))
                state.setTimeoutDuration(idle_ms)
                yield pd.DataFrame({"file": [key[0]], "size": [size], "status": ["broken"]})
                return
            next_, size = next_ + 1, size + r.size
            if size == r.total:
                state.update((-1, 0))
                state.setTimeoutDuration(idle_ms)
                yield pd.DataFrame({"file": [key[0]], "size": [size], "status": ["whole"]})
                return
        state.update((int(next_), int(size)))
        state.setTimeoutDuration(idle_ms)

    return chunks.groupBy("file").applyInPandasWithState(step, "file string, size long, status string", "next int, size long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def current(results: DataFrame, versions: DataFrame) -> DataFrame:
    """results (owner, version, ...) of the version that is the owner's last; superseded work is dropped."""
    last = versions.groupBy("owner").agg(F.max("version").alias("version"))
    return results.join(last, ["owner", "version"], "left_semi")
