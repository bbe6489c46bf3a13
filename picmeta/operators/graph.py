"""References between parts: children, properties, and what a set reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from picmeta.operators.shared import kept


def reached(start: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(path, id, depth): all that edges (path, src, dst) lead to from start (path, id), start included, each at its least depth. Cycles end; each round joins only what is new.

    most bounds the depth; references deeper than that are an error. Rounds are kept by checkpoint."""
    edges = kept(edges.select("path", "src", "dst").distinct())
    seen = kept(start.select("path", "id").distinct().withColumn("depth", F.lit(0)))
    edge = seen
    for depth in range(1, most + 1):
        step = edge.withColumnRenamed("id", "src").join(edges, ["path", "src"]).select("path", F.col("dst").alias("id")).distinct()
        edge = kept(step.join(seen, ["path", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if edge.isEmpty():
            return seen
        seen = seen.unionByName(edge)
    raise ValueError(f"references are deeper than {most}")


def children(parents: DataFrame, pointers: DataFrame, tables: DataFrame) -> DataFrame:
    """(path, id, tag, child): the tables that pointers (path, id, tag, at) of parents (path, id) lead to. tables: (path, table, at)."""
    # Spark's estimate of exploded tables is their source's; a broadcast by it holds them whole in each task's memory
    return parents.select("path", "id").hint("merge").join(pointers, ["path", "id"]).hint("merge").join(tables.hint("merge"), ["path", "at"]).select("path", "id", "tag", F.col("table").alias("child"))


def properties(items: DataFrame, links: DataFrame, props: DataFrame) -> DataFrame:
    """(path, id, nth, kind, value): the properties of items (path, id), in order. links: (path, id, nth, prop); props: (path, prop, kind, value)."""
    return items.select("path", "id").hint("merge").join(links, ["path", "id"]).hint("merge").join(props.hint("merge"), ["path", "prop"]).select("path", "id", "nth", "kind", "value")
