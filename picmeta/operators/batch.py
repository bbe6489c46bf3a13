"""A batch that goes on where files fail: each step yields a value or an error.

A file whose step has an error keeps the values it has, the step's name and what is
said, and takes no further step; the others go on. `settled` and `failed` add up to
the input, row by row. Null and empty content is judged by the steps themselves;
rows that repeat a path fail or go on each. Other columns pass through, but for the
steps' names and `error`, which results replace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from picmeta.operators.shared import kept

ERROR = "struct<step: string, said: string>"

#: A step: its name, its value, and what is wrong with it (text; null if nothing is), which may use the value's column.
Step = tuple[str, Callable[[], Column], Callable[[], Column]]


def attempted(files: DataFrame, steps: list[Step]) -> DataFrame:
    """files with a column for each step's value and error: struct<step, said>, null where all went well."""
    df = files.drop("error", *(name for name, _, _ in steps)).withColumn("error", F.lit(None).cast(ERROR))
    for name, value, problem in steps:
        df = df.withColumn(name, F.when(F.col("error").isNull(), value()))
        said = F.when(F.col("error").isNull(), problem())
        df = df.withColumn("error", F.when(said.isNotNull(), F.struct(F.lit(name), said).cast(ERROR)).otherwise(F.col("error")))
    return kept(df)  # read twice, and filters pushed below the steps would repeat them


def settled(tried: DataFrame) -> DataFrame:
    return tried.filter("error IS NULL").drop("error")


def failed(tried: DataFrame) -> DataFrame:
    """(path, step, said)."""
    return tried.filter("error IS NOT NULL").select("path", "error.step", "error.said")
