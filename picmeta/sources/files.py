"""Folders of files as tables, registries, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from picmeta.functions.binary import file_format

MOST = 512 << 20
#: Types that a file may be shared in with, and the endings that stand for them.
TYPES = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp", "image/heic": "heic", "image/heif": "heif"}
REGISTRY = "string STRING, kind STRING, file STRING, location STRING, grp STRING, tier STRING, basis STRING, encoding STRING, exiftool_form STRING"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, format) of the files of a folder and those below; a file that is empty or can't be read is left out (`missing` names it)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder)
    return rows.filter(F.col("length") <= MOST).select("path", "length", "content", file_format(F.col("content")).alias("format"))


def missing(expected: DataFrame, read: DataFrame) -> DataFrame:
    """(path, problem) of the expected paths that weren't read or whose format isn't known."""
    known = read.select("path", "format")
    return expected.select("path").join(known, "path", "left").filter(F.col("format").isNull()).select("path", F.lit("not read, or no known format").alias("problem"))


def arriving(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The same as a stream: each file once, when it comes."""
    rows = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY").load(folder)
    return rows.select("path", "length", "content", file_format(F.col("content")).alias("format"))


def registry(spark: SparkSession, path: str, schema: str = REGISTRY) -> DataFrame:
    """A registry of planted strings: tab-separated with a header."""
    return spark.read.option("sep", "\t").option("header", "true").option("quote", "").schema(schema).csv(path)


def incoming(mime: Column, name: Column) -> Column:
    """The type of a file that is shared in: what is said if it is known, else by the name's ending; null for others."""
    ending = F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)
    by_name = None
    for kind, ext in TYPES.items():
        own = ending.isin(ext, "jpeg") if ext == "jpg" else ending == ext
        by_name = F.when(own, kind) if by_name is None else by_name.when(own, kind)
    return F.when(F.lower(mime).isin(*TYPES), F.lower(mime)).otherwise(by_name)


def acceptable(uri: Column, own: str) -> Column:
    """Only content: addresses that aren't our own."""
    return F.startswith(uri, F.lit("content://")) & ~F.startswith(uri, F.lit(f"content://{own}/"))


def report(rows: DataFrame, folder: str) -> None:
    """rows as JSON lines and tab-separated values, in two folders."""
    rows.write.mode("errorifexists").json(f"{folder}/json")
    rows.write.mode("errorifexists").option("sep", "\t").option("header", "true").csv(f"{folder}/tsv")
