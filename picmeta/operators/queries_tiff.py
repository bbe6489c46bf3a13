"""TIFF blocks made of customers, some of them damaged, and read again; with SQL that knows them by how they are made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from picmeta.functions import tiff
from picmeta.operators.shared import dealt


def made(customers: DataFrame) -> DataFrame:
    """(path, content): a block of each customer, in both byte orders by turns. By the number mod 8: a pointer out of the block, one to a directory that was read, a chain in a circle, a cut end, no head, an unknown type."""
    way, le = F.col("c_custkey") % 8, F.floor(F.col("c_custkey") / 8) % 2 == 0

    def text(v: Column) -> Column:
        return F.concat(v.cast("binary"), F.lit(b"\0"))

    name = text(F.col("c_name"))
    ifd0 = F.array(
        F.struct(F.lit(0x010F).alias("tag"), F.when(way == 6, 77).otherwise(2).alias("type"), F.octet_length(name).cast("long").alias("count"), name.alias("data")),
        tiff.field(0x0112, 3, 1, tiff.integer(le, F.col("c_nationkey"), 2)), tiff.field(tiff.EXIF, 4, 1, tiff.integer(le, F.col("exif_to"), 4)), tiff.field(tiff.GPS, 4, 1, tiff.integer(le, F.col("gps_to"), 4)),
    )
    fraction = F.concat(tiff.integer(le, F.col("c_custkey"), 4), tiff.integer(le, 100, 4))
    exif = F.array(tiff.field(0x829A, 5, 1, fraction), tiff.field(0x9286, 2, F.octet_length(text(F.col("c_mktsegment"))), text(F.col("c_mktsegment"))), tiff.field(0x8827, 3, 2, F.concat(tiff.integer(le, 100, 2), tiff.integer(le, F.col("c_nationkey"), 2))))
    gps = F.array(tiff.field(0x0001, 2, 2, F.lit(b"N\0")))
    preview = F.array(tiff.field(0x0103, 3, 1, tiff.integer(le, 6, 2)))
    zero = F.lit(0).cast("long")
    placed = customers.withColumns({"exif_to": zero, "gps_to": zero})
    placed = placed.withColumn("exif_at", 8 + tiff.directory_size(ifd0)).withColumn("gps_at", F.col("exif_at") + tiff.directory_size(exif)).withColumn("next_at", F.col("gps_at") + tiff.directory_size(gps))
    placed = placed.withColumns({"exif_to": F.when(way == 1, 0xFFFFFF).otherwise(F.col("exif_at")), "gps_to": F.when(way == 2, 8).otherwise(F.col("gps_at"))})
    whole = F.concat(tiff.head(le), tiff.directory(le, F.lit(8), ifd0, F.col("next_at")), tiff.directory(le, F.col("exif_at"), exif, zero), tiff.directory(le, F.col("gps_at"), gps, zero), tiff.directory(le, F.col("next_at"), preview, F.when(way == 3, 8).otherwise(0)))
    broken = F.when(way == 4, F.substring(whole, F.lit(1), F.octet_length(whole) - 10)).when(way == 5, F.concat(F.lit(b"XX"), F.substring(whole, F.lit(3), F.octet_length(whole)))).otherwise(whole)
    return placed.select(F.col("c_custkey").alias("path"), broken.alias("content"))


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(dealt(spark.read.parquet(f"{sf_dir}/customer.parquet")))


def tiff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.directories(_made(spark, sf_dir)).select("path", F.array_join(F.transform("tiff.ifds", lambda d: d["name"]), ",").alias("ifds"), F.array_join("tiff.warnings", " ").alias("said"), "tiff.damaged")


def tiff_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir).select("path", F.inline(tiff.values(F.col("content"))))


_BY_NAME = "CASE WHEN way = 1 THEN 'ifd0,gps,ifd1' WHEN way = 2 THEN 'ifd0,exif,ifd1' WHEN way = 4 THEN 'ifd0,exif,gps' WHEN way = 5 THEN NULL ELSE 'ifd0,exif,gps,ifd1' END"
_SAID = "CASE way WHEN 1 THEN 'The Exif directory in the EXIF data points outside the data and was skipped.' WHEN 2 THEN 'The GPS directory in the EXIF data points outside the data and was skipped.' WHEN 3 THEN 'The extra preview directory in the EXIF data points outside the data and was skipped.' WHEN 4 THEN 'The preview directory in the EXIF data is damaged and was skipped.' WHEN 5 THEN NULL ELSE '' END"
_SIZES = "8 + 54 + length(c_name) + 1 + (length(c_name) + 1) % 2 AS exif_at, 42 + 8 + CASE WHEN length(c_mktsegment) + 1 > 4 THEN length(c_mktsegment) + 1 + (length(c_mktsegment) + 1) % 2 ELSE 0 END AS exif_size"
#: ifd, nth (by tag), tag, type, value.
_FIELDS = [
    ("ifd0", 0, 0x010F, "CASE WHEN way = 6 THEN 77 ELSE 2 END", "CASE WHEN way <> 6 THEN c_name END"),
    ("ifd0", 1, 0x0112, "3", "c_nationkey::VARCHAR"),
    ("ifd0", 2, 0x8769, "4", "(CASE WHEN way = 1 THEN 16777215 ELSE exif_at END)::VARCHAR"),
    ("ifd0", 3, 0x8825, "4", "(CASE WHEN way = 2 THEN 8 ELSE exif_at + exif_size END)::VARCHAR"),
    ("exif", 0, 0x829A, "5", "concat(c_custkey, '/100')"),
    ("exif", 1, 0x8827, "3", "concat('100, ', c_nationkey)"),
    ("exif", 2, 0x9286, "2", "c_mktsegment"),
    ("gps", 0, 0x0001, "2", "'N'"),
    ("ifd1", 0, 0x0103, "3", "'6'"),
]
# the GPS pointer (0x8825) sorts behind the Exif pointer (0x8769)
_ROWS = " UNION ALL ".join(f"SELECT c_custkey AS path, '{d}' AS ifd, {i} AS nth, {t} AS tag, {k} AS type, {'way <> 6' if t == 0x010F else 'TRUE'} AS valid, {v} AS value FROM c WHERE contains(coalesce({_BY_NAME}, ''), '{d}')" for d, i, t, k, v in _FIELDS)
_C = f"c AS (SELECT *, c_custkey % 8 AS way, {_SIZES} FROM customer)"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "tiff_files": (tiff_files, f"WITH {_C} SELECT c_custkey AS path, {_BY_NAME} AS ifds, {_SAID} AS said, CASE WHEN way <> 5 THEN FALSE END AS damaged FROM c"),
    "tiff_entries": (tiff_entries, f"WITH {_C} {_ROWS}"),
}
