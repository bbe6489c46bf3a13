"""Token counts kept up to date by signed changes.

A change is a row (source, lang, version, n_tokens, sign): +1 for an insert, -1
for a delete, and for a revised count the old row with -1 and the new with +1.
Counts are additive, so the totals are kept as a table of their own and a batch
only adds its sums to it.

`commit` writes the totals with the batch added as a new state, in a folder of
its own, and then publishes it as entry `number` of the log, one more than the
entry it was built on. An entry is written under another name and renamed, which
fails if the log has one of that number: so of two commits built on the same
totals one stands, and the other starts anew on its result. Nobody builds on an
entry that can still lose. A job that is lost before the renaming leaves files that
nothing reads. A batch that the log has already isn't added again, so retries count
once.

Null source or lang is a group of its own. Null text has no tokens and counts as
a document. Repeated rows count each. Groups without documents and tokens left
go. Empty batches change nothing; without batches the totals are empty. An empty
table of documents gives empty counts; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from picmeta.llm import pieces

VERSION = "piece-unigram-1"
BY = ["source", "lang", "version"]
SUMS = "source string, lang string, version string, docs long, tokens long"
LOG = "number long, batch string, state string"


def counted(docs: DataFrame, version: str = VERSION, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens) of each row of docs."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    sized = pieces.lengths(rows, path, keep=("doc_id", "source", "lang"))
    return sized.select("doc_id", "source", "lang", F.lit(version).alias("version"), "n_tokens")


def changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed rows that lead from the counted rows before (deleted or revised) to those after (inserted or revised)."""
    signed = [df.select(*BY, "n_tokens", F.lit(sign).alias("sign")) for df, sign in ((before, -1), (after, 1)) if df is not None]
    return signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])


def log(spark: SparkSession, root: str) -> DataFrame:
    """(number, batch, state) of the commits. The folder is made by the first commit."""
    try:
        rows = spark.read.schema(LOG).json(f"{root}/log")
        rows.limit(1).collect()
    except Exception as e:  # before the first commit
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)
    return rows


def totals(spark: SparkSession, root: str) -> DataFrame:
    """(source, lang, version, docs, tokens): the totals after the last commit."""
    last = log(spark, root).orderBy(F.desc("number")).first()
    if last is None:
        return spark.createDataFrame([], SUMS)
    return spark.read.schema(SUMS).parquet(f"{root}/state/{last.state}")


def commit(signed: DataFrame, root: str, batch: str) -> bool:
    """Adds a batch of signed rows to the rollup at root; false if it has a batch of that id."""
    spark = signed.sparkSession
    sums = signed.groupBy(*BY).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("tokens"))
    while True:
        done = log(spark, root)
        if not done.filter(F.col("batch") == batch).isEmpty():
            return False
        number, state = built(spark, root, sums)
        if publish(spark, root, number, batch, state):
            return True


def built(spark: SparkSession, root: str, sums: DataFrame) -> tuple[int, str]:
    """The next number and the name of a new state, the last one with sums added."""
    last = log(spark, root).orderBy(F.desc("number")).first()
    number = last.number + 1 if last else 1
    state = f"{number:012d}-{uuid.uuid4().hex}"
    now = spark.read.schema(SUMS).parquet(f"{root}/state/{last.state}") if last else spark.createDataFrame([], SUMS)
    added = now.unionByName(sums).groupBy(*BY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")
    added.write.parquet(f"{root}/state/{state}")
    return number, state


def publish(spark: SparkSession, root: str, number: int, batch: str, state: str) -> bool:
    """Puts an entry into the log, whole or not at all; false if it has one of that number."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    draft, entry = (hadoop.fs.Path(f"{root}/{x}") for x in (f"draft/{state}.json", f"log/{number:012d}.json"))
    files = draft.getFileSystem(conf)
    out = files.create(draft, True)
    out.write(bytearray(json.dumps({"number": number, "batch": batch, "state": state}).encode()))
    out.close()
    files.mkdirs(entry.getParent())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(hadoop.fs, "Options$Rename").NONE  # an entry that is there stays
    try:
        hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(draft), files.makeQualified(entry), options)
    except Py4JJavaError as e:
        if files.exists(entry):
            return False
        raise e
    return True
