"""Documents without their red facts, and pointers to the others that still point at them; with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from picmeta.functions import splices
from picmeta.operators.text_ops import RULES

RED = "|".join(p for _, t, p in RULES.values() if t == "red")
OTHER = "|".join(p for _, t, p in RULES.values() if t != "red") + "|[Tt]h[ae][nt]"


def splice_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every red fact goes or, in every second document, gives way to a longer text; a line of pointers to all other facts, and to some words, is put in front."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    data = F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("[removed]"), 9)).otherwise("")
    edits = F.transform(splices.matches(F.col("text"), RED), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), data.alias("data")).cast(splices.EDIT))
    d = d.withColumns({"edits": edits, "others": splices.matches(F.col("text"), OTHER)})
    moved = F.filter(F.transform("others", lambda x: F.struct(splices.followed(x["s"], F.col("edits")).alias("p"), x["value"].alias("value"))), lambda x: x["p"].isNotNull())
    d = d.withColumns({"kept": moved, "body": splices.spliced(F.col("text"), F.col("edits"))})
    d = d.withColumn("made", splices.headed(F.col("body"), F.transform("kept", lambda x: x["p"])))
    whole = F.col("made.content")
    proven = F.forall(F.zip_with("made.pointers", "kept", lambda p, k: F.substring(whole, p + 1, F.length(k["value"])) == k["value"]), lambda ok: ok)
    return d.select("doc_id", F.size("edits").alias("n_cut"), F.size("kept").alias("n_kept"), F.md5(whole.cast("binary")).alias("digest"), proven.alias("proven"))


def _places(name: str, pattern: str) -> str:
    return f"list_transform(range(1, len({name}_m) + 1), lambda i: {{'s': (list_sum(list_transform({name}_p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({name}_m[1:i - 1], lambda x: length(x))), 0))::BIGINT, 'n': length({name}_m[i])}})"


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "splice_pointers": (
        splice_pointers,
        f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 2 = 0 THEN repeat('[removed]', 9) ELSE '' END AS data FROM documents),
m AS (SELECT *, regexp_extract_all(text, '{RED}') AS r_m, regexp_split_to_array(text, '{RED}') AS r_p, regexp_extract_all(text, '{OTHER}') AS o_m, regexp_split_to_array(text, '{OTHER}') AS o_p FROM d),
p AS (SELECT doc_id, data, regexp_replace(text, '{RED}', data, 'g') AS body, {_places('r', RED)} AS red, {_places('o', OTHER)} AS other FROM m),
k AS (SELECT doc_id, body, len(red) AS n_cut, list_transform(list_filter(other, lambda x: len(list_filter(red, lambda r: x.s >= r.s AND x.s < r.s + r.n)) = 0), lambda x: x.s + coalesce(list_sum(list_transform(list_filter(red, lambda r: r.s + r.n <= x.s), lambda r: length(data) - r.n)), 0)::BIGINT) AS ps FROM p),
h AS (SELECT *, list_reduce(list_prepend(0::BIGINT, range(24)), lambda n, i: (length(array_to_string(list_transform(ps, lambda x: (x + n)::VARCHAR), ',')) + 1)::BIGINT) AS size FROM k)
SELECT doc_id, n_cut::INTEGER AS n_cut, len(ps)::INTEGER AS n_kept, md5(concat(coalesce(array_to_string(list_transform(ps, lambda x: (x + size)::VARCHAR), ','), ''), chr(10), body)) AS digest, TRUE AS proven FROM h""",
    )
}
