"""Exact dedup by a tree merge of sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.base import SPACE, cut, text_or_empty

KEY = ("digest", "n_norm", "proof")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_cp and the digest key of each row: SHA-256 of the text without white space, its length and a second hash."""
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t")).select(
        "doc_id", F.length("t").cast("long").alias("n_cp"), F.regexp_replace("t", SPACE + "+", "").alias("t")
    )
    return norm.select("doc_id", "n_cp", F.sha2("t", 256).alias("digest"), F.length("t").alias("n_norm"), F.xxhash64("t").alias("proof"))


def merge_runs(rows: DataFrame, rounds: int = 3, fan_bits: int = 4) -> DataFrame:
    """One row per digest key: best row and number of members.

    Each input partition is a run. In round k the runs whose numbers agree above k * fan_bits bits meet: 2**fan_bits
    sorted runs are merged at once and one row per key is left, so a key that fills a third of all rows shrinks to at
    most one row per run before it moves again. The last round merges what is left of every key. The best row has the
    most code points, then the smallest doc_id (a null id loses); equality is of digest, length and second hash at
    every level.
    """
    best = F.struct((-F.col("n_cp")).alias("neg_cp"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"))
    runs = rows.select(F.spark_partition_id().alias("run"), *KEY, best.alias("best"), F.lit(1).cast("long").alias("members"))
    for k in range(1, rounds + 1):
        # the run number of a round is its own column: were it an expression of the old one, rounds could be folded into one
        run = F.shiftright("run", fan_bits) if k < rounds else F.lit(0)
        runs = runs.withColumn("run", run).groupBy(*(("run",) if k < rounds else ()), *KEY).agg(F.min("best").alias("best"), F.sum("members").alias("members"))
        if k < rounds:
            runs = runs.select("run", *KEY, "best", "members")
    return runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, fan_bits: int = 4) -> DataFrame:
    """Marks every row of docs with its group of equal texts.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when the same without white space; null
    is an empty text, and empty texts equal each other; texts may be of any length. Of a group the row with the most code points, then the
    smallest doc_id, stays. Rows repeated with one doc_id are members each and share the verdict of their id. An empty
    table gives an empty result; other columns are ignored.
    """
    # written once: texts are read and hashed for the merge and for the result alike
    rows = cut(digests(docs, id_col, text_col), "digests")
    joined = F.concat_ws(":", *KEY)
    groups = merge_runs(rows, rounds, fan_bits).where("members > 1").select(joined.alias("gk"), F.col("best.doc_id").alias("best_id"), "members")
    out = rows.withColumn("k", joined).join(groups, F.col("k") == F.col("gk"), "left")
    keep = F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("members", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with d as (
  select doc_id, length(coalesce(text, '')) n_cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) h from documents
)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by h)::bigint group_size,
  doc_id = first_value(doc_id) over w kept, h text_sha256
from d window w as (partition by h order by n_cp desc, doc_id rows between unbounded preceding and unbounded following)
"""
