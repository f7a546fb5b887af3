"""Boxes derived from lineitem with integers only, alike on both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.registry import table

UID = "l_orderkey * 100 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"
#: What a detection has of the element that it comes from, and which elements have one.
SEEN = {"cls": "case when r % 11 = 0 then (cls + 1) % 3 else cls end", "x": "x + r % 23 - 9", "y": "y + r % 17 - 6", "w": "w + r % 5", "h": "h + r % 3"}
EMITTED = "r % 13 <> 0"
BOXES = f"""base as (select {UID} uid, l_orderkey div_key, l_linenumber ln, l_partkey pk, l_suppkey sk, cast(l_quantity as bigint) q,
  (l_partkey * 31 + l_linenumber * 7 + l_suppkey) % 97 r from lineitem),
gt as (select uid, cast(floor(div_key / 10) as bigint) sample, cast(ln % 3 as bigint) cls, (pk * 37) % 400 x, (sk * 53) % 300 y, 40 + q w, 40 + cast(ln * 6 as bigint) h, r from base),
pred as (select uid pid, sample, {', '.join(f'{v} {k}' for k, v in SEEN.items())}, r conf from gt where {EMITTED})"""
#: The same, numbered inside screens that lines already name: what is dealt by screen is numbered where it is.
_DEALT = BOXES.replace("partition by l_orderkey", "partition by sample, l_orderkey").replace(" uid, l_orderkey div_key", " uid, sample, l_orderkey div_key").replace("cast(floor(div_key / 10) as bigint) sample", "sample").replace("from lineitem", "from {lines}")
#: Stands for a null screen or id where NumPy takes whole numbers.
NONE = -(1 << 63)


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, each with the detection that comes from it (pcls, px, py, pw, ph, conf; emitted: whether there is one), dealt by their screen with one shuffle and in its order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    lines = lines.withColumn("sample", F.coalesce(F.expr("cast(floor(l_orderkey / 10) as bigint)"), F.lit(NONE)))
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sample")
    boxes = spark.sql(f"with {_DEALT} select * from gt", lines=lines)
    whole = lambda c: F.coalesce(c, F.lit(NONE))
    return boxes.select("sample", whole(F.col("uid")).alias("uid"), "cls", *"xywh", *[F.expr(v).alias("p" + k) for k, v in SEEN.items()], F.col("r").alias("conf"), F.coalesce(F.expr(EMITTED), F.lit(False)).alias("emitted")).sortWithinPartitions("sample")


def given(name: str) -> Column:
    """A column in which NONE stands for null."""
    return F.nullif(F.col(name), F.lit(NONE)).alias(name)


def inter(a: str, b: str) -> str:
    return f"greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0)"


def iou(a: str, b: str) -> str:
    i = inter(a, b)
    return f"(cast({i} as double) / ({a}.w * {a}.h + {b}.w * {b}.h - {i}))"


def at_least_half(a: str, b: str) -> str:
    """IoU >= 0.5 without a division."""
    i = inter(a, b)
    return f"3 * {i} >= {a}.w * {a}.h + {b}.w * {b}.h"
