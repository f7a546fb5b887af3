"""Layouts by signature: screens that are the same but for the order of their elements, and what of them stands in two splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.canonical import canonical
from quillon.plans.boxes import BOXES
from quillon.registry import query, run_sql

# Screens: those of the boxes; of every ninth a twin with its elements in another order, of every other ninth one with a box moved by a pixel.
_LAYOUTS = f"""{BOXES}, lay as (select sample, uid, cls, x, y, w, h from gt union all select sample + 1000000, -uid, cls, x, y, w, h from gt where sample % 9 = 0
  union all select sample + 2000000, uid, cls, case when uid = first_uid then x + 1 else x end, y, w, h from (select *, min(uid) over (partition by sample) first_uid from gt where sample % 9 = 1) m)"""
_ELEMENT = T.StructType([T.StructField(c, T.LongType()) for c in ("cls", "x", "y", "w", "h")])


def signatures(elements: DataFrame, sample: str = "sample") -> DataFrame:
    """(sample, elements, signature): the hash of the sorted texts of a screen's elements, class and box each; their order and ids are of no matter."""
    e = elements.select(sample, canonical(F.struct(*[F.col(c) for c in _ELEMENT.names]), _ELEMENT).alias("j"))
    return e.groupBy(sample).agg(F.count("*").alias("elements"), F.sha2(F.array_join(F.array_sort(F.collect_list("j")), ","), 256).alias("signature"))


@query("layout_twins", "D-10", f"""with {_LAYOUTS}, s as (select sample, count(*) elements, sha256(string_agg(j, ',' order by j)) signature from (select sample, '{{"cls":' || cls || ',"x":' || x || ',"y":' || y || ',"w":' || w || ',"h":' || h || '}}' j from lay) e group by sample),
g as (select signature, count(*) n, min(sample) kept, count(distinct sample % 3) splits from s group by signature having count(*) > 1)
select s.sample, g.kept, s.elements, g.n copies, g.splits > 1 leaks, s.signature from s join g on g.signature = s.signature""")  # fmt: skip
def layout_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screens whose layout another one has: the first of them, how many there are, and whether they lie in two splits. Counts come first, so a layout that many share is one row."""
    s = signatures(run_sql(spark, sf_dir, f"with {_LAYOUTS} select * from lay"))
    # both sides read the same columns of the signatures, so Spark shuffles elements once for them; a signature has one number of elements
    per_split = s.groupBy("signature", "elements", (F.col("sample") % 3).alias("split")).agg(F.count("*").alias("n"), F.min("sample").alias("kept"))
    g = per_split.groupBy(F.col("signature").alias("g"), F.col("elements").alias("ge")).agg(F.sum("n").alias("copies"), F.min("kept").alias("kept"), (F.count("*") > 1).alias("leaks")).where("copies > 1")
    return s.join(g, (F.col("signature") == F.col("g")) & (F.col("elements") == F.col("ge"))).select("sample", "kept", "elements", "copies", "leaks", "signature")
