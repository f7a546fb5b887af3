"""One-to-one greedy matching and suppression: folds over small sorted arrays, one per sample and class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.geometry import Box


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column], keep: Column, id_type: str = "bigint") -> DataFrame:
    """left (keys, lid, x, y, w, h, ...) claims the best unclaimed of right (keys, rid, ox, oy, ow, oh, ordinal).

    Left rows come in the given order inside a group; of the candidates that pass keep (over the columns of both), the
    one with the greatest overlap ratio, then the smallest ordinal, wins if nobody has claimed it. Only pairs that can
    match are gathered, so an array holds the candidates of one sample and class. Returns keys, lid, rid.
    """
    ratio = Box.of().iou(Box.of("o"))
    pairs = left.join(right, keys).where(keep).withColumn("ratio", ratio)
    cands = pairs.groupBy(*keys, "lid").agg(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("r"), "ordinal", "rid"))).alias("cands"), *[F.first(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(f"o{i}") for i in range(len(order))], "lid", F.col("cands.rid").alias("rids"))))
    state = F.struct(F.array().cast(f"array<{id_type}>").alias("claimed"), F.array().cast(f"array<struct<lid:{id_type},rid:{id_type}>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        free = F.filter(row["rids"], lambda r: ~F.array_contains(acc["claimed"], r))
        pick = F.try_element_at(free, F.lit(1))
        claimed = F.when(pick.isNull(), acc["claimed"]).otherwise(F.array_append(acc["claimed"], pick))
        return F.struct(claimed.alias("claimed"), F.when(pick.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(row["lid"].alias("lid"), pick.alias("rid")))).alias("out"))

    folded = cands.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.explode(F.aggregate("rows", state, step, lambda a: a["out"])).alias("m"))
    return folded.select(*keys, "m.lid", "m.rid")


def suppress(boxes: DataFrame, keys: list[str], order: list[str], threshold: float = 0.5, cap: int = 300) -> DataFrame:
    """Class-wise greedy suppression: keeps a box unless one kept before overlaps it by more than the threshold; at most cap per group."""
    row = F.struct(*order, "id", "x", "y", "w", "h")
    kind = "array<struct<id:bigint,x:bigint,y:bigint,w:bigint,h:bigint>>"

    def step(kept: Column, b: Column) -> Column:
        taken = F.exists(kept, lambda k: Box.within(k).iou(Box.within(b)) > threshold) | (F.size(kept) >= cap)
        return F.when(taken, kept).otherwise(F.array_append(kept, F.struct(*[b[c].cast("bigint").alias(c) for c in ("id", "x", "y", "w", "h")])))

    kept = F.aggregate(F.array_sort(F.collect_list(row)), F.array().cast(kind), step)
    return boxes.groupBy(*keys).agg(kept.alias("kept")).select(*keys, F.explode("kept").alias("k")).select(*keys, "k.id")
