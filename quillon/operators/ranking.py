"""Ranks, running sums and order statistics of groups of any size: no task holds a group, and none sorts one."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.streaming.runs import shared_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: what is worked out from it twice is worked out from the same rows."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """df dealt by ranges of key and order, with __p, the number of its range: ranges of a key follow each other, and a large key has many."""
    return written(df.repartitionByRange(key, *order).withColumn("__p", F.spark_partition_id()), "ranged")


def running(df: DataFrame, key: str, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """ranged(df) with the running sum of each column of sums, by its name, up to each row in its key's order.

    Two levels: sums within a range, and of each range and key one row, whose sums over the ranges before are added.
    """
    rows = ranged(df, key, order)
    own = Window.partitionBy("__p", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("__k").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(F.col(key).alias("__k"), F.col("__p").alias("__q")).agg(*[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()])
    per = per.select("__k", "__q", *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums])
    rows = rows.withColumns({n: F.sum(c).over(own) for n, c in sums.items()}).join(per, (F.col(key) == F.col("__k")) & (F.col("__p") == F.col("__q")))
    return rows.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in sums}).drop("__k", "__q", *[f"__before_{n}" for n in sums])


def reverse_maximum(rows: DataFrame, key: str, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """rows of running() with the greatest value from each row to its key's last."""
    # from the end of the order on: a frame that ends with the range would be gone through anew for every row
    place = F.row_number().over(Window.partitionBy("__p", key).orderBy(*order))
    own = Window.partitionBy("__p", key).orderBy(F.desc("__place")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("__k").orderBy("__q").rowsBetween(1, Window.unboundedFollowing)
    per = rows.groupBy(F.col(key).alias("__k"), F.col("__p").alias("__q")).agg(F.max(value).alias("__most"))
    per = per.select("__k", "__q", F.max("__most").over(after).alias("__after"))
    rows = rows.withColumn("__place", place).withColumn(name, F.max(value).over(own)).drop("__place").join(per, (F.col(key) == F.col("__k")) & (F.col("__p") == F.col("__q")))
    return rows.withColumn(name, F.greatest(name, "__after")).drop("__k", "__q", "__after")


#: Values between two brackets that are ordered at the end, and the share of a group by which a bracket lies beside its rank.
FEW, BESIDE = 10_000, 0.01


def selected(df: DataFrame, key: str, value: str, ranks: dict[str, Column], few: int = FEW) -> DataFrame:
    """(key, n, lo, hi, and for each of ranks the value at that place): exact, whatever the size of a group.

    ranks are expressions of n, counted from 1; a place that a group does not have gives null. Each round brackets a place by a
    sketch of the values that are left, counts what is below and between, and keeps what is between, until few distinct values are
    or all are alike. Only sums and sketches are shuffled. Null values are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    sizes = written(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    wanted = sizes.select("k", "n", "lo", "hi", F.explode(F.array(*[F.struct(F.lit(x).alias("name"), r.cast("long").alias("at")) for x, r in ranks.items()])).alias("w"))
    # rank: the place among the values from lo to hi, of which there are m
    state = written(wanted.where("w.at between 1 and n").select(F.col("k").alias("key"), "w.name", F.col("w.at").alias("rank"), F.col("n").alias("m"), "lo", "hi"), "places")
    while state.where((F.col("m") > few) & (F.col("lo") < F.col("hi"))).limit(1).count():
        wide = (F.col("m") > few) & (F.col("lo") < F.col("hi"))
        between = rows.join(state.where(wide), (F.col("k").eqNullSafe(F.col("key"))) & F.col("v").between(F.col("lo"), F.col("hi")))
        sketch = F.percentile_approx("v", F.array(*[F.lit(i / 200) for i in range(201)]), 2_000)
        per = between.groupBy("key", "name", "rank", "m", "lo", "hi").agg(sketch.alias("s"))
        share = (F.col("rank") / F.col("m") * 200)
        a = F.get("s", F.greatest(F.floor(share - 200 * BESIDE), F.lit(0)).cast("int"))
        b = F.get("s", F.least(F.ceil(share + 200 * BESIDE), F.lit(200)).cast("int"))
        per = written(per.select("key", "name", "rank", "m", "lo", "hi", a.alias("a"), b.alias("b")), "brackets")
        between = rows.join(per, (F.col("k").eqNullSafe(F.col("key"))) & F.col("v").between(F.col("lo"), F.col("hi")))
        v, is_a, is_b = F.col("v"), F.col("v") == F.col("a"), F.col("v") == F.col("b")
        inside = (v > F.col("a")) & (v < F.col("b"))
        c = between.groupBy("key", "name", "rank", "m", "lo", "hi", "a", "b").agg(
            F.count_if(v < F.col("a")).alias("below"), F.count_if(is_a).alias("at_a"), F.count_if(inside).alias("within"), F.count_if(is_b & ~is_a).alias("at_b"),
            F.max(F.when(v < F.col("a"), v)).alias("under"), F.min(F.when(inside, v)).alias("in_lo"), F.max(F.when(inside, v)).alias("in_hi"), F.min(F.when(v > F.col("b"), v)).alias("over"),
        )
        # where the place is: below a, at a, between them, at b, or above; a and b by themselves, so that every round leaves less
        rank, past_a = F.col("rank"), F.col("below") + F.col("at_a")
        past_in = past_a + F.col("within")
        past_b = past_in + F.col("at_b")

        def by(*parts: Column) -> Column:
            low, on_a, mid, on_b, high = parts
            return F.when(rank <= F.col("below"), low).when(rank <= past_a, on_a).when(rank <= past_in, mid).when(rank <= past_b, on_b).otherwise(high)

        narrow = c.select(
            "key", "name", by(rank, rank - F.col("below"), rank - past_a, rank - past_in, rank - past_b).alias("rank"), by(F.col("below"), F.col("at_a"), F.col("within"), F.col("at_b"), F.col("m") - past_b).alias("m"),
            by(F.col("lo"), F.col("a"), F.col("in_lo"), F.col("b"), F.col("over")).alias("lo"), by(F.col("under"), F.col("a"), F.col("in_hi"), F.col("b"), F.col("hi")).alias("hi"),
        )
        left = state.where(~wide)
        state = written(left.union(narrow), "places")
    # few values are left between the brackets of a place, or copies of one
    last = rows.join(state, (F.col("k").eqNullSafe(F.col("key"))) & F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("key", "name", "rank", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("key", "name").orderBy("v"))
    found = last.withColumn("upto", upto).where("upto >= rank and upto - c < rank").groupBy("key").pivot("name", list(ranks)).agg(F.first("v"))
    return sizes.join(found, F.col("k").eqNullSafe(F.col("key")), "left").drop("key")
