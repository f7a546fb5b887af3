"""What the operators share: tables in the shared folder, connected components, column helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a regex class for Java and RE2.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset (tests) a folder of this machine."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "quillon-checkpoints")


def cut(df: DataFrame, label: str = "cut", codec: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors. codec: another than the session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path  # noqa: SLF001
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Removes a table that cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_quillon_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver find the shuffles of jobs that are done, so that their files go now and not at some later time."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows that Python gets at once at most: texts are long.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's Arrow batches to BATCH_ROWS rows if they are larger, to bound workers' memory."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def other_key(name: str) -> Column:
    """A key made anew: joined on it, both sides are dealt for the join itself, and Spark can split a hot key."""
    return F.col(name).bitwiseXOR(F.lit(1))


#: Bits of a sieve as a power of two, least and most (8 MB), and how many a key has where they allow it.
SIEVE_BITS, BITS_A_KEY = (12, 26), 64


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def sieve(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A row with a bitmap (words) of the keys' hashes, and its bits as a power of two: it tells which rows of a large table may have one of the keys.

    Keys are hashes of 64 bits, as their first bits are the place. A sieve is bounded and never lets a key's row fall; with more keys it lets more others through.
    """
    bits = min(max(SIEVE_BITS[0], (keys.count() * BITS_A_KEY).bit_length()), SIEVE_BITS[1])
    place = F.shiftrightunsigned(key, 64 - bits)
    own = keys.select(F.shiftright(place, 6).alias("word"), _bit(place).alias("v"))
    words = own.union(keys.sparkSession.range(1 << (bits - 6)).select("id", F.lit(0).cast("long"))).groupBy("word").agg(F.bit_or("v").alias("v"))
    return words.agg(F.array_sort(F.collect_list(F.struct("word", "v")))["v"].alias("words")), bits


def sifted(df: DataFrame, key: Column, own: tuple[DataFrame, int], keep: bool = True) -> DataFrame:
    """The rows of df whose key, a hash of 64 bits, may be one of the sieve's, or (keep false) those whose key is none; nothing of df moves."""
    place = F.shiftrightunsigned(key, 64 - own[1])
    there = F.get("words", F.shiftright(place, 6).cast("int")).bitwiseAND(_bit(place)) != 0
    return df.join(F.broadcast(own[0]), there, "left_semi" if keep else "left_anti")


def uniform(col: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the column's text and a seed; any engine with MD5 gets the same one."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), col)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The forest of parents, smaller numbers being roots, with the edges (a, b) added; every node is a root or hangs on one."""
    while True:
        while (parent != (up := parent[parent])).any():
            parent = up
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        parent = parent.copy()
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: every node but the smallest of its component here, and that smallest one."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = joined(np.arange(len(ids)), place[: len(u)], place[len(u) :])
    hung = np.flatnonzero(root != np.arange(len(ids)))
    for at in range(0, len(hung), 100_000):
        part = hung[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), pa.array(ids[root[part]], pa.int64())], names=["u", "v"])


#: Edges that one task takes.
EDGES_A_TASK = 1_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (two long columns): (id, component), component the smallest id.

    Up to EDGES_A_TASK edges are joined by one task. Of more, every partition first turns its edges into stars, which
    keeps what they connect; then alternating star contraction: each node's larger neighbours are hung on
    its smallest neighbour, then its smaller ones are; chains halve, stars stay. Each round is a written table; only
    whether anything moved reaches the driver. Hot nodes: the smallest neighbour comes from a partially aggregated
    minimum joined back, so no neighbour list is ever gathered. Null ids are ignored.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e, "edges")
    few = e.limit(EDGES_A_TASK + 1).count() <= EDGES_A_TASK
    stars = cut((e.coalesce(1) if few else e.repartition("u")).mapInArrow(_forest, "u long, v long"), "edges")
    drop_cut(e)
    e = stars
    for _ in range(0 if few else max_rounds):
        # at rest once every child has one parent and no parent is a child
        roles = e.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(e.select("v", F.lit(0), F.lit(1)))
        if not roles.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c > 0 and p > 0)").limit(1).count():
            break
        # large star: from both directions, larger neighbours of u get u's smallest neighbour (or u itself)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # joined on a key made anew, so that Spark can split the rows of a hot node
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(other_key("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, other_key("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours of u, and u, get u's smallest neighbour
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low2.select(other_key("u").alias("k"), "m"), other_key("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = hung.union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = cut(stars.repartition("u").mapInArrow(_forest, "u long, v long"), "edges")
        drop_cut(e)
        e = nxt
    else:
        if not few:
            raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
