"""Mixing sources to target weights: repetition rates, whole copies and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.base import WORD, cut, text_or_empty, uniform

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
CEILING = 3
#: Source tables of at most so many rows may be broadcast.
BROADCAST_SOURCES = 10_000
#: Ids that come more than once are broadcast up to so many.
BROADCAST_IDS = 500_000
SEED = "mix-1"


def word_count(text_col: str) -> Column:
    return F.size(F.regexp_extract_all(text_or_empty(text_col), F.lit(f"({WORD})"))).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), F.xxhash64(*docs.columns).alias("row_hash"))


def rates(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The targets are min(ceiling * size, level * weight) for the one level at which they sum to the total: sharing the
    excess again by weight until nothing is above its ceiling ends there. The level is found by Newton steps on that
    concave, piecewise linear sum: every step is one aggregate over the small table, and the set of sources at their
    ceiling only grows. Ranks come from a range sort and the number of rows of each partition.
    """
    ranked = per_source.repartitionByRange(F.col("source").asc_nulls_last()).select(F.spark_partition_id().alias("p"), "source", "source_size")
    inner = F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last()))
    ranked = cut(ranked.withColumn("i", inner - 1), "sources")
    offsets, n = [], 0
    for p, rows in sorted((r["p"], r["n"]) for r in ranked.groupBy("p").agg(F.count("*").alias("n")).collect()):
        offsets.append((p, n))
        n += rows
    if not offsets:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    before = F.create_map(*[F.lit(x) for pair in offsets for x in pair])[F.col("p")]
    place = (before + F.col("i")) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.cast("long").alias("weight"))
    total = weighed.agg(F.sum("source_size")).first()[0]
    top, level = F.col("source_size") * ceiling, 0.0
    while True:
        full = top < F.lit(level) * F.col("weight")
        s, w = weighed.agg(F.sum(F.when(full, top).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        step = (total - s) / w if w else level
        if step <= level:
            break
        level = step
    return weighed.select("source", "source_size", F.least(top.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


#: Equal rows that are written out from one at a time.
EQUAL_ROWS = 10_000


def _numbered(rows: DataFrame, ids: Column, hash_col: str) -> DataFrame:
    """rows with __draw, what each is drawn by: its id, the hash of its row and its number among equal rows.

    Equal rows are counted and written out again by number, so nothing hangs on where they lie; many of one kind are shared out.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"), F.lit(EQUAL_ROWS).cast("long")))
    dealt = counted.withColumn("__first", first)
    dealt = dealt.repartition(F.xxhash64(hash_col, "__first"))
    dealt = dealt.withColumn("__no", F.explode(F.sequence("__first", F.least(F.col("__n"), F.col("__first") + EQUAL_ROWS - 1))))
    return dealt.withColumn("__draw", F.concat_ws(":", ids, hash_col, "__no")).drop("__n", "__first", "__no")


def _rated(rows: DataFrame, id_col: str, size_col: str, source_col: str, hash_col: str, seed: str) -> DataFrame:
    """rows with __source_size, __target and __copies; only sums per source are shuffled."""
    source = F.col(source_col).cast("string")
    per = rates(rows.groupBy(source.alias("source")).agg(F.sum(size_col).alias("source_size")))
    per = per.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    per = F.broadcast(per) if per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else per
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    ids = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    several = rows.groupBy(ids.alias("__several")).agg(F.count("*").alias("__n")).where("__n > 1").select("__several")
    several = cut(several, "repeated-ids")
    if several.limit(1).count():
        several = F.broadcast(several) if several.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else several
        once = rows.join(several, ids == F.col("__several"), "left_anti").withColumn("__draw", ids)
        out = once.unionByName(_numbered(rows.join(several, ids == F.col("__several"), "left_semi"), ids, hash_col))
    else:
        out = rows.withColumn("__draw", ids)
    draw = uniform(F.col("__draw"), seed)
    out = out.join(per, source.eqNullSafe(F.col("__s"))).withColumn("__rate", rate)
    return out.withColumn("__copies", (F.floor("__rate") + F.when(draw < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies, taken.

    rate = target / source_size; a document is taken floor(rate) times and once more when a hash of its id falls under
    the fraction. Null texts have no words, a null source is a source of its own and the last. A source without words
    has rate 0. Rows of an id that comes once are drawn by the id alone; of an id (or of null) that comes more often each
    row is drawn by itself, by its id, a hash of all its columns and its number among rows equal in these, so that neither files nor
    partitions matter. An empty table
    gives an empty result. Long texts only count words. Hot sources: sums are partially aggregated, and the table of
    sources is broadcast only if it has at most BROADCAST_SOURCES rows; else Spark joins it and splits hot keys.
    """
    out = _rated(sizes(docs, id_col, text_col, source_col), "doc_id", "size", "source", "row_hash", seed)
    return out.select("doc_id", "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("size") * F.col("__copies")).alias("taken"))


def emit_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed corpus itself: the rows of docs, all columns, each as often as mix() takes it.

    Nulls, empty texts, repeated rows and empty tables as in mix(); a document taken no time is not in the result.
    """
    sized = docs.withColumn("__hash", F.xxhash64(*docs.columns)).withColumn("__size", word_count(text_col))
    out = _rated(sized, id_col, "__size", source_col, "__hash", seed)
    return out.withColumn("__copy", F.explode(F.when(F.col("__copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("__copies"))))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
s as (
  select source, sum(size)::bigint source_size,
    ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint weight
  from d group by source),
o as (
  select *, sum(source_size) over () total, 3.0::double * source_size / weight r,
    coalesce(sum(3 * source_size) over (order by 3.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) done,
    sum(weight) over (order by 3.0::double * source_size / weight, source nulls last rows between current row and unbounded following) rest
  from s),
v as (select max((total - done)::double / rest) filter ((total - done)::double / rest <= r) lvl from o),
t as (select source, source_size, least(3.0::double * source_size, (select lvl from v) * weight) target from s),
j as (
  select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end rate,
    ('0x' || substr(md5('mix-1:' || d.doc_id), 1, 13))::bigint::double / 4503599627370496.0::double u
  from d join t on d.source is not distinct from t.source),
c as (select *, (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end)::bigint copies from j)
select doc_id, size, source_size, target, size * copies taken, copies from c
"""
