"""Hard-negative mining by bit-sliced integer products: score intervals tighten from bit plane to bit plane."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.base import cut, drop_cut

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's.
BAND = (30, 90)
SCALE = 256
#: Rows of a block of anchors and of a block of candidates; a task holds a matrix of scores of one times the other.
ANCHOR_BLOCK, BLOCK = 256, 4096
#: Once fewer pairs than this share of a block are left, planes are added pair by pair.
SPARSE = 1 / 16
#: Components from here on may give scores beyond a long; rows that have such take no part.
LARGEST = 2**26
_NO_ID = np.iinfo(np.int64).max


class Packed(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by (dim, block) as one row a block, with its columns' bytes."""
    names = ["dim", "block", "ids", "labels", "q"]

    def row(key: tuple[int, int], parts: list) -> pa.RecordBatch:
        ids, labels, q = (b"".join(p[i] for p in parts) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids], pa.binary()), pa.array([labels], pa.binary()), pa.array([q], pa.binary())], names=names)

    at, parts = None, []
    for b in batches:
        dim, block, ids, labels = (b.column(c).to_numpy() for c in ("dim", "block", "id", "label"))
        flat = b.column("q")
        cuts = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (block[1:] != block[:-1])]) if b.num_rows else []
        for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
            key = (int(dim[lo]), int(block[lo]))
            if key != at:
                if parts:
                    yield row(at, parts)
                at, parts = key, []
            parts.append((ids[lo:hi].tobytes(), labels[lo:hi].tobytes(), flat.slice(lo, hi - lo).flatten().to_numpy().tobytes()))
    if parts:
        yield row(at, parts)


def _unpacked(dim: int, ids: bytes, labels: bytes, q: bytes) -> Packed:
    own = np.frombuffer(ids, np.int64)
    return Packed(own, np.frombuffer(labels, np.int64), np.frombuffer(q, np.int64).reshape(len(own), dim))


#: Planes that are left when intervals are first compared: wider ones drop nothing.
FIRST_CHECK = 6


class Sliced:
    """Scores of all pairs (anchor, candidate) of two blocks as intervals, one bit plane of the candidates at a time.

    Components are made non-negative by an offset, so that score = sum of 2^k * (plane_k . anchor) - offset * sum(anchor).
    With the planes from k on added, what is missing lies between (2^k - 1) times the anchor's negative and its positive sum.
    """

    def __init__(self, anchors: np.ndarray, cands: np.ndarray, alive: np.ndarray) -> None:
        offset = max(0, -int(cands.min(initial=0)))
        self.u = cands + offset
        self.left = int(self.u.max(initial=0)).bit_length()
        worst = (float(offset) + 2.0**self.left) * float(np.abs(anchors).sum(1).max(initial=0))
        kind = np.float32 if worst < 2**24 else np.float64 if worst < 2**53 else np.int64  # each is exact up to there
        self.a = anchors.astype(kind)
        self.low, self.high = np.minimum(self.a, 0).sum(1), np.maximum(self.a, 0).sum(1)
        self.score = np.repeat(-offset * self.a.sum(1)[:, None], len(cands), 1).astype(kind)
        self.alive = alive
        self.pairs: tuple[np.ndarray, np.ndarray] | None = None

    def step(self) -> None:
        """Adds the most significant plane that is missing."""
        self.left -= 1
        plane = (self.u >> self.left & 1).astype(self.a.dtype)
        weight = self.a.dtype.type(2**self.left)
        if self.pairs is None:
            self.score += (self.a * weight) @ plane.T
        else:
            a, c = self.pairs
            for at in range(0, len(c), 65_536):
                part = slice(at, at + 65_536)
                self.score[part] += np.einsum("ij,ij->i", self.a[a[part]], plane[c[part]]) * weight

    def spread(self, of_anchor: np.ndarray) -> np.ndarray:
        """A value of each anchor beside the scores."""
        return of_anchor[:, None] if self.pairs is None else of_anchor[self.pairs[0]]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        rest = self.a.dtype.type(2**self.left - 1)
        return self.score + self.spread(self.low * rest), self.score + self.spread(self.high * rest)

    def at_least(self, low: np.ndarray, usable: np.ndarray, k: int) -> np.ndarray:
        """What k usable candidates of each anchor surely reach; less than any score where it has fewer."""
        none = np.finfo(low.dtype).min if low.dtype.kind == "f" else np.iinfo(low.dtype).min
        out = np.full(len(self.a), none, low.dtype)
        if self.pairs is None:
            if low.shape[1] >= k:
                out = np.partition(np.where(usable, low, none), low.shape[1] - k, axis=1)[:, low.shape[1] - k]
            return out
        a, v = self.pairs[0][usable], low[usable]
        v = v[np.lexsort((-v, a))]  # pairs come by anchor
        first = np.searchsorted(a, np.arange(len(out)))
        has = np.searchsorted(a, np.arange(len(out)), "right") - first >= k
        out[has] = v[first[has] + k - 1]
        return out

    def keep(self, alive: np.ndarray) -> None:
        """Drops candidates; goes over to single pairs when few are left."""
        if self.pairs is None:
            self.alive = alive
            if np.count_nonzero(alive) < SPARSE * alive.size:
                self.pairs = np.nonzero(alive)
                self.score = self.score[self.pairs]
        elif not alive.all():
            self.pairs = (self.pairs[0][alive], self.pairs[1][alive])
            self.score = self.score[alive]

    def living(self) -> np.ndarray:
        return self.alive if self.pairs is None else np.ones(len(self.score), bool)

    def left_over(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, candidate, score), exact now, by anchor, best score, least id."""
        a, c = np.nonzero(self.alive) if self.pairs is None else self.pairs
        score = (self.score[a, c] if self.pairs is None else self.score).astype(np.int64)
        order = np.lexsort((ids[c], -score, a))
        return a[order], c[order], score[order]


def nearest(anchors: Packed, cands: Packed, k: int = POSITIVES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, candidate place, score) of each anchor's k best candidates of its label with another id; ties by id."""
    out = [(np.zeros(0, np.int64),) * 3]
    for label in np.intersect1d(anchors.labels, cands.labels):
        ai, ci = np.flatnonzero(anchors.labels == label), np.flatnonzero(cands.labels == label)
        s = Sliced(anchors.q[ai], cands.q[ci], cands.ids[ci] != anchors.ids[ai][:, None])
        while s.left:
            s.step()
            if s.left <= FIRST_CHECK:
                low, high = s.bounds()
                alive = s.living()
                s.keep(alive & (high >= s.spread(s.at_least(low, alive, k))))
        a, c, score = s.left_over(cands.ids[ci])
        top = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((ai[a[top]], ci[c[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def banded(anchors: Packed, cands: Packed, of: np.ndarray, least: np.ndarray, most: np.ndarray, k: int = NEGATIVES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, candidate place, score): for each window (anchor place, least, most) the k best candidates of another
    label whose score lies within it, ties by id. Windows come by anchor place; a pair stays as long as one may take it."""
    n = len(anchors.ids)
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    s = Sliced(anchors.q, cands.q, cands.labels != anchors.labels[:, None])
    layers = []
    for i in range(int(nth.max(initial=-1)) + 1):
        window = np.flatnonzero(nth == i)
        lo, hi, name = np.full(n, 2**62), np.full(n, -(2**62)), np.full(n, -1)
        lo[of[window]], hi[of[window]], name[of[window]] = least[window], most[window], window
        layers.append((lo, hi, name))
    while s.left:
        s.step()
        if s.left <= FIRST_CHECK:
            low, high = s.bounds()
            alive = s.living()
            wanted = np.zeros_like(alive)
            for lo, hi, _ in layers:
                lo, hi = s.spread(lo), s.spread(hi)
                sure = s.at_least(low, alive & (low >= lo) & (high <= hi), k)
                wanted |= (high >= lo) & (low <= hi) & (high >= s.spread(sure))
            s.keep(alive & wanted)
    a, c, score = s.left_over(cands.ids)
    out = [(np.zeros(0, np.int64),) * 3]
    for lo, hi, name in layers:
        inside = np.flatnonzero((score >= lo[a]) & (score <= hi[a]))
        top = inside[np.arange(len(inside)) - np.searchsorted(a[inside], a[inside]) < k]
        out.append((name[a[top]], c[top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sides(row: dict) -> tuple[Packed, Packed]:
    return tuple(_unpacked(row["dim"], *(row[side + c] for c in ("ids", "labels", "q"))) for side in ("a_", ""))


def _emitted(row: dict, schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    own = [np.full(n, row["dim"]), np.full(n, row["a_block"]), *columns]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(own, schema, strict=True)], schema=schema)


def _positives(k: int) -> Callable:
    schema = pa.schema([("dim", pa.int32()), ("a_block", pa.int32()), ("place", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            anchors, cands = _sides(row)
            a, c, score = nearest(anchors, cands, k)
            yield _emitted(row, schema, a, anchors.ids[a], cands.ids[c], score)

    return run


def _negatives(k: int, band: tuple[int, int]) -> Callable:
    names = ("place", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    schema = pa.schema([("dim", pa.int32()), ("a_block", pa.int32()), *((x, pa.int64()) for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            anchors, cands = _sides(row)
            asked = np.array(sorted(tuple(w[x] for x in names[:5]) for w in row["asked"]), np.int64)
            least = np.array([-(-band[0] * int(x) // 100) for x in asked[:, 4]])
            most = np.array([band[1] * int(x) // 100 for x in asked[:, 4]])
            w, c, score = banded(anchors, cands, asked[:, 0], least, most, k)
            yield _emitted(row, schema, *asked[w].T, cands.ids[c], score)

    return run


def _blocked(rows: DataFrame, size: int, label: str) -> tuple[DataFrame, dict[int, int]]:
    """rows (dim, id, label, q) dealt by a hash to blocks of about size rows, a row each: dim, block, ids, labels, q; and the blocks of each dim."""
    counts = {r["dim"]: -(-r["n"] // size) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    # the hash takes the vector too, so that rows repeated with one id are dealt out
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "q"), _of_dim(counts)).cast("int"))
    packed = dealt.repartition("dim", "block").sortWithinPartitions("dim", "block", "id", "label", F.xxhash64("q"))
    return cut(packed.mapInArrow(_pack, "dim int, block int, ids binary, labels binary, q binary"), label), counts


def _of_dim(counts: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in (counts or {0: 1}).items() for x in pair]), F.col("dim"))


def _tiles(anchors: DataFrame, a_counts: dict[int, int], cands: DataFrame, c_counts: dict[int, int]) -> DataFrame:
    """Every block of anchors beside every block of candidates of its dim, one row each, dealt out by both numbers."""
    numbers = lambda counts: F.explode(F.sequence(F.lit(0), F.coalesce(_of_dim(counts), F.lit(0)) - 1, F.lit(1)))
    a = anchors.select("dim", F.col("block").alias("a_block"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "q")], *anchors.columns[5:]).where(F.col("dim").isin(*c_counts))
    a = a.withColumn("block", numbers(c_counts))
    c = cands.where(F.col("dim").isin(*a_counts)).withColumn("a_block", numbers(a_counts))
    return a.hint("shuffle_hash").join(c, ["dim", "a_block", "block"])


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 * x) in double precision, scores are integer inner products. Anchors are the rows whose
    id is divisible by `every`; an anchor's positives are its best rows of the same label and another id, its negatives for a positive
    the best rows of another label that score within `band` hundredths of it; ties go to the smaller id. Every pair of a block of anchors and
    a block of candidates is a task's work: candidates' bit planes are added from the most significant down, each pair
    keeps an interval of scores, and pairs go as soon as enough others surely beat them or their interval leaves the
    band. Only the best few of a block leave the task.

    Null labels, null vectors and vectors with a null, NaN or infinite component take no part, nor do vectors with a
    component of 2^26 / 256 or more in size, whose scores may not fit; vectors of different lengths do not meet. An empty vector
    scores 0. A null id is never an anchor and comes after all others. Rows repeated with one id are rows of their own,
    but never each other's positives. An empty table gives an empty result; other columns are ignored.
    """
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(v * SCALE))
    finite = F.forall(F.col(vector_col).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * SCALE < LARGEST))
    rows = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.size(vector_col).alias("dim"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("q"), F.col(id_col).isNull().alias("anonymous"))
    cands, c_counts = _blocked(rows.drop("anonymous"), BLOCK, "candidates")
    anchors, a_counts = _blocked(rows.where(~F.col("anonymous") & (F.col("id") % every == 0)).drop("anonymous"), ANCHOR_BLOCK, "anchors")
    key = ["dim", "a_block", "place"]
    best = _tiles(anchors, a_counts, cands, c_counts).mapInArrow(_positives(positives), "dim int, a_block int, place long, anchor_id long, positive_id long, positive_score long")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("positive_score"), "positive_id"))
    best = best.withColumn("nth", nth).where(F.col("nth") <= positives)
    asked = best.groupBy("dim", F.col("a_block").alias("block")).agg(F.collect_list(F.struct("place", "nth", "anchor_id", "positive_id", "positive_score")).alias("asked"))
    asked = cut(anchors.join(asked, ["dim", "block"]), "asked")
    found = _tiles(asked, a_counts, cands, c_counts).mapInArrow(_negatives(negatives, band), "dim int, a_block int, place long, nth long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy(*key, "nth").orderBy(F.desc("negative_score"), "negative_id"))
    found = cut(found.withColumn("rank", rank).where(F.col("rank") <= negatives), "negatives")
    for table in (cands, anchors, asked):
        drop_cut(table)
    known = lambda c: F.when(F.col(c) < _NO_ID, F.col(c)).alias(c)
    return found.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


ORACLE = """
with v as (
  select row_number() over () rid, vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
  select a.rid, a.id anchor_id, b.id, a.l = b.l same, list_inner_product(a.q, b.q)::bigint score
  from v a join v b on a.id % 100 = 0 and len(a.q) = len(b.q) and b.id is distinct from a.id),
p as (
  select * from (select rid, anchor_id, id positive_id, score positive_score, row_number() over (partition by rid order by score desc, id) n from s where same) where n <= 5),
r as (
  select p.rid, p.n, p.anchor_id, positive_id, positive_score, s.id negative_id, s.score negative_score, row_number() over (partition by p.rid, p.n order by s.score desc, s.id) rank
  from p join s on s.rid = p.rid and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank::int rank, negative_id, positive_score, negative_score from r where rank <= 10
"""
