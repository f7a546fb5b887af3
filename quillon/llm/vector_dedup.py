"""Embedding near-dedup: a subspace pigeonhole join of rotated vectors.

Unit vectors at a cosine of 0.9 or more are at a squared distance of at most 0.2. After a rotation to the principal axes
of a bounded sample they are split into low-dimensional blocks of about equal variance, and each block gets a share of
that budget in proportion to its variance: a linked pair keeps within the budget of at least one block, whatever the
rotation and the shares. Each block is range-joined on its own over cells of a k-d tree, and the union of what the blocks
let through is verified with the whole vectors in double precision. Blocks that no cell can part are joined together,
over one copy of the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.base import components, cut, drop_cut, joined

COSINE = 0.9
BLOCKS = 4
#: Added to every range, so that rounding never loses a pair; verification decides.
SLACK = 1e-9
#: Vectors that shape the axes and cells at most, and rows of a cell a leaf is meant to have.
SAMPLE, LEAF_ROWS = 20_000, 4_000
MOST_LEAVES = 4_096
#: Rows of a tile: a cell is compared in pairs of tiles, STRIP rows of one with all of the other at a time.
TILE, STRIP = 16_000, 1_000
SEED = 20_240_901
#: The number of the cell in which all blocks that are not parted are joined together.
TOGETHER = 0xFF


def rotation(sample: np.ndarray, dim: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(orthogonal matrix, variance along its columns): the principal axes of a sample, or a fixed random matrix if it is too small to have any."""
    if len(sample) > dim:
        variance, q = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim))
        return np.ascontiguousarray(q[:, ::-1]), np.maximum(variance[::-1], 0)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r)), np.ones(dim)


def parted(variance: np.ndarray, blocks: int, budget: float) -> list[tuple[np.ndarray, float]]:
    """(columns, squared budget) of each block: neighbouring axes of about equal variance together; budgets are in proportion to it and add up."""
    variance = variance + 1e-6 * max(float(variance.sum()), 1e-12) / len(variance) + 1e-12
    share = np.cumsum(variance) / variance.sum()
    block = np.minimum((share - variance / variance.sum() / 2) * blocks, blocks - 1).astype(int)
    columns = [np.flatnonzero(block == k) for k in range(blocks) if (block == k).any()]
    return [(c, budget * float(variance[c].sum() / variance.sum())) for c in columns]


def unit_rows(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of usable vectors, their unit vectors as doubles). All usable vectors of a batch have one length, the first's."""
    rows = values.to_pylist()
    usable = [i for i, v in enumerate(rows) if v and None not in v]
    if not usable:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    x = [np.asarray(rows[i], dtype=np.float64) for i in usable]
    with np.errstate(all="ignore"):
        norm = np.array([np.sqrt(v @ v) if np.isfinite(v).all() else 0.0 for v in x])
        # squares of very small or large numbers leave the range of doubles: such rows are scaled first
        for k in np.flatnonzero((norm == 0) | ~np.isfinite(norm)):
            top = np.abs(x[k]).max() if np.isfinite(x[k]).all() else 0.0
            if top > 0:
                x[k] = x[k] / top
                norm[k] = np.sqrt(x[k] @ x[k])
    good = [k for k in range(len(usable)) if norm[k] > 0]
    return np.array([usable[k] for k in good], np.int64), np.array([x[k] / norm[k] for k in good]) if good else np.zeros((0, 0))


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim, unit: usable vectors as unit vectors (bytes of doubles)."""
    for batch in batches:
        kinds: dict[int, list[int]] = {}
        for i, v in enumerate(batch.column("embedding").to_pylist()):
            kinds.setdefault(len(v) if v else 0, []).append(i)
        for dim, places in kinds.items():
            if dim:
                part = batch.take(pa.array(places))
                at, u = unit_rows(part.column("embedding"))
                if len(at):
                    ids = part.column("vec_id").take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([dim] * len(at), pa.int32()), pa.array([row.tobytes() for row in u], pa.binary())], names=["vec_id", "dim", "unit"])


class Cells:
    """A k-d tree over one block's coordinates: where a vector is at home and what cells its range touches."""

    def __init__(self, points: np.ndarray, radius: float, leaves: int):
        self.radius, self.cuts, self.leaves = radius, [], 0
        self._split(points, leaves)

    def _split(self, points: np.ndarray, leaves: int) -> int:
        """Number of the subtree; a leaf is ~number. A cut that puts most rows in range of both sides is no gain."""
        if leaves > 1 and len(points) >= 2 * leaves:
            spread = np.var(points, axis=0)
            for axis in np.argsort(-spread)[:4]:
                at = float(np.median(points[:, axis]))
                both = np.mean(np.abs(points[:, axis] - at) <= self.radius)
                if both < 0.6:
                    node = len(self.cuts)
                    self.cuts.append(None)
                    low = points[:, axis] < at
                    self.cuts[node] = (int(axis), at, self._split(points[low], leaves // 2), self._split(points[~low], leaves - leaves // 2))
                    return node
        self.leaves += 1
        return ~(self.leaves - 1)

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, at home there) for every leaf that a row's range touches."""
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        todo = [(0 if self.cuts else ~0, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, rows, home = todo.pop()
            if node < 0:
                out.append((rows, ~node, home))
                continue
            axis, at, low, high = self.cuts[node]
            x = points[rows, axis]
            for child, inside, near in ((low, x < at, x < at + self.radius), (high, x >= at, x >= at - self.radius)):
                if near.any():
                    todo.append((child, rows[near], home[near] & inside[near]))
        return np.concatenate([r for r, _, _ in out]), np.concatenate([np.full(len(r), leaf) for r, leaf, _ in out]), np.concatenate([h for _, _, h in out])


@dataclass
class Shape:
    """How vectors of one length are turned, split and parted into cells."""

    q: np.ndarray
    blocks: list[tuple[np.ndarray, float]]
    cells: list[Cells]

    @property
    def whole(self) -> list[int]:
        """Blocks of one cell only."""
        return [k for k, c in enumerate(self.cells) if not c.cuts]


def shaped(sample: np.ndarray, dim: int, n: int, blocks: int, cosine: float) -> Shape:
    q, variance = rotation(sample, dim)
    split = parted(variance, min(blocks, dim), 2 * (1 - cosine))
    turned, leaves = sample @ q, min(MOST_LEAVES, max(1, n // LEAF_ROWS))
    return Shape(q, split, [Cells(turned[:, c], np.sqrt(m) + SLACK, leaves) for c, m in split])


def _spread(shapes: dict[int, Shape]) -> Callable:
    """A row per cell that a class touches, and one for all blocks that are not parted: cell, home, cls, weight, unit."""
    names = ["cell", "home", "cls", "weight", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part, shape = batch.filter(pa.array(dims == dim)), shapes[int(dim)]
                if shape.whole:
                    cell = np.full(part.num_rows, (int(dim) << 32) + (TOGETHER << 24))
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.ones(part.num_rows, bool)), *(part.column(c) for c in names[2:])], names=names)
                if len(shape.whole) == len(shape.blocks):
                    continue
                turned = np.frombuffer(b"".join(part.column("unit").to_pylist())).reshape(-1, dim) @ shape.q
                for k, (tree, (columns, _)) in enumerate(zip(shape.cells, shape.blocks, strict=True)):
                    if not tree.cuts:
                        continue
                    rows, leaf, home = tree.place(turned[:, columns])
                    for i in range(0, len(rows), 5_000):
                        r = pa.array(rows[i : i + 5_000])
                        cell = (int(dim) << 32) + (k << 24) + leaf[i : i + 5_000]
                        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(home[i : i + 5_000]), *(part.column(c).take(r) for c in names[2:])], names=names)

    return run


def _compared(shapes: dict[int, Shape], least: float) -> Callable:
    """Links within tiles: (cls, n, low): vectors linked to cls in this pair of tiles, and a class it links with.

    Rows come sorted by (cell, first, second, side). A pair counts in the first of its parted blocks that lets it
    through, or where all other blocks are, and in the cell where the row with the smaller class is at home. Links are
    counted and joined as they are found; none is kept.
    """

    def flush(cell: int, first: int, second: int, parts: list[tuple]) -> pa.RecordBatch:
        shape, k = shapes[cell >> 32], (cell >> 24) & 0xFF
        side, home, cls, weight = (np.concatenate([p[i] for p in parts]) for i in range(4))
        u = np.frombuffer(b"".join(p[4] for p in parts)).reshape(-1, cell >> 32)
        a = np.flatnonzero(side == 0)
        b = a if first == second else np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["cls", "n", "low"])
        here = shape.whole if k == TOGETHER else [k]
        before = [j for j in range(len(shape.blocks)) if j not in shape.whole and (k == TOGETHER or j < k)]
        sides = []
        for j in here:
            # x.y - |x|^2/2 - |y|^2/2 >= -budget/2 as one product; single precision with room for its rounding
            x = (u @ shape.q[:, shape.blocks[j][0]]).astype(np.float32)
            half, one = (x * x).sum(1, keepdims=True) / -2, np.ones((len(x), 1), np.float32)
            sides.append((np.hstack([x[a], half[a], one[a]]), np.ascontiguousarray(np.hstack([x[b], one[b], half[b]]).T), np.float32(-shape.blocks[j][1] / 2 - 1e-5)))
        n, parent = np.zeros(len(cls), np.int64), np.arange(len(cls))
        for at in range(0, len(a), STRIP):
            near = None
            for left, right, bound in sides:
                within = left[at : at + STRIP] @ right >= bound
                near = within if near is None else np.logical_or(near, within, out=near)
            places = np.flatnonzero(near)
            for lo in range(0, len(places), 100_000):  # crowds of copies: a bounded number of pairs at a time
                i, j = np.divmod(places[lo : lo + 100_000], len(b))
                i, j = a[at + i], b[j]
                # of a pair's two cells the one where the smaller class is at home counts
                keep = np.where(cls[i] < cls[j], home[i], home[j]) & ((cls[i] < cls[j]) if first == second else (cls[i] != cls[j]))
                i, j = i[keep], j[keep]
                good = np.einsum("ij,ij->i", u[i], u[j]) >= least
                i, j = i[good], j[good]
                if not len(i):
                    continue
                turned = (u[i] - u[j]) @ shape.q

                def gap(block: int, turned: np.ndarray = turned) -> np.ndarray:
                    columns, budget = shape.blocks[block]
                    return (turned[:, columns] ** 2).sum(1) <= budget + SLACK

                good = np.logical_or.reduce([gap(x) for x in here])
                for x in before:
                    good &= ~gap(x)
                i, j = i[good], j[good]
                np.add.at(n, i, weight[j])
                np.add.at(n, j, weight[i])
                parent = joined(parent, i, j)
        low = np.full(len(cls), np.iinfo(np.int64).max)
        np.minimum.at(low, parent, cls)
        low, linked = low[parent], n > 0
        return pa.RecordBatch.from_arrays([pa.array(cls[linked]), pa.array(n[linked]), pa.array(low[linked])], names=["cls", "n", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            cell, first, second = (batch.column(c).to_numpy() for c in ("cell", "first", "second"))
            cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if batch.num_rows else []
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                key = (int(cell[lo]), int(first[lo]), int(second[lo]))
                if key != at:
                    if parts:
                        yield flush(*at, parts)
                    at, parts = key, []
                part = batch.slice(lo, hi - lo)
                columns = [part.column(c).to_numpy(zero_copy_only=False) for c in ("side", "home", "cls", "weight")]
                parts.append((*columns, b"".join(part.column("unit").to_pylist())))
        if parts:
            yield flush(*at, parts)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing; vectors of
    different lengths do not link. Equal unit vectors are one class: they link with each other and are compared once,
    however many there are. Rows repeated with one id count as vectors of their own; null ids lose against any other. An
    empty table gives an empty result; other columns are ignored. Axes and cells come from a bounded sample and only
    decide where a pair is compared. Crowded cells are compared in pairs of tiles, so a task
    holds two tiles, and only counts and one link per row leave it.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    units = rows.mapInArrow(_normal, "vec_id long, dim int, unit binary").withColumn("h", F.sha2("unit", 256))
    units = cut(units, "units")
    classes = units.groupBy("h").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    classes = cut(classes.withColumn("cls", F.xxhash64("h")), "vector-classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shapes = {}
    for dim, n in sizes.items():
        share = max(1, n // SAMPLE)
        picked = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("h"), F.lit(share)) == 0)).orderBy("h").limit(SAMPLE).select("unit").toArrow()["unit"].to_pylist()
        shapes[dim] = shaped(np.frombuffer(b"".join(picked)).reshape(-1, dim) if picked else np.zeros((0, dim)), dim, n, blocks, cosine)
    placed = cut(classes.select("cls", "dim", "weight", "unit").mapInArrow(_spread(shapes), "cell long, home boolean, cls long, weight long, unit binary"), "cells")
    tiles = placed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).select(F.concat(F.lit("c"), "cell").alias("tc"), "tiles")
    tiled = placed.join(tiles, F.concat(F.lit("c"), F.col("cell")) == F.col("tc")).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("first"), F.greatest("tile", t).alias("second"), F.when(F.col("tile") > t, 1).otherwise(0).alias("side")))
    tiled = tiled.withColumn("pair", F.explode(pair)).select("cell", "pair.first", "pair.second", "pair.side", "home", "cls", "weight", "unit")
    found = tiled.repartition("cell", "first", "second").sortWithinPartitions("cell", "first", "second", "side", "cls").mapInArrow(_compared(shapes, cosine), "cls long, n long, low long")
    found = cut(found, "vector-links")
    degree = found.groupBy("cls").agg(F.sum("n").alias("n"))
    comp = components(found.where("cls <> low"), "cls", "low")
    per = classes.join(degree.withColumnRenamed("cls", "d"), F.col("cls") == F.col("d"), "left").join(comp, F.col("cls") == F.col("id"), "left")
    per = per.select("h", "least_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cls").alias("c"))
    root = per.groupBy("c").agg(F.min("least_id").alias("component_id")).select(F.concat(F.lit("c"), "c").alias("rc"), "component_id")
    drop_cut(placed)
    per = cut(per.join(root, F.concat(F.lit("c"), F.col("c")) == F.col("rc")).select(F.col("h").alias("ch"), "n_links", "component_id"), "per-class")
    linked = units.select("vec_id", "h").join(per, F.col("h") == F.col("ch"))
    # rows without a usable vector come back from the input
    bad = F.col("embedding").isNull() | (F.size("embedding") == 0) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall("embedding", lambda x: x == 0)
    alone = rows.where(F.coalesce(bad, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = r"""
with recursive x as (select vec_id, embedding::double[] e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0),
l as materialized (select a.vec_id u, b.vec_id v from x a join x b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, root) as (select vec_id, vec_id from x union select l.v, r.root from r join l on l.u = r.vec_id),
n as (select u, count(*) n from l group by u),
c as (select vec_id, min(root) root from r group by vec_id)
select e.vec_id, coalesce(n.n, 0)::bigint n_links, coalesce(c.root, e.vec_id) component_id, e.vec_id = coalesce(c.root, e.vec_id) kept
from embeddings e left join n on n.u = e.vec_id left join c on c.vec_id = e.vec_id
"""
