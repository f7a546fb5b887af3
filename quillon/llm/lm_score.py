"""LM scoring by masked pseudo-likelihood: a bidirectional window network in numpy predicts every token from both sides."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.base import cut, drop_cut, small_batches, text_or_empty
from quillon.llm.words import word_hashes

#: Words share so many rows of the embedding by hash; row 0 stands for places before and after a text.
ROWS, WIDTH, SIDE = 1 << 15, 16, 2
#: Rows are put into so many classes of about equal count: a token is its class, then its word in the class by a binary tree, both given both sides.
CLASSES = 32
#: Rounds of averaged training; each takes every ROUNDS-th run of BLOCK places of every text, all rounds together every place once.
ROUNDS, BLOCK = 2, 256
BATCH, RATE = 1024, 0.08
SEED = 7


@dataclass
class Tree:
    """Per row the nodes from its class down to it: nodes[start[row] : start[row + 1]], the side taken at each (1 or -1), and the log odds of side 1 by counts."""

    start: np.ndarray
    nodes: np.ndarray
    side: np.ndarray
    odds: np.ndarray

    def paths(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and sides on the ways to the targets, one after another, and the place of each one's target."""
        first = self.start.take(target)
        n = self.start.take(target + 1) - first
        of = np.repeat(np.arange(len(target)), n)
        at = np.arange(len(of)) + np.repeat(first - (np.cumsum(n) - n), n)
        return self.nodes.take(at), self.side.take(at), of


def grown(order: np.ndarray, smooth: np.ndarray, of_row: np.ndarray) -> Tree:
    """A tree for each class, its rows split by half of their count again and again; without training a word gets its share of the class."""
    mass = np.r_[0.0, np.cumsum(smooth[order])]
    cuts = np.r_[0, np.flatnonzero(np.diff(of_row[order])) + 1, len(order)].tolist()
    todo, spans, odds = list(zip(cuts[:-1], cuts[1:], strict=True)), [], []
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            half = min(max(int(np.searchsorted(mass, (mass[a] + mass[b]) / 2)), a + 1), b - 1)
            odds.append(np.log((mass[b] - mass[half]) / (mass[half] - mass[a])))
            spans.append((a, half, b))
            todo += [(a, half), (half, b)]
    a, half, b = np.array(spans).reshape(-1, 3).T
    node = np.repeat(np.arange(len(a)), b - a)
    leaf = np.arange(len(node)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
    row = order[leaf]
    by_row = np.argsort(row, kind="stable")
    side = np.where(leaf >= half[node], 1, -1).astype(np.float32)
    start = np.r_[0, np.cumsum(np.bincount(row, minlength=ROWS))]
    return Tree(start, node[by_row].astype(np.int32), side[by_row], np.array(odds, np.float32))


@dataclass
class Network:
    """embedding has the words' rows, then those of the trees' nodes; weights and bias give the classes, then what nodes are multiplied with."""

    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    of_row: np.ndarray
    tree: Tree

    def contexts(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of the embedding around places of a padded text."""
        steps = np.array([k for k in range(-SIDE, SIDE + 1) if k])
        return rows.take(at[:, None] + steps[None, :])

    def log_classes(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hidden layer, log P of the classes, and the vectors that nodes are multiplied with."""
        # take() gathers rows several times as fast as an index does
        h = np.tanh(self.embedding.take(around.ravel(), axis=0).reshape(len(around), -1))
        z = h @ self.weights + self.bias
        logp = np.minimum(z[:, :CLASSES], 60)
        return h, logp - np.log(np.exp(logp).sum(1, keepdims=True)), np.ascontiguousarray(z[:, CLASSES:])

    def astray(self, c: np.ndarray, nodes: np.ndarray, side: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """exp(-s) for each node on a way, 1 / (1 + exp(-s)) being the probability of the side taken; the nodes' and the targets' vectors."""
        node, own = self.embedding.take(ROWS + nodes, axis=0), c.take(of, axis=0)
        s = side * (self.tree.odds.take(nodes) + np.einsum("ij,ij->i", node, own))
        return np.exp(np.minimum(-s, 60)), node, own

    def log_tokens(self, rows: np.ndarray) -> np.ndarray:
        """log P(token | both sides) at every place of padded rows but the first and last SIDE."""
        n = len(rows) - 2 * SIDE
        # a place's window is 2 * SIDE + 1 rows in a row; the place itself counts for nothing
        half = SIDE * WIDTH
        weights = np.concatenate([self.weights[:half], np.zeros((WIDTH, self.weights.shape[1]), np.float32), self.weights[half:]])
        seen = np.tanh(self.embedding.take(rows, axis=0))
        windows = np.lib.stride_tricks.as_strided(seen, (n, len(weights)), seen.strides, writeable=False)
        z = np.ascontiguousarray(windows) @ weights + self.bias
        logp, target = np.minimum(z[:, :CLASSES], 60), rows[SIDE : SIDE + n].astype(np.int64)
        norm = np.log(np.exp(logp).sum(1))
        nodes, side, of = self.tree.paths(target)
        away = np.log1p(self.astray(np.ascontiguousarray(z[:, CLASSES:]), nodes, side, of)[0])
        return logp[np.arange(n), self.of_row.take(target)].astype(np.float64) - norm - np.bincount(of, away, n)


def text_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the embedding rows of its words, A-Z lowered."""
    for _, bounds, h in word_hashes(texts):
        rows = (h % np.uint64(ROWS - 1)).astype(np.int32) + 1
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield rows[a:b]


def fresh(counts: np.ndarray) -> Network:
    """An untrained network over the corpus's counts of rows."""
    smooth = counts.astype(float) + 0.5
    order = np.argsort(-smooth, kind="stable")
    mass = np.cumsum(smooth[order])
    of_row = np.empty(ROWS, np.int64)
    of_row[order] = np.minimum((mass - smooth[order] / 2) / mass[-1] * CLASSES, CLASSES - 1).astype(np.int64)
    in_class = np.bincount(of_row, smooth, CLASSES)
    rng = np.random.default_rng(SEED)
    share = np.maximum(in_class, 1e-9) / in_class.sum()
    words = (rng.standard_normal((ROWS, WIDTH)) * 0.1).astype(np.float32)
    return Network(
        np.concatenate([words, np.zeros_like(words)]), (rng.standard_normal((2 * SIDE * WIDTH, CLASSES + WIDTH)) * 0.1).astype(np.float32),
        np.r_[np.log(share), np.zeros(WIDTH)].astype(np.float32), of_row, grown(order, smooth, of_row),
    )


def summed(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows of WIDTH floats; two floats at a time as one complex number, which takes half as long."""
    return np.add.reduceat(rows.view(np.complex64), starts, axis=0).view(np.float32)


class Trainer:
    """Adagrad on cross entropy over batches of places; remembers how often each row was used."""

    def __init__(self, net: Network):
        self.net = Network(net.embedding.copy(), net.weights.copy(), net.bias.copy(), net.of_row, net.tree)
        self.g_e = np.full(2 * ROWS, 1e-3, np.float32)
        self.g_w, self.g_b = np.full_like(net.weights, 1e-3), np.full_like(net.bias, 1e-3)
        self.used, self.steps = np.zeros(2 * ROWS, np.int64), 0

    def step(self, rows: np.ndarray, at: np.ndarray) -> None:
        """Learns the tokens at the places of padded rows. A place's row is fetched once, and once changed, for all windows it is in."""
        net, n = self.net, len(at)
        steps = np.array([k for k in range(-SIDE, SIDE + 1) if k])
        seen, target = np.tanh(net.embedding.take(rows, axis=0)), rows.take(at).astype(np.int64)
        h = seen.take((at[:, None] + steps).ravel(), axis=0).reshape(n, -1)
        z = h @ net.weights + net.bias
        logp, c = np.minimum(z[:, :CLASSES], 60), np.ascontiguousarray(z[:, CLASSES:])
        d = np.exp(logp)
        d /= d.sum(1, keepdims=True)
        d[np.arange(n), net.of_row[target]] -= 1
        nodes, side, of = net.tree.paths(target)
        e, node, own = net.astray(c, nodes, side, of)
        d_s = (-side * (e / (1 + e)))[:, None]
        d_c = np.zeros_like(c)
        if len(of):  # the ways of one target are neighbours
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            d_c[of[first]] = summed(node * d_s, first)
        d_node = np.multiply(own, d_s, out=own)
        d = np.concatenate([d, d_c], axis=1)
        d_h, d_seen = d @ net.weights.T, np.zeros_like(seen)
        for j, k in enumerate(steps):
            d_seen[at + k] += d_h[:, j * WIDTH : (j + 1) * WIDTH]
        d_seen *= 1 - seen * seen
        for value, total, g in ((net.weights, self.g_w, h.T @ d / n), (net.bias, self.g_b, d.sum(0) / n)):
            total += g * g
            value -= RATE * g / np.sqrt(total)
        # row numbers fit 16 bits, which are sorted by radix
        flat = np.concatenate([rows, ROWS + nodes]).astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        row = flat.take(order)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        g = summed(np.concatenate([d_seen, d_node]).take(order, axis=0), starts) / n
        rows = row.take(starts).astype(np.int64)
        total = self.g_e.take(rows) + np.einsum("ij,ij->i", g, g) * np.float32(n / WIDTH)
        self.g_e[rows] = total
        net.embedding[rows] = net.embedding.take(rows, axis=0) - g * (np.float32(RATE * np.sqrt(n)) / np.sqrt(total))[:, None]
        self.used[rows] += np.diff(np.r_[starts, len(row)])
        self.steps += n


_TOKENS = "doc_id long, n long, rows binary"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, rows: each text's embedding rows, two bytes a token. A row of n = -1 follows: the task's counts of rows, compressed."""
    counts = np.zeros(ROWS, np.int64)
    for batch in batches:
        n, every = [], []
        for rows in text_rows(batch.column("text")):
            n.append(len(rows))
            every.append(rows.astype("<u2").tobytes())
        counts += np.bincount(np.frombuffer(b"".join(every), "<u2"), minlength=ROWS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(every, pa.binary())], names=["doc_id", "n", "rows"])
    if counts.any():
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["doc_id", "n", "rows"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(ROWS, np.int64)
    for batch in batches:
        for part in batch.column("rows").to_pylist():
            counts += np.frombuffer(zlib.decompress(part), np.int64)
    rows = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(counts[rows])], names=["row", "n"])


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the rows of texts one after another with SIDE empty places around each, where each begins, how many it has)."""
    gap = bytes(2 * SIDE)
    n = np.array([len(t) // 2 for t in texts], np.int64)
    return np.frombuffer(gap + gap.join(texts) + gap, "<u2"), np.cumsum(n + SIDE) - n, n


def gathered(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[list[bytes]]:
    """Lists of texts with about so many tokens together."""
    texts, n = [], 0
    for batch in batches:
        for t in batch.column("rows").to_pylist():
            texts.append(t)
            n += len(t) // 2
            if n >= tokens:
                yield texts
                texts, n = [], 0
    if texts:
        yield texts


_PART = "part int, run int, used binary, value binary"
_PARTS = 64


def blocks(n: int, first: int) -> list[tuple[int, int]]:
    """Every ROUNDS-th run of BLOCK places of a text with n tokens; a place in a run is fetched for its neighbours too."""
    return [(a, min(a + BLOCK, n)) for a in range(first * BLOCK, n, ROUNDS * BLOCK)]


def runs(rows: bytes, turn: int) -> list[tuple[int, int]]:
    """The places of a text that a round trains on; the rounds share them all out."""
    return blocks(len(rows) // 2, (xxhash.xxh3_64_intdigest(rows) + turn) % ROUNDS)


def _trained(net: Network, turn: int) -> Callable:
    """Trains on the turn's places of every text and sends the weights in parts: rows of the embedding, then the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, gap = Trainer(net), bytes(2 * SIDE)
        for texts in gathered(batches, 16 * BATCH):
            parts, at, end = [], [], 0
            for text in texts:
                around = gap + text + gap
                for a, b in runs(text, turn):
                    parts.append(around[2 * a : 2 * (b + 2 * SIDE)])
                    at.append(np.arange(end + SIDE, end + SIDE + b - a))
                    end += b - a + 2 * SIDE
            if not at:
                continue
            rows, places = np.frombuffer(b"".join(parts), "<u2"), np.concatenate(at)
            for a in range(0, len(places), BATCH):
                here = places[a : a + BATCH]
                first = here[0] - SIDE
                t.step(rows[first : here[-1] + SIDE + 1], here - first)
        if not t.steps:
            return
        task, per = TaskContext.get().partitionId(), 2 * ROWS // _PARTS
        parts = [(k, t.used[k * per : (k + 1) * per], t.net.embedding[k * per : (k + 1) * per]) for k in range(_PARTS)]
        parts.append((_PARTS, np.array([t.steps]), np.concatenate([t.net.weights.ravel(), t.net.bias])[None, :]))
        columns = zip(*[(k, task, used.astype(np.int64).tobytes(), value.astype(np.float32).tobytes()) for k, used, value in parts], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "run", "used", "value"])

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, run): the mean of each part's rows, weighted by how often a task used them."""
    at, used, value = None, None, None

    def done() -> pa.RecordBatch:
        mean = value / np.maximum(used, 1)[:, None]
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([0], pa.int32()), pa.array([used.tobytes()], pa.binary()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["part", "run", "used", "value"])

    for batch in batches:
        for part, u, v in zip(*(batch.column(c).to_pylist() for c in ("part", "used", "value")), strict=True):
            u = np.frombuffer(u, np.int64)
            v = np.frombuffer(v, np.float32).reshape(len(u), -1).astype(np.float64) * u[:, None]
            if part != at:
                if at is not None:
                    yield done()
                at, used, value = part, u.copy(), v
            else:
                used, value = used + u, value + v
    if at is not None:
        yield done()


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> Network:
    """The network, trained on all of docs: with ROUNDS rounds every token is a target once.

    Counts cover every token. In each round every task trains from the same weights on its own texts, and the tasks'
    weights are averaged per embedding row by use; what is gathered grows with the corpus, what the driver gets is one
    network. Null and empty texts have no place, repeated rows are trained on as often as they come, long ones whole.
    Without any token, or any row, the network is the untrained one.
    """
    tokens = tokenised(docs, text_col=text_col)
    net = trained(tokens, rounds)
    drop_cut(tokens)
    return net


def tokenised(docs: DataFrame, id_col: str | None = None, text_col: str = "text") -> DataFrame:
    """A written table of the tokens of all docs, and their counts, so that texts are read and hashed once."""
    ids = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return cut(small_batches(docs).select(ids.alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_tokens, _TOKENS), "tokens")


def trained(tokens: DataFrame, rounds: int = ROUNDS) -> Network:
    counts, texts = np.zeros(ROWS, np.int64), tokens.where("n > 0").select("rows")
    table = tokens.where("n = -1").select("rows").mapInArrow(_counted, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).toArrow()
    counts[table["row"].to_numpy()] = table["n"].to_numpy()
    net = fresh(counts)
    per = 2 * ROWS // _PARTS
    for turn in range(rounds):
        parts = texts.mapInArrow(_trained(net, turn), _PART)
        mean = cut(parts.repartition("part").sortWithinPartitions("part", "run").mapInArrow(_averaged, _PART), "network")
        embedding, weights, bias = net.embedding.copy(), net.weights, net.bias
        for r in mean.select("part", "used", "value").toArrow().to_pylist():
            used, v = np.frombuffer(r["used"], np.int64), np.frombuffer(r["value"], np.float32)
            if r["part"] == _PARTS:
                weights, bias = v[: weights.size].reshape(weights.shape).copy(), v[weights.size :].copy()
            else:
                rows = slice(r["part"] * per, (r["part"] + 1) * per)
                embedding[rows] = np.where(used[:, None] > 0, v.reshape(per, WIDTH), embedding[rows])
        drop_cut(mean)
        net = Network(embedding, weights, bias, net.of_row, net.tree)
    return net


def _scores(net: Network) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, texts, row = np.zeros(batch.num_rows), batch.column("rows").to_pylist(), 0
            for part in gathered(iter([batch]), 1 << 14):
                rows, starts, n = padded(part)
                logs = [net.log_tokens(rows[a : a + (1 << 12) + 2 * SIDE]) for a in range(0, len(rows) - 2 * SIDE, 1 << 12)]
                sums = np.r_[np.zeros(SIDE + 1), np.cumsum(np.concatenate(logs))] if logs else np.zeros(SIDE + 1)
                total[row : row + len(part)] = np.where(n > 0, sums[np.minimum(starts + n, len(sums) - 1)] - sums[np.minimum(starts, len(sums) - 1)], 0)
                row += len(part)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) // 2 for t in texts], pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "n_tokens", "log_prob"])

    return run


def scored(tokens: DataFrame, net: Network) -> DataFrame:
    out = small_batches(tokens).where("n >= 0").select("doc_id", "rows").mapInArrow(_scores(net), "doc_id long, n_tokens long, log_prob double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob (the pseudo-log-likelihood), mean_log_prob of every row.

    A null or empty text, or one of blanks only, has 0 tokens, 0 and a null mean. Whole texts are scored, however long;
    repeated rows and ties get equal scores. An empty table gives an empty result; other columns are ignored.
    """
    return scored(tokenised(docs, id_col, text_col), net)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the network that was trained on them; texts are read once, their tokens written for the rounds."""
    tokens = tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return scored(tokens, trained(tokens))
