"""Suffix-array dedup: repeated passages by a distributed difference-cover suffix order.

Where texts are long, few of their bytes can be in a repeat at all. Anchors (least hash of a gram in the window of a passage) cut the
texts into units so that equal passages lie at equal places of their units; equal units are one, and a unit
whose anchor's gram no other unit has is in no repeat. What is left is sorted: characters are 12 bytes, triples of the
positions of the difference cover {1, 2} mod 3 are named in their order, the names are sorted by triples again,
which reaches past a passage and ends the recursion; on the way back the remaining suffixes are merged in, first among the names, then
among the bytes. Suffixes that agree in a whole passage are neighbours then, and the earliest of them stays.

Tasks exchange runs of keys: a chunk of texts sends each distinct key once to the task of its range, which names the
keys of all chunks in order and sends the names back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.base import cut, drop_cut, small_batches

#: Bytes of a passage.
PASSAGE = 100
#: Bytes of an anchor's gram, in the first and in the second filter.
GRAMS = (20, 80)
#: Text that is scanned at once; a longer text is scanned in parts that overlap.
SLAB = 1_000_000
#: A gram with so many different units in one slab is dealt by units, and these are sorted without a look at the rest.
HEAVY = 32
#: Units or keys that one task takes, about, and bytes of text of a chunk to be sorted.
TASK_ROWS, CHUNK = 1_000_000, 400_000
#: Prefixes that may be sampled for the ranges.
SAMPLE = 20_000
#: Bytes of a character; three make a triple.
CHAR = 12
PAD = 9 * CHAR + PASSAGE
_LAST = 2**63 - 1
U = np.uint64
_C1, _C2, _R = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
_R_INVERSE = U(pow(int(_R), -1, 2**64))
MARKS = "k1 long, k2 long, mark long"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def words8(b: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as a number that sorts as they do."""
    v = b.astype(U)
    v = v[:-1] << U(8) | v[1:]
    v = v[:-2] << U(16) | v[2:]
    return v[:-4] << U(32) | v[4:]


def grams(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on; k is 8 at least."""
    h, n = mixed(words8(b) * _C1), 8
    while n < k:
        step = min(n, k - n)
        h = mixed(h[:-step] * _C1 + (h[step:] ^ (h[step:] >> U(31))) * _C2)
        n += step
    return h


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = (np.cumprod(np.r_[U(1), np.full(n, r)]) for r in (_R, _R_INVERSE))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def units(b: np.ndarray, starts: np.ndarray, lens: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(piece, first start in the slab, number of starts, gram, content) of each unit of the pieces that lie in b.

    A passage's anchor is the least gram of those in it, the first of equal ones; a unit is a stretch of passages with one anchor.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    if len(b) < PASSAGE:
        return none
    h = grams(b, k)
    low = U((1 << 24) - 1)
    least, n, window = (h & ~low) | np.arange(len(h)).astype(U), 1, PASSAGE - k + 1
    while n < window:
        step = min(n, window - n)
        least = np.minimum(least[:-step], least[step:])
        n += step
    places = np.arange(len(least))
    piece = np.repeat(np.arange(len(lens)), lens)[: len(least)]
    s = places[places + PASSAGE <= (starts + lens)[piece]]
    if not len(s):
        return none
    anchor, piece = (least[s] & low).astype(np.int64), piece[s]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
    count = np.diff(np.r_[first, len(s)])
    s1, anchor, piece = s[first], anchor[first], piece[first]
    up, down = powers(len(h) + 1)
    total = np.r_[U(0), np.cumsum(h * up[: len(h)])]
    content = (total[s1 + count + window - 1] - total[s1]) * down[s1]
    return piece, s1, count, h[anchor], mixed(content + (anchor - s1).astype(U) * _C2 + count.astype(U) * _C1)


def _slabs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, lengths, k1, k2, place of the first byte in its document) of bounded parts of a batch (k1, k2, base, body)."""
    k1, k2, base = (batch.column(c).to_numpy() for c in ("k1", "k2", "base"))
    body = batch.column("body")
    body = body.cast(pa.binary()) if pa.types.is_string(body.type) else body
    parts, size = [], 0

    def out() -> tuple:
        lens = np.array([len(p[0]) for p in parts], np.int64)
        row, off = (np.array([p[i] for p in parts], np.int64) for i in (1, 2))
        return np.frombuffer(b"".join(p[0] for p in parts), np.uint8), np.cumsum(lens) - lens, lens, k1[row], k2[row], base[row] + off

    for row in range(batch.num_rows):
        whole = body[row].as_buffer()
        if whole.size < PASSAGE:
            continue
        for at in range(0, whole.size - PASSAGE + 1, SLAB):
            part = whole.slice(at, min(SLAB + PASSAGE - 1, whole.size - at)).to_pybytes()
            if size and size + len(part) > SLAB:
                yield out()
                parts, size = [], 0
            parts.append((part, row, at))
            size += len(part)
    if parts:
        yield out()


def _sent(bucket: np.ndarray, columns: np.ndarray) -> pa.RecordBatch:
    """Rows of columns (2-D, one record a row) as one blob per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], columns[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    blobs = [shrunk(columns[lo:hi]) for lo, hi in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _by_key(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that come sorted by key, those of one key together; rows are blobs, so they are few."""
    rows = (r for b in batches for r in b.to_pylist())
    for k, group in groupby(rows, lambda r: tuple(r[c] for c in key)):
        yield k, list(group)


#: A record of a unit: gram, content, k1, k2, start << 16 | flags << 12 | number of starts. Flags: a copy of one in its slab; to be sorted anyway.
_COPY, _FORCED = 1, 2


def _scan(k: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, starts, lens, k1, k2, base in _slabs(batch):
                piece, s1, count, g, u = units(b, starts, lens, k)
                if not len(g):
                    continue
                a1, a2, s = k1[piece], k2[piece], base[piece] + s1 - starts[piece]
                order = np.lexsort((s, a2, a1, u, g))
                g, u, a1, a2, s, count = (x[order] for x in (g, u, a1, a2, s, count))
                copy = np.r_[False, (g[1:] == g[:-1]) & (u[1:] == u[:-1])]
                heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                heavy = np.add.reduceat((~copy).astype(np.int64), heads) >= HEAVY
                forced = np.repeat(heavy, np.diff(np.r_[heads, len(g)]))
                flags = copy * _COPY + forced * _FORCED
                record = np.stack([x.view(np.int64) for x in (g, u, a1, a2, s << 16 | flags << 12 | count)], 1)
                bucket = np.where(forced, mixed(g + u * _C2), g) % U(buckets)
                mark = heads[heavy]  # tells the gram's own task that there are others
                marks = record[mark] * np.array([1, 0, 0, 0, 0])
                yield _sent(np.r_[bucket, g[mark] % U(buckets)].astype(np.int64), np.concatenate([record, marks]))

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the units of a bucket: start << 12 | number of starts << 1 | whether it is to be sorted (else it is a copy of an earlier one)."""
    for _, rows in _by_key(batches, "bucket"):
        r = np.concatenate([grown(x["blob"], 5) for x in rows])
        g, u, k1, k2, last = r.T
        count, flags, s = last & 4095, last >> 12 & 15, last >> 16
        order = np.lexsort((s, k2, k1, u, g))
        g, u, k1, k2, s, count, flags = (x[order] for x in (g, u, k1, k2, s, count, flags))
        heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        real = count > 0
        first = real & np.r_[True, (g[1:] != g[:-1]) | (u[1:] != u[:-1]) | ~real[:-1]]
        shared = np.add.reduceat(first.astype(np.int64) + ~real, heads) > 1
        shared = np.repeat(shared, np.diff(np.r_[heads, len(g)])) | (flags & _FORCED > 0)
        told = real & (~first | shared)
        mark = s << 12 | count << 1 | first
        yield pa.RecordBatch.from_arrays([pa.array(x[told]) for x in (k1, k2, mark)], names=["k1", "k2", "mark"])


def _filtered(pieces: DataFrame, k: int, size: int, label: str) -> DataFrame:
    """Marks (k1, k2, mark) of pieces (k1, k2, base, body)."""
    buckets = max(1, size // (PASSAGE - k + 2) * 2 // TASK_ROWS + 1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = pieces.mapInArrow(_scan(k, buckets), "bucket int, blob binary")
    return cut(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_judged, MARKS), label)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of text whose passages are to be sorted, of rows (k1, k2, base, body, marks)."""
    for batch in batches:
        k1, k2, base = (batch.column(c).to_numpy() for c in ("k1", "k2", "base"))
        body, marks = batch.column("body"), batch.column("marks")
        _, where, data = body.buffers()
        where = np.frombuffer(where, np.int32)[body.offset : body.offset + batch.num_rows + 1].astype(np.int64)
        mark = marks.flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), marks.value_lengths().to_numpy())
        s, count = (mark >> 12) - base[row], mark >> 1 & 2047
        inside = (s >= 0) & (s + PASSAGE <= np.diff(where)[row])
        order = np.flatnonzero(inside)[np.lexsort((s[inside], row[inside]))]
        s, count, row = s[order], count[order], row[order]
        if not len(s):
            continue
        head = np.flatnonzero(np.r_[True, (s[1:] != s[:-1] + count[:-1]) | (row[1:] != row[:-1])])
        last = np.r_[head[1:], len(s)] - 1
        size, start = s[last] + count[last] - s[head] + PASSAGE - 1, where[row[head]] + s[head]
        for lo, hi in _parts(size):
            ends = np.cumsum(size[lo:hi])
            at = np.arange(ends[-1]) + np.repeat(start[lo:hi] - (ends - size[lo:hi]), size[lo:hi])
            text = pa.py_buffer(np.frombuffer(data, np.uint8)[at].tobytes())
            offsets = pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes())
            of = row[head[lo:hi]]
            out = [pa.array(k1[of]), pa.array(k2[of]), pa.array(base[of] + s[head[lo:hi]]), pa.Array.from_buffers(pa.binary(), hi - lo, [None, offsets, text])]
            yield pa.RecordBatch.from_arrays(out, names=["k1", "k2", "base", "body"])


def _parts(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of about SLAB bytes."""
    group = (np.cumsum(size) - size) // SLAB
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(size)], strict=True)


PIECES = "k1 long, k2 long, base long, body binary"


def _sorted_out(pieces: DataFrame, marks: DataFrame) -> DataFrame:
    per = marks.where("mark & 1 = 1").groupBy(F.col("k1").alias("m1"), F.col("k2").alias("m2")).agg(F.collect_list("mark").alias("marks"))
    both = pieces.join(per.hint("shuffle_hash"), (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")))
    return both.select("k1", "k2", "base", F.col("body").cast("binary").alias("body"), "marks").mapInArrow(_cut_out, PIECES)


# --- the suffix order ---


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with h, the least hash of their grams: those that are alike mostly have the same, and come to lie in one chunk, where what they share is one key."""
    for batch in batches:
        _, where, data = batch.column("body").buffers()
        where = np.frombuffer(where, np.int32)[batch.column("body").offset : batch.column("body").offset + batch.num_rows + 1].astype(np.int64)
        h = grams(np.frombuffer(data, np.uint8)[where[0] : where[-1]], GRAMS[0])
        least = np.minimum.reduceat(np.r_[h, np.full(GRAMS[0], h.max() if len(h) else 0, U)], where[:-1] - where[0]) if batch.num_rows else np.zeros(0, U)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((least >> U(1)).astype(np.int64))], names=[*batch.schema.names, "h"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces as chunks: k1, k2, base, length of each piece, and their bytes."""

    def out(parts: list) -> pa.RecordBatch:
        k1, k2, base, body = zip(*parts, strict=True)
        head = np.array([k1, k2, base, [len(x) for x in body]], np.int64).T
        return pa.RecordBatch.from_arrays([pa.array([head.tobytes()], pa.binary()), pa.array([b"".join(body)], pa.binary())], names=["head", "body"])

    parts, size = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            parts.append((r["k1"], r["k2"], r["base"], r["body"]))
            size += len(r["body"])
            if size >= CHUNK:
                yield out(parts)
                parts, size = [], 0
    if parts:
        yield out(parts)


class Chunk:
    """A chunk's pieces, each followed by zeros, and the positions that the sort needs.

    Characters are CHAR bytes, so the suffixes of a piece fall into CHAR strings, one for each start; place i is the
    (i // CHAR)-th of its string. At the level of names a symbol is a triple, place i the (i // (3 * CHAR))-th of its string.
    """

    def __init__(self, head: bytes, body: bytes) -> None:
        self.k1, self.k2, self.base, self.lens = np.frombuffer(head, np.int64).reshape(-1, 4).T
        padded = self.lens + PAD
        begin = np.cumsum(padded) - padded
        b = np.zeros(int(padded.sum()), np.uint8)
        self.piece = np.repeat(np.arange(len(self.lens)), self.lens)
        self.i = np.arange(len(self.piece)) - (np.cumsum(self.lens) - self.lens)[self.piece]
        self.at = begin[self.piece] + self.i
        b[self.at] = np.frombuffer(body, np.uint8)
        self.b, self.size = b, len(b)
        self.cover = self.i // CHAR % 3 > 0
        self.start = self.i <= self.lens[self.piece] - PASSAGE

    def prefixes(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.b, n)[at]).view(f"S{n}")[:, 0]

    def spread(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """values laid out by place in the padded text, 0 elsewhere."""
        out = np.zeros(self.size, np.int64)
        out[at] = values
        return out


def placed(c: Chunk, at: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    n = splitters.dtype.itemsize
    return np.searchsorted(splitters, c.prefixes(at, n), "right") if len(splitters) else np.zeros(len(at), np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places of the distinct rows, number of its distinct row for every row), in an order that the rows alone decide."""
    h = np.zeros(len(keys), U)
    for column in keys.T:
        h = mixed(h * _C1 + column.view(U))
    order = np.argsort(h, kind="stable")
    k, h = keys[order], h[order]
    new, other = np.r_[True, h[1:] != h[:-1]][: len(k)], (k[1:] != k[:-1]).any(1)
    if (other & ~new[1:]).any():  # two rows of one hash
        order = np.lexsort(keys.T[::-1])
        k = keys[order]
        new = np.r_[True, (k[1:] != k[:-1]).any(1)]
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def ranked(keys: np.ndarray) -> np.ndarray:
    """Number of each row's key in the order of the keys."""
    order = np.lexsort(keys.T[::-1])
    k = keys[order]
    out = np.empty(len(k), np.int64)
    out[order] = np.cumsum(np.r_[False, (k[1:] != k[:-1]).any(1)][: len(k)])
    return out


def shrunk(columns: np.ndarray) -> bytes:
    """Rows of 8-byte columns as compressed planes of bytes: high bytes are alike, and so are the first ones of sorted text."""
    n, width = columns.shape
    planes = np.ascontiguousarray(np.ascontiguousarray(columns.T).view(np.uint8).reshape(width, n, 8).transpose(0, 2, 1))
    return n.to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if n else b"")


def grown(blob: bytes, width: int, kind: type = np.int64) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros((0, width), kind)
    planes = np.frombuffer(pa.decompress(blob[8:], n * width * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, 8, n).transpose(0, 2, 1)).view(kind).reshape(width, n).T


class Step:
    """What a chunk asks at one step, and what it will want to know of itself at the next."""

    def __init__(self, c: Chunk, keys: np.ndarray, at: np.ndarray, splitters: np.ndarray, *own: np.ndarray) -> None:
        """Distinct keys by bucket; a key decides its bucket, so only one position of each is placed. own: what to keep besides."""
        keys = keys.view(np.int64)
        heads, inverse = distinct(keys)
        bucket = placed(c, at[heads], splitters)
        order = np.lexsort((keys[heads, 0].view(U), bucket))  # near to sorted, so that runs shrink well
        self.keys, self.bucket = keys[heads][order], bucket[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.state = [back[inverse], *own]


def step_of(number: int, c: Chunk, state: list[np.ndarray], answer: np.ndarray, short: np.ndarray, long: np.ndarray) -> Step:
    """The chunk's step of that number; answer: what the step before asked, state: what it kept."""
    every, step = c.at[c.cover], 3 * CHAR
    kinds = c.i[c.cover] // step % 3
    if number == 0:  # triples of characters
        v = words8(c.b)
        return Step(c, np.stack([v[every], v[every + 8], v[every + 16], v[every + 24], v[every + 28] & U(0xFFFFFFFF)], 1), every, short)  # 36 bytes
    if number == 1:  # triples of names, at the places that cover the names' strings
        names = answer[state[0]]
        name, at = c.spread(every, names), every[kinds > 0]
        return Step(c, np.stack([name[at], name[at + step], name[at + 2 * step]], 1), at, long, names)
    # the names' other suffixes, as far as a passage leans on them
    rank, name = c.spread(every[kinds > 0], answer[state[0]]), c.spread(every, state[1])
    near = leaning(c)
    at, kind = every[near], kinds[near]
    # kind, own rank, first symbol, rank after it, second symbol, rank after both; what is not known is 0
    keys = [kind, np.where(kind > 0, rank[at], 0), name[at], np.where(kind < 2, rank[at + step], 0), np.where(kind != 1, name[at + step], 0), np.where(kind != 1, rank[at + 2 * step], 0)]
    return Step(c, np.stack(keys, 1), at, long)


def leaning(c: Chunk) -> np.ndarray:
    return c.i[c.cover] <= c.lens[c.piece[c.cover]] - PASSAGE + 2 * CHAR


def kept_state(arrays: list[np.ndarray]) -> bytes:
    blobs = [shrunk(x[:, None]) for x in arrays]
    return b"".join(len(x).to_bytes(8, "little") + x for x in blobs)


def found_state(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(grown(blob[at + 8 : at + 8 + n], 1)[:, 0])
        at += 8 + n
    return out


def _asks(number: int, short: np.ndarray, long: np.ndarray) -> Callable:
    """Chunks with the answers to their step before ask at the next: bucket, chunk, blob. A chunk's own state goes along, to a bucket that passes it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, c, state, answer in _with_answers(batches):
            step = step_of(number, c, state, answer, short, long)
            out = _sent(step.bucket, step.keys)
            blobs = [*out.column(1).to_pylist(), kept_state(step.state)]
            own = [*[False] * out.num_rows, True]
            buckets = [*out.column(0).to_pylist(), chunk % (len(long) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([chunk] * len(own), pa.int64()), pa.array(own), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "own", "blob"])

    return run


def _with_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, list[np.ndarray], np.ndarray]]:
    """(chunk, its text, its state, the answers in the order of its keys): rows come by chunk and bucket, the text as bucket -2, the state as -1."""
    for (chunk,), rows in _by_key(batches, "chunk"):
        state = [x for r in rows if r["bucket"] == -1 for x in found_state(r["blob"])]
        parts = [grown(r["blob"], 1)[:, 0] for r in rows if r["bucket"] >= 0]
        yield chunk, Chunk(rows[0]["head"], rows[0]["blob"]), state, np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _answered(kind: str) -> Callable:
    """Names of all chunks' keys in a bucket, in order, sent back to each chunk in the order of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in _by_key(batches, "bucket"):
            own = [r for r in rows if r["own"]]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in own], pa.int64()), pa.array([-1] * len(own), pa.int32()), pa.array([r["blob"] for r in own], pa.binary())], names=["chunk", "bucket", "blob"])
            rows = [r for r in rows if not r["own"]]
            if not rows:
                continue
            width = {"bytes": 5, "names": 3, "merge": 6}[kind]
            parts = [grown(r["blob"], width, U if kind == "bytes" else np.int64) for r in rows]
            keys = np.concatenate(parts)
            names = (merged(*keys.T) if kind == "merge" else ranked(keys)) + (bucket << 40) + 1
            cuts = np.cumsum([len(p) for p in parts])[:-1]
            blobs = [shrunk(x[:, None]) for x in np.split(names, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "blob"])

    return run


def merged(kind: np.ndarray, r0: np.ndarray, s0: np.ndarray, r1: np.ndarray, s1: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """Place of each suffix in the order of all.

    Those of kinds 1 and 2 have their own rank r0. One of kind 0 stands against kind 1 as (s0, r1), against kind 2 as
    (s0, s1, r2); its place is its place among its own plus the numbers of those before it, and so theirs.
    """
    zero, ranked = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0)
    place = np.zeros(len(kind), np.int64)
    place[ranked[np.argsort(r0[ranked], kind="stable")]] = np.arange(len(ranked))
    place[zero[np.lexsort((r1[zero], s0[zero]))]] = np.arange(len(zero))
    for other, keys in ((1, (r1, s0)), (2, (r2, s1, s0))):
        both = np.flatnonzero((kind == 0) | (kind == other))
        order = both[np.lexsort(tuple(k[both] for k in keys))]
        mine = kind[order] == 0
        before = np.cumsum(mine)
        place[order[mine]] += np.arange(1, len(order) + 1)[mine] - before[mine]
        place[order[~mine]] += before[~mine]
    out = np.empty(len(kind), np.int64)
    out[np.argsort(place, kind="stable")] = np.arange(len(kind))
    return out


#: A record of a passage: kind, its ranks, its first two characters in 8 + 4 + 8 + 4 bytes, a hash of its bytes, k1, k2, start.
_RECORD = 12


def _passages(long: np.ndarray) -> Callable:
    """Passages to be merged, the first of equal ones of a chunk; the others' marks go along as records of kind 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c, state, answer in _with_answers(batches):
            rank = c.spread(c.at[c.cover][leaning(c)], answer[state[0]])
            at, kind = c.at[c.start], c.i[c.start] // CHAR % 3
            ranks = [np.where(kind > 0, rank[at], 0), np.where(kind < 2, rank[at + CHAR], 0), np.where(kind != 1, rank[at + 2 * CHAR], 0)]
            v = words8(c.b)
            first, second = (np.stack([v[p] , v[p + 4] & U(0xFFFFFFFF)], 1) for p in (at, at + CHAR))
            fp = grams(c.b, PASSAGE)[at]
            piece = c.piece[c.start]
            k1, k2, start = c.k1[piece], c.k2[piece], c.base[piece] + c.i[c.start]
            order = np.lexsort((start, k2, k1, fp))
            record = np.stack([x.view(np.int64) for x in (kind, *ranks, *first.T, *second.T, fp, k1, k2, start)], 1)[order]
            same = np.r_[False, record[1:, 8] == record[:-1, 8]] if len(record) else np.zeros(0, bool)
            record[same, 0] = 3
            yield _sent(placed(c, at, long)[order], record)

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the passages of a bucket that also start earlier: merge, compare neighbours, keep the first of equal ones."""
    for _, rows in _by_key(batches, "bucket"):
        r = np.concatenate([grown(x["blob"], _RECORD) for x in rows])
        local = r[:, 0] == 3
        marks = [r[local]]
        r = r[~local]
        char = ranked(np.concatenate([r[:, 4:6], r[:, 6:8]]).astype(np.int64).view(U))
        place = merged(r[:, 0], r[:, 1], char[: len(r)], r[:, 2], char[len(r) :], r[:, 3])
        ordered = r[np.argsort(place)]
        group = np.cumsum(np.r_[True, ordered[1:, 8] != ordered[:-1, 8]]) if len(r) else np.zeros(0, np.int64)
        inner = np.lexsort((ordered[:, 11], ordered[:, 10], ordered[:, 9], group))
        ordered, group = ordered[inner], group[inner]
        marks.append(ordered[np.r_[False, group[1:] == group[:-1]]] if len(r) else ordered)
        out = np.concatenate(marks)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 9]), pa.array(out[:, 10]), pa.array(out[:, 11] << 12 | 1 << 1)], names=["k1", "k2", "mark"])


def _sampled(share: int) -> Callable:
    """Prefixes at every share-th place of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r["head"], r["body"])
                at = c.at[mixed(c.at.astype(U) + U(r["chunk"]) * _C1) % U(share) == 0]
                windows = np.lib.stride_tricks.sliding_window_view(c.b, PASSAGE)[at]
                yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in windows], pa.binary())], names=["prefix"])

    return run


def _splitters(prefixes: list[bytes], tasks: int, n: int) -> np.ndarray:
    found = np.unique(np.array([p[:n] for p in prefixes], f"S{n}")) if prefixes else np.zeros(0, f"S{n}")
    return np.unique(found[np.arange(1, tasks) * len(found) // tasks]) if len(found) > tasks else found[1:]


def repeated(pieces: DataFrame, label: str = "suffix") -> DataFrame:
    """Marks of the passages of pieces (k1, k2, base, body) that also start earlier, by (k1, k2, place in the document)."""
    spark = pieces.sparkSession
    like = pieces.mapInArrow(_keyed, f"{PIECES}, h long").repartitionByRange("h", "k1", "k2", "base").sortWithinPartitions("h", "k1", "k2", "base")
    chunks = cut(like.mapInArrow(_packed, "head binary, body binary").withColumn("chunk", F.monotonically_increasing_id()), f"{label}-chunks")
    size = chunks.agg(F.sum(F.length("body"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_ROWS + 1)
    prefixes = [bytes(r["prefix"]) for r in chunks.mapInArrow(_sampled(max(1, size // SAMPLE)), "prefix binary").collect()]
    long, short = (_splitters(prefixes, tasks, n) for n in (PASSAGE, 3 * CHAR))
    texts = chunks.select("chunk", F.lit(-2).alias("bucket"), "head", F.col("body").alias("blob"))
    told, drops = texts, [chunks]
    for number, kind in enumerate(("bytes", "names", "merge")):
        asks = told.repartition(tasks, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(_asks(number, short, long), "bucket int, chunk long, own boolean, blob binary")
        names = asks.repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_answered(kind), "chunk long, bucket int, blob binary")
        drops.append(cut(names, f"{label}-names"))
        told = texts.union(drops[-1].select("chunk", "bucket", F.lit(None).cast("binary"), "blob"))
    asks = told.repartition(tasks, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(_passages(long), "bucket int, blob binary")
    marks = cut(asks.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeats, MARKS), f"{label}-marks")
    for table in drops:
        drop_cut(table)
    return marks


# --- whole documents ---


def runs(marks: np.ndarray) -> np.ndarray:
    """Maximal stretches (begin, end) of bytes covered by the passages of the marks."""
    if not len(marks):
        return np.zeros((0, 2), np.int64)
    s = marks >> 12
    e = s + (marks >> 1 & 2047) + PASSAGE - 1
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    head = np.r_[True, s[1:] > e[:-1]]
    return np.stack([s[head], e[np.r_[head[1:], True]]], 1)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, marks, out = batch.column("body"), batch.column("marks"), []
        for row in range(batch.num_rows):
            text = body[row].as_buffer()
            gone = runs(marks[row].values.to_numpy()) if marks[row].is_valid else runs(np.zeros(0, np.int64))
            left, at = hashlib.sha256(), 0
            for a, b in gone.tolist():
                left.update(text.slice(at, a - at))
                at = b
            left.update(text.slice(at))
            out.append((text.size, int((gone[:, 1] - gone[:, 0]).sum()), len(gone), left.hexdigest(), gone.ravel().tolist()))
        n_bytes, n_removed, n_spans, digest, spans = zip(*out, strict=True) if out else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("copies"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.int64()))],
            names=["doc_id", "copies", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin, end, begin, end, ... in bytes) of every row of docs.

    A byte goes if a passage of PASSAGE bytes that covers it also starts earlier: in a document of smaller id, or in the same one
    before. Passages never cross documents. Null and empty texts have no bytes, and texts shorter than a passage lose none. A null id
    comes last. Rows of one id are documents of their own, in the order of a hash of their texts; of rows
    alike in id and text all but one lose every passage. Very long texts are read in slabs. An empty table gives an empty
    result; other columns are ignored.

    Grams, units and passages are told apart by 64-bit hashes, units by two of them. A gram that is frequent in a slab
    is dealt out by its units, equal passages leave a chunk once, ranges come from a bounded sample, and the document's
    text meets its marks in a join on its id.
    """
    spark = docs.sparkSession
    rows = small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")))
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("doc_id", F.xxhash64("body").alias("k2")).agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    else:
        rows = rows.withColumn("k2", F.lit(0).cast("long")).withColumn("copies", F.lit(1).cast("long"))
    rows = rows.withColumn("k1", F.coalesce("doc_id", F.lit(_LAST)))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    texts = rows.select("k1", "k2", F.lit(0).cast("long").alias("base"), "body")
    wide = _filtered(texts, GRAMS[0], size, "marks")
    pieces = cut(_sorted_out(texts, wide), "pieces")
    size = pieces.agg(F.sum(F.length("body"))).first()[0] or 0
    narrow = _filtered(pieces, GRAMS[1], size, "marks")
    order = repeated(_sorted_out(pieces, narrow))
    drop_cut(pieces)
    copies = wide.where("mark & 1 = 0").union(narrow.where("mark & 1 = 0")).union(order)
    per = copies.groupBy(F.col("k1").alias("m1"), F.col("k2").alias("m2")).agg(F.collect_list("mark").alias("marks"))
    both = rows.join(per.hint("shuffle_hash"), (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left")
    both = both.select("doc_id", "copies", F.col("body").cast("binary").alias("body"), "marks")
    out = both.mapInArrow(_kept, "doc_id long, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    # a row alike in id and text to another: everything that a passage covers goes, which is all or nothing
    again = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= PASSAGE)
    return again.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(gone, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.col("spans")).alias("spans"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
