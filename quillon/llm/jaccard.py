"""N-gram Jaccard join by parity sketches, a pigeonhole join of their blocks per size band, and exact verification.

A document's sketch is a bit string some times as long as it has shingles, in which every shingle flips the bit that its hash
names: two sketches differ in at most as many bits as the documents have shingles not in common, and documents that
link differ by at most (n1 + n2) / 7 shingles. Sketches meet by pigeonhole per size band: the sketch is cut into blocks,
each kept as the XOR of the codes of its shingles. At most (n1 + n2) / 7 blocks of either document find no equal in the
other: in any common order of blocks, the first s that both share are among the first (n1 + n2) / 7 + s of each. These
are the keys that are joined. The order takes blocks of shingles first that few documents have, as counted over the
whole corpus; only speed hangs on it. Pairs that meet are compared by the Hamming distance of their sketches, and what
it lets through is verified on the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.base import components, cut, drop_cut, free_shuffles, other_key, small_batches, text_or_empty
from quillon.llm.words import mixed, shingle_sets

#: Documents link when SHARE[0] * intersection >= SHARE[1] * union.
SHARE = (100, 75)
#: Below this size every shingle is a block of its own; from here on bands grow by BAND_RATIO.
SMALL, BAND_RATIO = 64, 4
#: Blocks of a band's sketch, as a share of the band's largest size.
BLOCK_SHARE = 0.5
#: Keys of a bucket, for the number of buckets; buckets at most.
KEYS_PER_BUCKET, MOST_BUCKETS = 1_000_000, 1 << 17
#: Keys that a task gathers before it deals them out, and that a bucket's task takes together.
KEYS_DEALT, KEYS_MET = 4_000_000, 2_000_000
#: Counters of shingles, over all documents, and the rows they are sent in.
CELLS, CELL_ROWS = 1 << 21, 64
#: Others that are compared with one copy of a centre.
PER_CENTRE = 400
#: Rounds with centres at most; they end when one links less than STAR_GAIN of the classes that meet others. Centres of a key in a round but the first.
STAR_ROUNDS, STAR_GAIN, CENTRES = 8, 0.02, 3
#: Bits of a sketch a shingle, and in all at least: the fewer, the more pairs under the threshold pass for shingles that meet in a bit.
SKETCH_BITS, LEAST_BITS = 2, 2048
#: Sketches of a key that are compared at once: larger groups are compared in pairs of tiles.
TILE = 2_000
#: The list of documents whose text is needed again is broadcast up to so many rows.
BROADCAST_ROWS = 500_000


def surplus(n: int) -> int:
    """Keys beyond the pigeonhole's one that documents of this size send, and so share if they link."""
    return n // 24 + 1 if n >= 16 else 0


def surplus_of(n: Column) -> Column:
    return F.when(n >= 16, F.floor(n / 24) + 1).otherwise(0)


def bands(n: int) -> list[tuple[int, int]]:
    """(band, its largest size) in which a document of n shingles meets others: its own, and the next if a larger partner can be there."""
    band, top = 0, SMALL - 1
    while n > top:
        band, top = band + 1, (top + 1) * BAND_RATIO - 1
    return [(band, top)] + ([(band + 1, (top + 1) * BAND_RATIO - 1)] if SHARE[0] * n >= SHARE[1] * (top + 1) else [])


def keys(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The block keys of a document with sorted shingles s; level says of each counter how frequent its shingles are."""
    n, out = len(s), []
    frequent = level[cells(s)] if len(level) else np.zeros(n, dtype=np.uint8)
    code = mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    for band, top in bands(n):
        largest = min(SHARE[0] * n // SHARE[1], top)
        differ = (n + largest) * (SHARE[0] - SHARE[1]) // (SHARE[0] + SHARE[1])
        salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        if band == 0:
            key, held, plain = mixed(code ^ salt), np.ones(n, dtype=np.int64), frequent
        else:
            block = (s >> np.uint64(32)) * np.uint64(int(BLOCK_SHARE * (top + 1))) >> np.uint64(32)
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            held = np.diff(np.r_[starts, n])
            plain = np.minimum.reduceat(frequent, starts)
            key = mixed(np.bitwise_xor.reduceat(code, starts) ^ mixed(block[starts] ^ salt))
        send = differ + 1 + surplus(n)
        if len(key) > send:
            key = key[np.lexsort((key, -held, plain))[:send]]
        elif len(key) < send:  # too few blocks to promise enough equal ones: such documents of a band all meet
            key = np.append(key, mixed(salt + np.arange(1, 2 + surplus(n), dtype=np.uint64)))
        out.append(key)
    return np.concatenate(out)


def cells(s: np.ndarray) -> np.ndarray:
    """The counters of shingles."""
    return (s >> np.uint64(11)).astype(np.int64) & (CELLS - 1)


def levels(counts: np.ndarray) -> np.ndarray:
    """Of each counter: 0 if it holds what chance brings, else the more the more it holds."""
    usual = counts.mean()
    usual += 4 * np.sqrt(usual) + 4
    return np.where(counts > usual, 1 + 2 * np.log2(np.maximum(counts / usual, 1)), 0).astype(np.uint8)


def sketch(s: np.ndarray) -> bytes:
    """Parity bits of the shingles: SKETCH_BITS a shingle or up to twice as many, LEAST_BITS at least."""
    bits = max(LEAST_BITS, 1 << (SKETCH_BITS * len(s) - 1).bit_length()) if len(s) else LEAST_BITS
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the shorter; never more than the shingles not in common."""
    if len(a) < len(b):
        a, b = b, a
    x, n = int.from_bytes(a, "little"), len(a) * 8
    while n > len(b) * 8:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def may_link(n1: int, n2: int, apart: int) -> bool:
    """Whether documents of these sizes whose sketches are so far apart can link."""
    return SHARE[0] * min(n1, n2) >= SHARE[1] * max(n1, n2) and (SHARE[0] + SHARE[1]) * apart <= (SHARE[0] - SHARE[1]) * (n1 + n2)


_CLASSES = "doc_id long, th long, n long, cls long, sketch binary"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, n, cls, sketch: size, hash and sketch of each document's set (null for an empty one).

    Rows of n = -1 follow: the task's counters of shingles, compressed, in CELL_ROWS parts numbered by th.
    """
    names, counts = ["doc_id", "th", "n", "cls", "sketch"], np.zeros(CELLS, np.uint32)
    for batch in batches:
        n, cls, bits, seen = [], [], [], [np.zeros(0, np.int64)]
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            cls.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
            bits.append(sketch(s) if len(s) else None)
            seen.append(cells(s))
        counts += np.bincount(np.concatenate(seen), minlength=CELLS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary())], names=names)
    for k, part in enumerate(counts.reshape(CELL_ROWS, -1)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([k], pa.int64()), pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts of counters: th, counts (64-bit, compressed)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column("th").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(part), np.uint32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=["th", "sketch"])


def _dealt(level: np.ndarray, buckets: int) -> Callable:
    """A row per bucket for every few million keys of a task: classes, and of every key its class's place and itself. A class is sent once while the task remembers it."""
    names, kinds = ["bucket", "classes", "place", "keys"], (pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def dealt(cls: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        every, of, ids = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.array(cls, dtype=np.int64)
        bucket = (every >> np.uint64(40)).astype(np.int64) * buckets >> 24
        order = np.argsort(bucket, kind="stable")
        every, of, bucket = every[order], of[order], bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = []
        for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
            have, place = np.unique(of[a:b], return_inverse=True)
            rows.append((int(bucket[a]), ids[have].tobytes(), place.astype(np.uint16).tobytes(), every[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, cls, parts, n, enough = set(), [], [], 0, min(KEYS_DEALT, max(200_000, 64 * buckets))
        for batch in batches:
            for s in shingle_sets(batch.column("text")):
                if len(s) and (c := xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63) not in sent:
                    sent.add(c)
                    cls.append(c)
                    parts.append(keys(s, level))
                    n += len(parts[-1])
                    if n >= enough or len(cls) >= 1 << 16:
                        yield dealt(cls, parts)
                        cls, parts, n = [], [], 0
                        sent = sent if len(sent) < 1 << 20 else set()
        if parts:
            yield dealt(cls, parts)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, id, centre of all classes that share a key of this bucket with another, centre being one of the key's.

    KEYS_MET keys are taken together; of what was taken one class per key is held, its centre, so a key with very many
    classes fills no memory. A row may come twice if a class was sent twice.
    """
    key, ids, old = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8)  # old: 1 held, 2 held and given out
    names = ["key", "id", "centre"]
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def settled() -> Iterator[pa.RecordBatch]:
        nonlocal key, ids, old, n
        key = np.concatenate([key, *(p[0] for p in pending)])
        ids = np.concatenate([ids, *(p[1] for p in pending)])
        old = np.concatenate([old, np.zeros(len(key) - len(old), np.int8)])
        pending.clear()
        n = 0
        order = np.lexsort((-old, ids, key))
        key, ids, old = key[order], ids[order], old[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]
        key, ids, old = key[new], ids[new], old[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        met = (size > 1) | (np.maximum.reduceat(old, starts) == 2)
        # the class that is held stays the centre; else it is the one that a hash puts first, alike for all keys of a group
        rank = mixed(ids.view(np.uint64))
        rank[old > 0] = 0
        first = np.lexsort((rank, np.repeat(np.arange(len(starts)), size)))[starts]
        out = np.repeat(met, size) & (old < 2)
        k, i, c = key[out].view(np.int64), ids[out], np.repeat(ids[first], size)[out]
        for at in range(0, len(k), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (k, i, c)], names=names)
        key, ids, old = key[starts], ids[first], np.where(met, 2, 1).astype(np.int8)

    for batch in batches:
        for classes, place, every in zip(*(batch.column(c).to_pylist() for c in ("classes", "place", "keys")), strict=True):
            pending.append((np.frombuffer(every, np.uint64), np.frombuffer(classes, np.int64)[np.frombuffer(place, np.uint16)]))
            n += len(pending[-1][0])
            if n >= KEYS_MET:
                yield from settled()
    if pending:
        yield from settled()


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of the pairs a, b that their sizes na, nb and sketches sa, sb let link."""
    for batch in batches:
        a, b, na, nb, sa, sb = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "sa", "sb"))
        keep = [may_link(n, m, distance(x, y)) for n, m, x, y in zip(na, nb, sa, sb, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def possible(pairs: DataFrame, by_class: DataFrame) -> DataFrame:
    one = by_class.select(F.col("cls").alias("ca"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    other = by_class.select(F.col("cls").alias("cb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(one, F.col("a") == F.col("ca")).join(other, F.col("b") == F.col("cb"))
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible, "a long, b long")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that may link within groups of rows (kk, first, second): one of home, of different components, by size and sketch.

    Keys of one leader come one after another: mostly the same documents share them, and their pairs are given once.
    """

    none = np.zeros((0, 2), np.int64)

    def pairs(rows: list[tuple]) -> np.ndarray:
        tiled = any(r[0] for r in rows)
        if len(rows) <= 12:
            few = [
                (r[2], q[2])
                for i, r in enumerate(rows)
                for q in rows[i + 1 :]
                if (r[0] != q[0] or not tiled) and (r[1] or q[1]) and r[3] != q[3] and r[2] != q[2] and may_link(r[4], q[4], distance(r[5], q[5]))
            ]
            return np.array(few, np.int64).reshape(-1, 2)
        side, home, ids, comp, n = (np.array([r[i] for r in rows]) for i in range(5))
        bits = []
        short = min(len(r[5]) for r in rows)
        for r in rows:
            x = np.frombuffer(r[5], np.uint64)
            while len(x) * 8 > short:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            bits.append(x)
        x, out = np.stack(bits), [none]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if tiled else left
        for i in left:
            j = right[right > i] if not tiled else right
            j = j[(comp[j] != comp[i]) & (ids[j] != ids[i]) & (home[j] | home[i]) & (SHARE[0] * np.minimum(n[j], n[i]) >= SHARE[1] * np.maximum(n[j], n[i]))]
            if len(j):
                apart = np.bitwise_count(x[j] ^ x[i]).sum(axis=1, dtype=np.int64)
                j = j[(SHARE[0] + SHARE[1]) * apart <= (SHARE[0] - SHARE[1]) * (n[j] + n[i])]
                out.append(np.column_stack([np.full(len(j), ids[i]), ids[j]]))
        return np.concatenate(out)

    def once(found: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.sort(np.concatenate([none, *found]), axis=1), axis=0)

    def given(had: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(had), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(had[at : at + 100_000, k]) for k in (0, 1)], names=["a", "b"])

    at, rows, found, n = None, [], [], 0
    for batch in batches:
        group = zip(*(batch.column(c).to_pylist() for c in ("leader", "first", "second", "kk")), strict=True)
        for g, row in zip(group, zip(*(batch.column(c).to_pylist() for c in ("side", "home", "id", "comp", "n", "sketch")), strict=True), strict=True):
            if g != at:
                if len(rows) > 1:
                    found.append(pairs(rows))
                    n += len(found[-1])
                if n > 1_000_000:
                    found, n = [once(found)], 0
                if at is not None and g[:3] != at[:3]:
                    if any(map(len, found)):
                        yield from given(once(found))
                    found, n = [], 0
                at, rows = g, []
            rows.append(row)
    if len(rows) > 1:
        found.append(pairs(rows))
    yield from given(once(found))


def met_pairs(left: DataFrame, by_class: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of rows (k, id, comp, n) that share a key, lie in different components and may link by sketch.

    Within a key only documents of about one size meet: each is at home in the step of its size and a guest in the next
    one, steps being as far apart as sizes of linked documents can be. A step with more than TILE rows is compared in
    pairs of tiles. Keys with the same first class are compared by one task, which gives a pair once. Sketches join when it is known which rows meet others at all.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(SHARE[0] / SHARE[1]))).cast("int")
    steps = F.array(F.struct(step.alias("s"), F.lit(True).alias("home")), F.struct((step + 1).alias("s"), F.lit(False).alias("home")))
    rows = left.select("k", "id", "comp", "n", F.explode(steps).alias("at")).select(F.xxhash64("k", "at.s").alias("kk"), F.col("at.home").alias("home"), "id", "comp", "n")
    groups = rows.groupBy("kk").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("home").alias("home"), F.min("id").alias("leader")).where("lo <> hi and home")
    groups = groups.select(other_key("kk").alias("gk"), F.ceil(F.col("c") / TILE).cast("int").alias("tiles"), "leader")
    tiled = cut(rows.join(groups, other_key("kk") == F.col("gk")).select("kk", "home", "id", "comp", "n", "tiles", "leader"), "stepped")
    bits = by_class.select(F.col("cls").alias("sid"), "sketch")
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("first"), F.greatest("tile", t).alias("second"), F.when(F.col("tile") > t, 1).otherwise(0).alias("side")))
    rows = tiled.join(bits, F.col("id") == F.col("sid")).withColumn("tile", tile).withColumn("pair", F.explode(pair))
    rows = rows.select("leader", "kk", "pair.first", "pair.second", "pair.side", "home", "id", "comp", "n", "sketch")
    found = rows.repartition("leader", "first", "second").sortWithinPartitions("leader", "first", "second", "kk", "side", "id").mapInArrow(_compared, "a long, b long")
    found = cut(found.distinct(), "compared")
    drop_cut(tiled)
    return found


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by (a, salt, role): first a centre's text, then those of the others."""
    centre, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = [], []
        ids = zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "role", "id")), strict=True)
        for (at, salt, role, other), s in zip(ids, shingle_sets(batch.column("text")), strict=True):
            if role == 0:
                centre, own = (at, salt), s
            elif centre == (at, salt):
                both = len(np.intersect1d(own, s, assume_unique=True))
                if both and SHARE[0] * both >= SHARE[1] * (len(own) + len(s) - both):
                    a.append(at)
                    b.append(other)
            else:
                raise ValueError("a centre's text is missing")
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts link. A centre a with many others is copied once per PER_CENTRE of them."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_CENTRE).cast("int").alias("copies"))
    salted = pairs.join(many.select(F.concat(F.lit("c"), "a").alias("ck"), "copies"), F.concat(F.lit("c"), F.col("a")) == F.col("ck"))
    others = salted.select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id"))
    centres = others.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id"))
    rows = others.union(centres).join(texts.withColumnRenamed("id", "text_id"), F.col("id") == F.col("text_id")).drop("text_id")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "id").mapInArrow(_verified, "a long, b long")


def crowded(rows: DataFrame, times: int = 2) -> DataFrame:
    """Rows (k, id, comp, n) of keys with several components, without ids that share too few of them to link across.

    A link between components has all its shared keys among these rows, more than the surplus of the smaller size, so
    neither end is ever left out; keys that one component has to itself by then go too.
    """
    for _ in range(times):
        enough = rows.groupBy("id").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") > surplus_of(F.floor(F.col("n") * SHARE[1] / SHARE[0])))
        rows = rows.join(enough.select("id"), "id", "left_semi")
        several = rows.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        rows = rows.join(several.select("k"), "k", "left_semi")
    return rows


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, n_shingles, component_id of every row of docs; th is a hash of the text.

    component_id is the smallest id reachable by links; documents with equal sets link. Empty and null texts have no
    shingle and link with nothing; rows repeated with one id and text get the same answer; a null id loses against any
    other. Equal sets are one class from the start, so copies are never paired. Classes that share a block key are
    compared with one centre per key first and joined into components; what then still lies in different components
    of a key is compared in full, so no link that would join two components is missed.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), "text")
    every = cut(rows.mapInArrow(_classes, _CLASSES), "sized")
    counts = np.zeros((CELL_ROWS, CELLS // CELL_ROWS), np.int64)
    summed = every.where("n = -1").select("th", "sketch").repartition("th").mapInArrow(_summed, "th long, sketch binary")
    for r in summed.toArrow().to_pylist():
        counts[r["th"]] = np.frombuffer(zlib.decompress(r["sketch"]), np.int64)
    level = levels(counts.ravel())
    sized = every.where("n >= 0").select("doc_id", "th", "n", "cls")
    by_class = cut(every.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    total = by_class.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spark = docs.sparkSession
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * KEYS_PER_BUCKET))))

    dealt = rows.select("text").mapInArrow(_dealt(level, buckets), "bucket int, classes binary, place binary, keys binary")
    met = cut(dealt.repartitionById(buckets, "bucket").mapInArrow(_met, "key long, id long, centre long"), "met")
    # a class that shares fewer keys in all than the smallest partner it could link with must share has no link
    sizes = by_class.select(F.col("cls").alias("sid"), "n")
    enough = met.groupBy("id").agg(F.count("*").alias("met")).join(sizes, F.col("id") == F.col("sid")).where(F.col("met") > surplus_of(F.floor(F.col("n") * SHARE[1] / SHARE[0])))
    few = met
    met = cut(met.join(enough.select(F.col("sid")), F.col("id") == F.col("sid"), "left_semi"), "met")
    drop_cut(few)
    wanted = cut(met.select("id").distinct().join(by_class, F.col("id") == F.col("cls")).select("id", F.col("one.doc_id").alias("one_id"), F.col("one.th").alias("one_th")), "wanted")
    meeting = wanted.count()
    listed = F.broadcast(wanted) if meeting <= BROADCAST_ROWS else wanted
    texts = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("th") == F.col("one_th"))).select("id", "text").dropDuplicates(["id"])
    texts = cut(texts, "met-texts")

    links, comp, tried, written = None, None, None, [texts, wanted]
    turn, stars = 0, True
    while True:
        if turn == 0:
            near = met.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))
        else:
            # of keys whose classes are of one component by now nothing is left to find: they go for good
            placed = met.select("key", "id") if comp is None else met.select("key", "id").join(comp.withColumnRenamed("id", "cid"), F.col("id") == F.col("cid"), "left")
            placed = placed.select("key", "id", (F.col("id") if comp is None else F.coalesce("component", "id")).alias("comp"))
            centres = F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(turn * CENTRES + k)).alias("h"), "id", "comp")) for k in range(CENTRES if stars else 1)])
            centres = F.transform(centres, lambda c: F.struct(c["id"].alias("id"), c["comp"].alias("comp"))).alias("centres")
            mixed_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), centres).where("lo <> hi").select(other_key("key").alias("mk"), "centres")
            unlike = cut(placed.join(mixed_keys, other_key("key") == F.col("mk")).select("key", "id", "comp", *(["centres"] if stars else [])), "unlike")
            drop_cut(met)
            met = unlike
            if stars:
                near = unlike.select("comp", F.col("id").alias("b"), F.explode(F.array_distinct("centres")).alias("c")).where("comp <> c.comp").select(F.col("c.id").alias("a"), "b")
        if stars:
            top = F.slice(F.sort_array(F.collect_list(F.struct("count", "a")), asc=False), 1, CENTRES)
            best = near.groupBy("a", "b").count().where("count > 1").groupBy("b").agg(top.alias("top")).select(F.explode("top.a").alias("a"), "b")
            best = best.join(wanted.select(F.col("id").alias("a")), "a", "left_semi")  # a first centre may share too little with all others
            pairs = possible(best.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b").dropDuplicates(["x", "y"]).select("a", "b"), by_class)
        else:
            left = cut(crowded(met.join(sizes, F.col("id") == F.col("sid")).select(F.col("key").alias("k"), "id", "comp", "n")), "crowded")
            pairs = met_pairs(left, by_class)
            written += [left, pairs]
        if tried is not None:
            done = tried.select(F.least("a", "b").alias("da"), F.greatest("a", "b").alias("db"))
            pairs = pairs.join(done, (F.least("a", "b") == F.col("da")) & (F.greatest("a", "b") == F.col("db")), "left_anti")
        pairs = cut(pairs, "pairs")
        written.append(pairs)
        free_shuffles(spark)
        found, of = 0, pairs.count()
        if of:
            new = cut(verify(pairs, texts), "links")
            written.append(new)
            found = new.count()
            tried = pairs if tried is None else tried.union(pairs)
            links = new if links is None else links.union(new)
            drop_cut(comp)
            comp = cut(components(links), "components")
            free_shuffles(spark)
        if not stars:
            break
        # pairs of stars share two keys, short documents may share one: only the full round ends it
        turn += 1
        stars = turn < STAR_ROUNDS and (turn == 1 or found > STAR_GAIN * meeting)
    written.append(met)

    if comp is None:
        root = by_class.select("cls", F.col("one.doc_id").alias("component_id"))
    else:
        joined = by_class.join(comp, F.col("cls") == F.col("id"), "left").select("cls", "one.doc_id", F.coalesce("component", "cls").alias("c"))
        least = joined.groupBy("c").agg(F.min("doc_id").alias("component_id"))
        root = joined.join(least.select(F.concat(F.lit("c"), "c").alias("lc"), "component_id"), F.concat(F.lit("c"), F.col("c")) == F.col("lc")).select("cls", "component_id")
    root = cut(root.withColumnRenamed("cls", "root_cls"), "roots")
    for df in (*written, comp, by_class):
        drop_cut(df)
    out = sized.join(root, F.col("cls") == F.col("root_cls"), "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of every component the document with the smallest id. Columns of docs are kept.

    The list of those that go is broadcast if it has at most BROADCAST_ROWS rows, so that texts need not move.
    """
    gone = similar_classes(docs, id_col, text_col).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = cut(gone.select(F.col("doc_id").alias("__gone_id"), F.col("th").alias("__gone_th")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else gone
    hashed = docs.withColumn("__th", F.xxhash64(text_or_empty(text_col)))
    return hashed.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__gone_id")) & (F.col("__th") == F.col("__gone_th")), "left_anti").select(*docs.columns)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from w),
n as (select doc_id, len(s) n from s),
x as materialized (select doc_id, unnest(s) g from s),
p as (select a.doc_id a, b.doc_id b, count(*) k from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as materialized (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 75 * (na.n + nb.n - k)),
e as materialized (select a u, b v from l union select b, a from l),
r(doc_id, root) as (select u, u from e union select e.v, r.root from r join e on e.u = r.doc_id)
select n.doc_id, n.n::bigint n_shingles, coalesce(min(r.root), n.doc_id) component_id from n left join r on r.doc_id = n.doc_id group by n.doc_id, n.n
"""
