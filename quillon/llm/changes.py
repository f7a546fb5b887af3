"""Sequenced changes of clients, applied in the order of their numbers by a stateful streaming query over buckets of clients."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.llm.base import cut, drop_cut, shared_dir

BATCHES = 8
#: First day of the first batch (days since 1970), and the days that the batches share.
FIRST_DAY, DAYS = 19_723, 160
#: A gap is given up once a held row is so many days older than the newest row of earlier batches.
PATIENCE = 5
#: Rows of a bucket over all batches, about; a client stays in one bucket.
BUCKET_ROWS = 50_000
#: Stand for a null client_id and a null change_id.
_NO_CLIENT, _NO_CHANGE = -(2**63), 2**63 - 1

INPUT = "bucket int, tick boolean, batch int, newest int, last boolean, client long, n long, day int, change long, tie long, op string, city string, has boolean, cents long"
OUTPUT = "client long, change long, n long, op string, status string, batch int, missed long, city string, cents long"
ROW = ["client", "n", "day", "change", "tie", "op", "city", "has", "cents"]


def spans(starts: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the number of the segment that it is in; starts: the segments' first places."""
    out = np.zeros(n, np.int64)
    out[starts[1:]] = 1
    return np.cumsum(out)


def carried(sets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each place the last one up to it, in its segment, that sets something; -1 if none. start: where its segment begins."""
    last = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1)) if len(sets) else np.zeros(0, np.int64)
    return np.where(last >= start, last, -1)


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=ROW)
    return out.astype({"client": "int64", "n": "int64", "day": "int64", "change": "int64", "tie": "int64", "has": bool, "cents": "int64"})


def given_up(held: pd.DataFrame, newest: int | None, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which held rows go now because their client's gap is given up, and which of them are the first of a run.

    held comes by client and n. What a client holds are runs of consecutive numbers. From the first run on, the client jumps to a
    run as long as the earliest day of all it still holds is PATIENCE behind; that day only grows, so a prefix of the runs goes.
    """
    client, n, day = (held[c].to_numpy() for c in ("client", "n", "day"))
    size = len(held)
    if not size or (newest is None and not last):
        return np.zeros(size, bool), np.zeros(size, bool)
    same = np.r_[False, client[1:] == client[:-1]]
    head = ~(same & np.r_[False, n[1:] == n[:-1] + 1])
    starts = np.flatnonzero(head)
    earliest = np.minimum.reduceat(day, starts)
    of = client[starts]
    # least day from each run to its client's last: client by client, from the back
    block = spans(np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of))
    order = np.argsort(-np.arange(len(of)))
    shifted = earliest[order].astype(np.int64) + (block[order]) * (1 << 32)  # later clients come first and lie higher
    rest = np.empty(len(of), np.int64)
    rest[order] = np.minimum.accumulate(shifted) - block[order] * (1 << 32)
    goes = np.full(len(of), True) if last else rest + PATIENCE <= newest
    return goes[spans(starts, size)], head


class Applier(StatefulProcessor):
    """One bucket of clients. State: held rows by (client, n); of each client with applied rows its next number and its values."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "client long, n long", "day int, change long, tie long, op string, city string, has boolean, cents long")
        self.clients = handle.getMapState("clients", "client long", "next long, city string, has boolean, cents long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows), ignore_index=True)
        ticks = got[got["tick"]]
        batch, last = int(got["batch"].iloc[0]), bool(ticks["last"].any())
        newest = None if ticks["newest"].isna().all() else int(ticks["newest"].max())
        new = frame(got.loc[~got["tick"], ROW].itertuples(index=False, name=None))
        held = frame([(*k, *v) for k, v in self.held.iterator()]).sort_values(["client", "n"], ignore_index=True)
        known = {k[0]: v for k, v in self.clients.iterator()}
        out, stays, applied = apply_batch(held, new, known, batch, newest, last)
        before = set(zip(held["client"], held["n"], strict=True))
        after = set(zip(stays["client"], stays["n"], strict=True))
        for gone in before - after:
            self.held.removeKey(tuple(map(int, gone)))
        for r in stays.itertuples(index=False):
            if (r.client, r.n) not in before:
                self.held.updateValue((int(r.client), int(r.n)), (int(r.day), int(r.change), int(r.tie), r.op, r.city, bool(r.has), int(r.cents)))
        for client, value in applied.items():
            self.clients.updateValue((int(client),), value)
        if len(out):
            yield out


def apply_batch(held: pd.DataFrame, new: pd.DataFrame, known: dict, batch: int, newest: int | None, last: bool) -> tuple[pd.DataFrame, pd.DataFrame, dict]:
    """(rows applied or rejected, rows held from now on by client and n, the clients' new values) of one batch of a bucket.

    Of a number's rows in a batch the first by day and change wins if the number is neither held nor below next: numbers are
    below next only if they were so before the batch or came in it themselves, so no other order is needed.
    """
    known_next = lambda clients: np.fromiter((known[c][0] if c in known else 1 for c in clients.tolist()), np.int64, len(clients))
    goes, head = given_up(held, newest, last)
    jumped, held = held[goes], held[~goes]
    run_head = head[goes]
    # numbers that a jump leaves out: from the end of the client's run before, or from next
    client, n = jumped["client"].to_numpy(), jumped["n"].to_numpy()
    follows = np.r_[False, client[1:] == client[:-1]] if len(client) else np.zeros(0, bool)
    base = np.where(follows, np.r_[0, n[:-1] + 1] if len(n) else n, known_next(client))
    missed = np.where(run_head, n - base, 0)
    at = dict(zip(client.tolist(), (n + 1).tolist(), strict=True))  # the last of a client wins
    # what came
    new = new.sort_values(["client", "n", "day", "change", "tie"], ignore_index=True)
    next_of = np.fromiter((at[c] if c in at else known[c][0] if c in known else 1 for c in new["client"].tolist()), np.int64, len(new))
    first = ~new.duplicated(["client", "n"]).to_numpy()
    taken = pd.MultiIndex.from_frame(new[["client", "n"]]).isin(pd.MultiIndex.from_frame(held[["client", "n"]])) if len(held) and len(new) else np.zeros(len(new), bool)
    wins = first & (new["n"].to_numpy() >= next_of) & ~taken
    rejected = new[~wins]
    held = pd.concat([held, new[wins]], ignore_index=True).sort_values(["client", "n"], ignore_index=True)
    # what follows on next without a gap
    client, n = held["client"].to_numpy(), held["n"].to_numpy()
    starts = np.flatnonzero(np.r_[True, client[1:] != client[:-1]]) if len(held) else np.zeros(0, np.int64)
    place = np.arange(len(held)) - starts[spans(starts, len(held))] if len(held) else np.zeros(0, np.int64)
    next_of = np.fromiter((at[c] if c in at else known[c][0] if c in known else 1 for c in client.tolist()), np.int64, len(held))
    runs_on = n - place == next_of
    applied = pd.concat([jumped.assign(missed=missed), held[runs_on].assign(missed=0)], ignore_index=True).sort_values(["client", "n"], ignore_index=True)
    held = held[~runs_on]
    # values after each applied row: the last that set one, in its client's stretch, else what the client had
    client = applied["client"].to_numpy()
    starts = np.flatnonzero(np.r_[True, client[1:] != client[:-1]]) if len(applied) else np.zeros(0, np.int64)
    start = starts[spans(starts, len(applied))] if len(applied) else starts
    op, city, has, cents = (applied[c].to_numpy() for c in ("op", "city", "has", "cents"))
    whole, gone, named = (op == "I") | (op == "D"), op == "D", np.array([c is not None and c == c for c in city], bool)
    city = np.where(gone | ~named, None, city) if len(city) else city
    has = has & ~gone
    by_city, by_cents = carried(whole | named, start), carried(whole | has, start)
    blank = (1, None, False, 0)
    old = [known.get(c, blank) for c in client[starts].tolist()]
    part = spans(starts, len(applied)) if len(applied) else starts
    pick = lambda values, last_set, i: [values[k] if k >= 0 else old[p][i] for k, p in zip(last_set.tolist(), part.tolist(), strict=True)]
    city, has, cents = pick(city, by_city, 1), pick(has, by_cents, 2), pick(cents, by_cents, 3)
    ends = np.r_[starts[1:], len(applied)] - 1 if len(applied) else starts
    values = {int(client[e]): (int(applied["n"].iat[e]) + 1, city[e], bool(has[e]), int(cents[e])) for e in ends}
    shown = pd.array([int(c) if h else None for c, h in zip(cents, has, strict=True)], "Int64")
    done = applied[["client", "change", "n", "op"]].assign(status="applied", batch=batch, missed=applied["missed"], city=pd.Series(city, dtype=object), cents=shown)
    lost = rejected[["client", "change", "n", "op"]].assign(status="rejected", batch=batch, missed=0, city=pd.Series([None] * len(rejected), index=rejected.index, dtype=object), cents=pd.array([None] * len(rejected), "Int64"))
    out = pd.concat([x for x in (done, lost) if len(x)], ignore_index=True) if len(done) or len(lost) else done
    return out, held, values


def numbered(rows: DataFrame) -> DataFrame:
    """rows with n, the dense rank of seq (nulls last) per client. No client is ranked as a whole: pairs of client and seq are
    dealt by range, ranked within a partition, and each partition adds what the ones before it have of the same client."""
    pairs = rows.select("client", "seq").distinct().repartitionByRange("client", F.col("seq").asc_nulls_last())
    pairs = cut(pairs.withColumn("p", F.spark_partition_id()), "numbers")
    within = F.row_number().over(Window.partitionBy("p", "client").orderBy(F.col("seq").asc_nulls_last()))
    counts = pairs.groupBy("client", "p").agg(F.count("*").alias("c"))
    # at most one row for each partition that a client reaches into
    before = F.coalesce(F.sum("c").over(Window.partitionBy("client").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).select(F.col("client").alias("k"), F.col("p").alias("kp"), "before")
    ranked = pairs.withColumn("i", within).join(offsets, (F.col("client") == F.col("k")) & (F.col("p") == F.col("kp")))
    ranked = ranked.select(F.col("client").alias("k"), F.col("seq").alias("s"), (F.col("before") + F.col("i")).cast("long").alias("n"))
    return rows.join(ranked, (F.col("client") == F.col("k")) & F.col("seq").eqNullSafe(F.col("s"))).drop("k", "s")


def apply_changes(changes: DataFrame, batches: int = BATCHES, first_day: int = FIRST_DAY, days: int = DAYS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """change_id, client_id, status, batch, missed, city, cents, current of every distinct row that arrives.

    A change arrives on its day, valid_at's day plus 0, 2, 4 or 6 by a hash of its change_id; rows without valid_at and one in
    eleven by that hash never do, though their numbers count. Batches are cut by day and written, and a streaming query with state
    is started anew for each of them on one checkpoint, and once more at the end. Clients are dealt to buckets by a hash; every bucket gets a
    tick with each batch, so gaps are given up even where nothing comes. A task holds one bucket's share of a batch and
    what its clients wait for; the number of buckets grows with the input.

    Defined for odd rows: a null client_id is a client of its own; a null change_id hashes as an empty text and comes last on
    its day; a null seq is a client's last number; a null or unknown op updates like U; a balance that is NaN or
    infinite counts as null; days before the first batch fall into it. Rows of one change_id, day and number that differ
    elsewhere are put in order by a hash of the whole row. An empty table gives an empty result; other columns than the
    nine of the table are ignored.
    """
    spark = changes.sparkSession
    columns = ["change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance"]
    h = F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit("")))
    day = F.datediff(F.col("valid_at").cast("date"), F.lit("1970-01-01").cast("date")) + (2 * (h % 4)).cast("int")
    finite = F.col("balance").isNotNull() & ~F.isnan("balance") & (F.abs("balance") < 1e16)
    rows = changes.select(*columns).distinct().select(
        F.coalesce("client_id", F.lit(_NO_CLIENT)).alias("client"), "seq", day.alias("day"), F.coalesce("change_id", F.lit(_NO_CHANGE)).alias("change"), F.xxhash64(*columns).alias("tie"),
        F.coalesce("op", F.lit("U")).alias("op"), "city", finite.alias("has"), F.when(finite, F.floor(100 * F.col("balance") + 0.5)).otherwise(0).cast("long").alias("cents"), (h % 11 == 0).alias("lost"),
    )
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("day") - first_day) * batches / F.lit(days)))).cast("int")
    arriving = numbered(rows).where("day is not null and not lost").withColumn("batch", batch).drop("seq", "lost")
    arriving = cut(arriving.repartition("batch", F.pmod(F.xxhash64("change", "tie"), F.lit(16))), "changes")
    seen = {r["batch"]: (r["rows"], r["newest"]) for r in arriving.groupBy("batch").agg(F.count("*").alias("rows"), F.max("day").alias("newest")).collect()}
    buckets = max(8, -(-sum(n for n, _ in seen.values()) // bucket_rows))
    bucket = F.pmod(F.xxhash64("client"), F.lit(buckets)).cast("int").alias("bucket")
    root = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    kinds = dict(x.split() for x in INPUT.split(", "))
    newest = None
    for k in range(1, batches + 2):
        nulls = {c: F.lit(None).cast(t).alias(c) for c, t in kinds.items()}
        ticks = spark.range(buckets).select(*[{"bucket": F.col("id").cast("int").alias(c), "tick": F.lit(True).alias(c), "batch": F.lit(k).alias(c), "newest": F.lit(newest).cast("int").alias(c), "last": F.lit(k > batches).alias(c)}.get(c, nulls[c]) for c in kinds])
        came = arriving.where(F.col("batch") == k).select(*[{"bucket": bucket, "tick": F.lit(False).alias(c), "newest": nulls[c], "last": F.lit(False).alias(c)}.get(c, F.col(c)) for c in kinds])
        came.union(ticks.coalesce(1)).write.mode("append").parquet(f"{root}/in")
        fed(spark, root, buckets)
        newest = max((d for b, (_, d) in seen.items() if b <= k), default=None)
    done = spark.read.schema(OUTPUT).parquet(f"{root}/out")
    final = done.where("status = 'applied'").groupBy(F.col("client").alias("k")).agg(F.max("n").alias("top"))
    done = done.join(final, (F.col("client") == F.col("k")) & (F.col("n") == F.col("top")) & (F.col("status") == "applied"), "left")
    out = done.select(
        F.when(F.col("change") < _NO_CHANGE, F.col("change")).alias("change_id"), F.when(F.col("client") > _NO_CLIENT, F.col("client")).alias("client_id"),
        "status", "batch", "missed", "city", "cents", (F.col("k").isNotNull() & (F.col("op") != "D")).alias("current"),
    )
    drop_cut(arriving)
    return out


def fed(spark: SparkSession, root: str, buckets: int) -> None:
    """Starts the query on its checkpoint, gives it all files that it has not seen, and ends it."""
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # each start opens stores of its own; those of ended ones are closed, and their local files go, within seconds
        "spark.sql.streaming.stateStore.maintenanceInterval": "3s",
        # no more stores than buckets
        "spark.sql.shuffle.partitions": str(min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))),
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.readStream.schema(INPUT).parquet(f"{root}/in")
        applied = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Applier(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
        query = applied.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def op13_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_changes(spark.read.parquet(f"{sf_dir}/client_changes.parquet"))
