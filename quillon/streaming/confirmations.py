"""Human confirmations as keyed state: recorded once, covering one control for a time, spent by the first act that needs one.

A confirmation is its own state: what it was given for (`recorded`) and whether an act has used it (`spent`), two variables
that change apart. When its time and what `keep` adds are over, a timer clears both, so state holds what is live and not all that ever was;
what an operation hears hangs on its own time alone, never on whether the timer has fired.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SUBJECT = ("selector", "role", "name", "origin", "frame", "node")
#: Operations on confirmations: RECORD, STATE, COVERS, SPEND and MINT (covers, then spends). subject is what they name.
OPS = "confirmation long, id long, at timestamp, ms long, op string, selector string, role string, name string, origin string, frame long, node long, purpose string, ttl_ms double"
VERDICTS = "confirmation long, id long, op string, verdict string, purpose string"


def blank(x: object) -> bool:
    return not isinstance(x, str) or not x.strip()


def missing(x: object) -> bool:
    return x is None or x != x


def refused(r) -> str | None:
    """Why a RECORD makes no confirmation."""
    if blank(r.selector) or blank(r.role) or not isinstance(r.name, str) or blank(r.origin) or missing(r.frame) or missing(r.node):
        return "INVALID_SUBJECT"
    if blank(r.purpose):
        return "EMPTY_PURPOSE"
    if missing(r.ttl_ms) or not math.isfinite(r.ttl_ms) or r.ttl_ms <= 0:
        return "INVALID_TTL"
    return None


def mismatch(subject: tuple, expires: float, spent: bool, r) -> str | None:
    """Why a recorded confirmation does not cover what r names, now."""
    if spent:
        return "ALREADY_SPENT"
    if r.ms >= expires:
        return "EXPIRED"
    selector, role, name, origin, frame, node = subject
    if blank(r.origin):
        return "ORIGIN_NOT_SUPPLIED"
    if r.origin != origin:
        return "DIFFERENT_ORIGIN"
    if r.frame != frame:
        return "DIFFERENT_FRAME"
    return None if (r.node, r.selector, r.role, r.name) == (node, selector, role, name) else "DIFFERENT_TARGET"


def judged(rows: Iterable, held: tuple | None, spent_at: int | None, keep_ms: int) -> tuple[list[tuple], tuple | None, int | None, bool]:
    """(id, op, verdict, purpose) of a confirmation's operations in their order, and what it is afterwards: held, spent_at, and whether held is new."""
    fresh, out = False, []
    for r in rows:
        if held is not None and r.ms >= held[7] + keep_ms:
            held, spent_at, fresh = None, None, False
        if r.op == "RECORD":
            verdict = refused(r) if held is None else "ALREADY_RECORDED"
            if verdict is None:
                held, fresh, verdict = (r.selector, r.role, r.name, r.origin, int(r.frame), int(r.node), r.purpose, r.ms + float(r.ttl_ms)), True, "RECORDED"
        elif held is None:
            verdict = "NOT_RECORDED"
        elif r.op == "STATE":
            verdict = "SPENT" if spent_at is not None else "EXPIRED" if r.ms >= held[7] else "LIVE"
        elif r.op == "SPEND":
            verdict = "SPENT" if spent_at is None else "ALREADY_SPENT"
        else:
            verdict = mismatch(held[:6], held[7], spent_at is not None, r) or ("COVERS" if r.op == "COVERS" else "MINTED")
        if (r.op, verdict) in (("SPEND", "SPENT"), ("MINT", "MINTED")):
            spent_at = int(r.ms)
        out.append((int(r.id), r.op, verdict, held[6] if held is not None else None))
    return out, held, spent_at, fresh


class Confirmations(StatefulProcessor):
    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recorded = handle.getValueState("recorded", "selector string, role string, name string, origin string, frame long, node long, purpose string, expires_ms double")
        self.spent = handle.getValueState("spent", "at_ms long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.recorded.get() if self.recorded.exists() else None
        was_spent = self.spent.get()[0] if self.spent.exists() else None
        out, held, spent_at, fresh = judged(pd.concat(list(rows)).sort_values(["ms", "id"]).itertuples(), held, was_spent, self.keep_ms)
        if held is None:
            self.recorded.clear()
            self.spent.clear()
        elif fresh:
            self.recorded.update(held)
            self.spent.clear()
            self.handle.registerTimer(int(held[7]) + self.keep_ms)
        if held is not None and spent_at is not None and (fresh or spent_at != was_spent):
            self.spent.update((spent_at,))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["confirmation", "id", "op", "verdict", "purpose"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.recorded.get() if self.recorded.exists() else None
        if held is not None and int(held[7]) + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.recorded.clear()
            self.spent.clear()
        yield pd.DataFrame([], columns=["confirmation", "id", "op", "verdict", "purpose"])


class Buckets(StatefulProcessor):
    """Many confirmations at a time: the same two variables, each a list with the confirmation first, so that a call on the state store is about a bucket and not about a confirmation."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recorded = handle.getListState("recorded", "confirmation long, selector string, role string, name string, origin string, frame long, node long, purpose string, expires_ms double")
        self.spent = handle.getListState("spent", "confirmation long, at_ms long")

    def close(self) -> None:
        pass

    def _read(self) -> tuple[dict, dict]:
        held = {r[0]: tuple(r[1:]) for r in self.recorded.get()} if self.recorded.exists() else {}
        return held, dict(self.spent.get()) if held and self.spent.exists() else {}

    def _write(self, held: dict, spent: dict, changed: tuple[bool, bool]) -> None:
        for state, rows, dirty in ((self.recorded, [(k, *v) for k, v in held.items()], changed[0]), (self.spent, list(spent.items()), changed[1])):
            if dirty and rows:
                state.put(rows)
            elif dirty:
                state.clear()
        if changed[0] and held:
            self.handle.registerTimer(int(min(v[7] for v in held.values())) + self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, spent = self._read()
        old_held, old_spent, out = dict(held), dict(spent), []
        ops = pd.concat(list(rows)).sort_values(["confirmation", "ms", "id"])
        for confirmation, own in groupby(ops.itertuples(), key=lambda r: int(r.confirmation)):
            said, now, spent_at, _ = judged(own, held.pop(confirmation, None), spent.pop(confirmation, None), self.keep_ms)
            out += [(confirmation, *x) for x in said]
            if now is not None:
                held[confirmation] = now
                if spent_at is not None:
                    spent[confirmation] = spent_at
        self._write(held, spent, (held != old_held, spent != old_spent))
        yield pd.DataFrame(out, columns=["confirmation", "id", "op", "verdict", "purpose"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, spent = self._read()
        over = {k for k, v in held.items() if int(v[7]) + self.keep_ms <= timerValues.getCurrentWatermarkInMs()}
        if over:
            self._write({k: v for k, v in held.items() if k not in over}, {k: v for k, v in spent.items() if k not in over}, (True, not over.isdisjoint(spent)))
        yield pd.DataFrame([], columns=["confirmation", "id", "op", "verdict", "purpose"])


def confirmed(ops: DataFrame, keep_ms: int, late: str = "0 seconds") -> DataFrame:
    """Verdict of each operation of the stream ops (OPS), in order of ms and id within a confirmation and a micro-batch."""
    keyed = ops.withWatermark("at", late).groupBy("confirmation")
    return keyed.transformWithStateInPandas(statefulProcessor=Confirmations(keep_ms), outputStructType=VERDICTS, outputMode="Append", timeMode="EventTime")


def confirmed_in_buckets(ops: DataFrame, keep_ms: int, buckets: int, late: str = "0 seconds") -> DataFrame:
    """confirmed, with confirmations dealt to that many buckets by a hash; all starts on one checkpoint need the same number."""
    keyed = ops.withColumn("bucket", F.pmod(F.xxhash64("confirmation"), F.lit(buckets))).withWatermark("at", late).groupBy("bucket")
    return keyed.transformWithStateInPandas(statefulProcessor=Buckets(keep_ms), outputStructType=VERDICTS, outputMode="Append", timeMode="EventTime")


def at_of(ms: Column) -> Column:
    return F.timestamp_millis(ms)
