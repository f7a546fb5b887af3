"""Stateful streaming forms: the change gate and one-use permits, keyed, with state that outlives a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GATE_OUT = "doc long, id long, accepted boolean, hashed boolean"
PERMIT_OUT = "permit long, id long, op string, state string"


def change_gate(signals: DataFrame, debounce_ms: int = 500, interval_ms: int = 2000) -> DataFrame:
    """signals (doc, id, ms, kind, mutations, h_old, h_new) -> GATE_OUT, in order of ms and id inside a micro-batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ok, last_hash = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["ms", "id"])
        out = []
        for r in rows.itertuples():
            idle = (r.kind == "STRUCTURAL" and r.mutations == 0) or (r.kind == "VISUAL" and r.h_old == r.h_new)
            ok = last_ok is None or (r.ms - last_ok >= debounce_ms and not idle)
            due = last_hash is None or r.ms - last_hash >= interval_ms
            last_ok, last_hash = (int(r.ms) if ok else last_ok), (int(r.ms) if due else last_hash)
            out.append((key[0], r.id, ok, due))
        state.update((last_ok, last_hash))
        yield pd.DataFrame(out, columns=["doc", "id", "accepted", "hashed"])

    return signals.groupBy("doc").applyInPandasWithState(step, GATE_OUT, "ok long, hash long", "append", GroupStateTimeout.NoTimeout)


def one_use_permits(ops: DataFrame, lifetime_ms: int) -> DataFrame:
    """ops (permit, id, op, ms, fits) -> PERMIT_OUT. The first redemption spends a permit whether it fits or not; an expired one stays expired."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        minted, spent = state.get if state.exists else (None, False)
        out = []
        for r in pd.concat(list(batches)).sort_values("id").itertuples():
            if r.op == "MINT":
                minted, verdict = (int(r.ms) if minted is None else minted), "LIVE"
            elif minted is None:
                verdict = "NOT_ISSUED"
            elif spent:
                verdict = "CONSUMED"
            else:
                verdict = "EXPIRED" if r.ms >= minted + lifetime_ms else "REDEEMED" if r.fits else "SPENT_UNFIT"
                spent = True
            out.append((key[0], r.id, r.op, verdict))
        state.update((minted, spent))
        yield pd.DataFrame(out, columns=["permit", "id", "op", "state"])

    return ops.groupBy("permit").applyInPandasWithState(step, PERMIT_OUT, "minted long, spent boolean", "append", GroupStateTimeout.NoTimeout)
