"""Event processing in batch: debounce, staleness, lifetimes, sequences, permits, run states and verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillon.registry import both, query, run_sql

#: Change signals derived from events: one document per user, milliseconds, kind, mutation count and hashes.
SIGNALS = """s as (select event_id id, user_id doc, cast(floor(epoch_us / 1000) as bigint) ms, case event_type when 'view' then 'STRUCTURAL' when 'click' then 'VISUAL' else 'DYNAMIC' end kind, event_id % 4 mutations, event_id % 3 h_old, event_id % 5 % 3 h_new from e)"""
SPARK_E = "e as (select *, unix_micros(cast(ts as timestamp)) epoch_us from events)"
DUCK_E = "e as (select *, epoch_us(ts) epoch_us from events)"
DEBOUNCE_MS, INTERVAL_MS, TTL_MS = 3_600_000, 14_400_000, 600_000


@query("change_gate", "T-01 T-02", f"""with recursive {DUCK_E}, {SIGNALS}, o as (select *, row_number() over (partition by doc order by ms, id) rn from s),
w as (select doc, rn, id, ms, true accepted, ms last_ok, ms last_hash, true hashed from o where rn = 1
 union all select o.doc, o.rn, o.id, o.ms, d.ok, case when d.ok then o.ms else w.last_ok end, case when o.ms - w.last_hash >= {INTERVAL_MS} then o.ms else w.last_hash end, o.ms - w.last_hash >= {INTERVAL_MS}
 from w join o on o.doc = w.doc and o.rn = w.rn + 1, lateral (select o.ms - w.last_ok >= {DEBOUNCE_MS} and not (o.kind = 'STRUCTURAL' and o.mutations = 0) and not (o.kind = 'VISUAL' and o.h_old = o.h_new) ok) d)
select id, doc, accepted, hashed from w""")  # fmt: skip
def change_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First signal of a document passes; later ones only after the debounce and if they changed something. Also when a full hash is due.

    Documents are dealt out and their signals sorted by Spark; a task goes through them with two numbers as its state, so no
    document's history is gathered.
    """
    s = run_sql(spark, sf_dir, f"with {SPARK_E}, {SIGNALS} select * from s")
    return s.repartition("doc").sortWithinPartitions("doc", "ms", "id").mapInPandas(gated, "id bigint, doc bigint, accepted boolean, hashed boolean")


def gated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Signals that come by doc, ms and id, with what the gate says of each."""
    doc = accepted = hashed = None
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            if r.doc != doc:
                doc, accepted, hashed = r.doc, None, None
            idle = (r.kind == "STRUCTURAL" and r.mutations == 0) or (r.kind == "VISUAL" and r.h_old == r.h_new)
            ok, due = accepted is None or (r.ms - accepted >= DEBOUNCE_MS and not idle), hashed is None or r.ms - hashed >= INTERVAL_MS
            accepted, hashed = (r.ms if ok else accepted), (r.ms if due else hashed)
            out.append((r.id, r.doc, ok, due))
        yield pd.DataFrame(out, columns=["id", "doc", "accepted", "hashed"])


def signals_query(name: str, covers: str, body: str) -> None:
    both(name, covers, f"with {SPARK_E}, {SIGNALS}, {body}", f"with {DUCK_E}, {SIGNALS}, {body}")


signals_query("structural_sequence", "T-04 W-02", """q as (select id, doc, cast(sum(case when kind = 'STRUCTURAL' and mutations > 0 then 1 else 0 end) over (partition by doc order by ms, id rows between unbounded preceding and current row) as bigint) seq,
  cast(sum(case when kind = 'VISUAL' then 1 else 0 end) over (partition by doc order by ms, id rows between unbounded preceding and current row) as bigint) visual, row_number() over (partition by doc, kind order by ms, id) ordinal, kind from s)
select q.id, q.doc, q.seq, q.visual, kind || ':' || cast(ordinal as string) region_id, coalesce(q.seq <> lag(q.seq) over (partition by doc order by q.id), true) stale from q""")  # fmt: skip

signals_query("frame_lifetime", "T-03 W-06", f"""l as (select id, doc, ms, lag(ms) over (partition by doc order by id) prev from s)
select id, doc, cast(ms - prev as bigint) gap, coalesce(ms - prev > {TTL_MS}, false) stale, coalesce(ms >= prev, true) in_order, case when ms - prev > 30000 then 'DEADLINE' else 'IN_TIME' end deadline from l""")  # fmt: skip


signals_query("one_use_permits", "T-07", """o as (select id, cast(floor(id / 4) as bigint) permit, case id % 4 when 0 then 'MINT' else 'REDEEM' end op, ms, id % 9 <> 0 fits from s),
m as (select permit, min(ms) minted, min(ms) + 900000 expires from o where op = 'MINT' group by permit),
r as (select o.*, m.minted, m.expires, row_number() over (partition by o.permit, o.op order by o.id) n from o left join m on m.permit = o.permit)
select id, permit, op, case when op = 'MINT' then 'LIVE' when minted is null then 'NOT_ISSUED' when n > 1 then 'CONSUMED' when ms >= expires then 'EXPIRED' when not fits then 'SPENT_UNFIT' else 'REDEEMED' end state from r""")  # fmt: skip


STATES = "('IDLE', 'OBSERVE', 'SANITIZE', 'VERIFY_PAYLOAD', 'SEND', 'VALIDATE_PLAN', 'AWAIT_GRANT', 'REHYDRATE', 'ACT', 'VERIFY_RESULT', 'DONE', 'FAILED', 'CANCELLED')"

signals_query("task_loop", "T-12", """t as (select id, doc, row_number() over (partition by doc order by ms, id) - 1 k from s),
u as (select doc, cast(floor(k / 5) as bigint) task, k % 5 turn, case id % 10 when 0 then 'SUCCEEDED' when 1 then 'REFUSED' when 2 then 'HOSTILE' when 3 then 'TIMEOUT' else 'CONTINUE' end outcome from t),
f as (select doc, task, min(case when outcome <> 'CONTINUE' then turn end) first_end, count(*) turns from u group by doc, task)
select f.doc, f.task, f.turns, case when u.outcome is null then case when f.turns >= 5 then 'TURN_LIMIT' else 'RUNNING' end else u.outcome end outcome, case when u.outcome = 'HOSTILE' then 'NEVER' when u.outcome = 'TIMEOUT' then 'LOCAL_RULES' when u.outcome = 'REFUSED' then 'ASK' end fallback
from f left join u on u.doc = f.doc and u.task = f.task and u.turn = f.first_end""")  # fmt: skip
