"""The query of human confirmations: operations from the event stream, run through the keyed state in two starts on one checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.events import DUCK_E, SPARK_E
from quillon.registry import query, run_sql
from quillon.streaming.confirmations import OPS, at_of, confirmed_in_buckets
from quillon.streaming.runs import run_to_end, shared_dir

#: After its end a confirmation is remembered for so long.
KEEP_MS = 40_000_000
#: Operations of a bucket, about: a task holds one bucket at a time.
BUCKET_ROWS = 10_000
#: Eight operations in the order of their ids are about one confirmation. A subject is read off the event; its operations name it again, some of them another.
OPERATIONS = """o as (select event_id id, cast(floor(event_id / 8) as bigint) confirmation, event_id % 8 k, cast(floor(epoch_us / 1000) as bigint) ms, user_id, event_type, value from e),
f as (select confirmation, user_id u, event_type t, value v from o where k = 0),
p as (select o.id, o.confirmation, o.ms, case when k = 0 then 'RECORD' when event_type = 'view' then 'COVERS' when event_type = 'click' then 'MINT' when value < 20 then 'SPEND' else 'STATE' end op,
  case when k = 0 and value < 1 then ' ' when o.value > 60 and k > 0 then '#pay' else '#e' || cast(f.u % 50 as string) end selector, f.t role, case when k = 0 and value > 90 then null else 'Pay ' || f.t end name,
  case when k > 0 and o.event_type = 'view' and o.user_id % 5 = 0 then null when k > 0 and o.user_id % 11 = 0 then 'https://b.example' else 'https://a.example' end origin,
  case when k > 0 and o.user_id % 13 = 0 then 2 else 1 end frame, f.u node, case when f.v < 3 then '  ' else 'approve ' || f.t end purpose, case when f.v between 50 and 52 then 0e0 when f.v between 53 and 55 then null else f.v * 400000e0 end ttl_ms
  from o join f on f.confirmation = o.confirmation)"""

_SQL = f"""with {DUCK_E}, {OPERATIONS},
q as (select *, case when op = 'RECORD' then case when trim(selector) = '' or trim(role) = '' or name is null or coalesce(trim(origin), '') = '' then 'INVALID_SUBJECT' when trim(purpose) = '' then 'EMPTY_PURPOSE' when ttl_ms is null or ttl_ms <= 0 then 'INVALID_TTL' else 'RECORDED' end end made from p),
r as (select confirmation, ms rms, id rid, selector s, role ro, name na, origin og, frame fr, node nd, purpose pu, ms + ttl_ms ends from q where made = 'RECORDED'),
j as (select q.*, r.*exclude (confirmation), rid is not null and (q.ms, q.id) > (rms, rid) and q.ms < ends + {KEEP_MS} held,
  case when q.ms >= ends then 'EXPIRED' when coalesce(trim(q.origin), '') = '' then 'ORIGIN_NOT_SUPPLIED' when q.origin <> og then 'DIFFERENT_ORIGIN' when q.frame <> fr then 'DIFFERENT_FRAME' when (q.node, q.selector, q.role, q.name) is distinct from (nd, s, ro, na) then 'DIFFERENT_TARGET' end cause
  from q left join r on r.confirmation = q.confirmation),
u as (select confirmation, min({{'ms': ms, 'id': id}}) first_use from j where held and (op = 'SPEND' or (op = 'MINT' and cause is null)) group by confirmation),
w as (select j.*, first_use is not null and {{'ms': ms, 'id': id}} > first_use gone from j left join u on u.confirmation = j.confirmation)
select confirmation, id, op, case when op = 'RECORD' then made when not held then 'NOT_RECORDED' when op = 'STATE' then case when gone then 'SPENT' when ms >= ends then 'EXPIRED' else 'LIVE' end
  when op = 'SPEND' then case when gone then 'ALREADY_SPENT' else 'SPENT' end when gone then 'ALREADY_SPENT' when cause is not null then cause when op = 'COVERS' then 'COVERS' else 'MINTED' end verdict,
  case when made = 'RECORDED' or held then coalesce(pu, purpose) end purpose from w"""  # noqa: S608


@query("human_confirmations", "T-08", _SQL)
def human_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every operation on a confirmation; the earlier half of the operations' time is one start of the query, the rest another."""
    ops = run_sql(spark, sf_dir, f"with {SPARK_E}, {OPERATIONS} select confirmation, id, ms, op, selector, role, name, origin, cast(frame as bigint) frame, cast(node as bigint) node, purpose, ttl_ms from p")
    ops = ops.withColumn("at", at_of(F.col("ms"))).select(*[c.split()[0] for c in OPS.split(", ")])
    root = f"{shared_dir(spark)}/confirmations-{uuid.uuid4().hex}"
    low, high, n = run_sql(spark, sf_dir, f"with {SPARK_E}, {OPERATIONS} select min(ms), max(ms), count(*) from o").first()
    half = (low + high) // 2 if low is not None else 0
    for part in (F.col("ms") < half, F.col("ms") >= half):
        ops.where(part).write.mode("append").parquet(f"{root}/in")
        run_to_end(confirmed_in_buckets(spark.readStream.schema(OPS).parquet(f"{root}/in"), KEEP_MS, n // BUCKET_ROWS + 1), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema("confirmation long, id long, op string, verdict string, purpose string").parquet(f"{root}/out")
