"""Queries on acting: freshness of claims, binding, the vault's log, plans against the live page, run states. Each has SQL of its own making."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.actions import CONFIRMED_NAMES, STATES, bind_decision, freshness, hit_agreement, holds_now, transition
from quillon.functions.binding import bound
from quillon.plans.events import DUCK_E, SPARK_E
from quillon.plans.records import LINES
from quillon.registry import query, run_sql, table

#: The current page: nodes from parts, boxes in CSS pixels.
NODES = """nodes as (select p_partkey node, case p_size % 4 when 0 then 'button' when 1 then 'link' when 2 then 'textbox' else 'tab' end role, p_name name, p_size % 9 <> 0 enabled, case p_size % 8 when 0 then 'UNOBSERVED' when 1 then 'CLIPPED' else 'OBSERVED' end evidence,
  case when p_size % 23 = 0 then 'f1' else 'f0' end frame, cast((p_partkey * 37) % 400 as double) x, cast((p_partkey * 53) % 300 as double) y, cast(30 + p_size as double) w, cast(20 + p_size % 15 as double) h from part)"""
#: Claims from lines: what an earlier reading said of a node, taken from the part of that line or, as pages change, of another.
CLAIMS = f"""{LINES}, claims as (select l.l_orderkey * 100 + l.l_linenumber id, case when l_tax > 0.078 then 'type' when l_shipmode = 'AIR' then 'scroll' when l_shipmode = 'RAIL' then 'focus' else 'click' end kind, l_shipmode <> 'AIR' or l_discount > 0.08 has_claim,
  l.l_partkey + case when l_quantity = 13 then 100000000 else 0 end node, case when l_quantity = 17 then 'f1' else 'f0' end frame, case when l_quantity = 19 then 'button' else case p.p_size % 4 when 0 then 'button' when 1 then 'link' when 2 then 'textbox' else 'tab' end end role,
  case when l_quantity = 23 then '' when l_quantity = 29 then 'x' || p.p_name else p.p_name end name, cast((l.l_partkey * 37) % 400 + l.l_linenumber * 0.4 as double) x, cast((l.l_partkey * 53) % 300 as double) y, cast(30 + p.p_size + case when l_quantity > 45 then 14 else 0 end as double) w,
  cast(case when l_quantity = 31 then 0 else 20 + p.p_size % 15 end as double) h, l_returnflag <> 'R' has_point, cast((l.l_partkey * 37) % 400 + l_quantity as double) px, cast((l.l_partkey * 53) % 300 + 8 as double) py, l_quantity <> 37 watching, case when l_quantity = 41 then 2 else 1 end seq,
  cast(l_quantity * 60 as double) answer_ms, case when l_quantity < 4 then null when l_quantity < 10 then l.l_partkey + 1 else l.l_partkey end topmost from li l join part p on p.p_partkey = l.l_partkey)"""

_TIER = "|".join(CONFIRMED_NAMES)


@query("claim_freshness", "T-05 T-06 E-15 F-19 F-11", f"""with {NODES}, {CLAIMS}, j as (select c.*, n.node found, n.role nrole, n.name nname, n.enabled, n.evidence, n.frame nframe, n.x nx, n.y ny, n.w nw, n.h nh from claims c left join nodes n on n.node = c.node),
k as (select *, greatest(least(x + w, nx + nw) - greatest(x, nx), 0) * greatest(least(y + h, ny + nh) - greatest(y, ny), 0) i from j)
select id, case when kind = 'type' then 'ACTION_NOT_ALLOWLISTED' when kind = 'scroll' then case when has_claim then 'MALFORMED_CLAIM' else 'ALLOW' end when not watching or seq <> 1 then 'OBSERVATION_STALE' when h <= 0 or name = '' then 'MALFORMED_CLAIM' when frame <> 'f0' then 'FRAME_MISMATCH'
  when found is null then 'TARGET_MISSING' when nrole <> role then 'ROLE_CHANGED' when nname <> name then 'NAME_CHANGED' when not enabled then 'NOT_ENABLED' when evidence = 'UNOBSERVED' then 'NOT_VISIBLE' when nframe <> 'f0' then 'FRAME_MISMATCH'
  when sqrt((x + w / 2 - nx - nw / 2) ** 2 + (y + h / 2 - ny - nh / 2) ** 2) > 2 then 'MOVED_BEYOND_TOLERANCE' when i / (w * h + nw * nh - i) < 0.8 then 'GEOMETRY_MISMATCH' when has_point and not (px between nx and nx + nw and py between ny and ny + nh) then 'POINT_OUTSIDE_TARGET' else 'ALLOW' end reason,
  case when topmost is null or answer_ms > 2000 then 'UNKNOWN' when topmost = node then 'MATCH' else 'MISMATCH' end hit, case when role = 'link' or regexp_matches(lower(name), '{_TIER}') then 'CONFIRM_REQUIRED' else 'ROUTINE' end tier,
  case kind when 'click' then case when coalesce(enabled, false) = true then 'HOLDS' else 'DOES_NOT_HOLD' end when 'focus' then case when not has_point then 'UNKNOWN' when topmost = node then 'HOLDS' else 'DOES_NOT_HOLD' end else case when coalesce(nname = name, false) then 'HOLDS' else 'DOES_NOT_HOLD' end end holds from k""")  # fmt: skip
def claim_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each proposed action may go ahead on the page as it is now, whether the page agrees on the target, and if what it is for holds already."""
    c = run_sql(spark, sf_dir, f"with {CLAIMS} select * from claims")
    n = run_sql(spark, sf_dir, f"with {NODES} select * from nodes").select(F.col("node").alias("n"), F.struct("frame", "role", "name", "enabled", "evidence", F.struct("x", "y", "w", "h").alias("box")).alias("now"))
    d = c.join(n, F.col("node") == F.col("n"), "left")
    claim = F.when(F.col("has_claim"), F.struct("frame", "role", "name", F.struct("x", "y", "w", "h").alias("box"), "seq"))
    point = F.when(F.col("has_point"), F.struct(F.col("px").alias("x"), F.col("py").alias("y")))
    graph = F.struct(F.lit("f0").alias("frame"), F.lit(1).alias("seq"), F.col("watching"))
    kind = F.when(F.col("kind") == "click", "TARGET_ENABLED").when(F.col("kind") == "focus", "FOCUS_ON_TARGET").otherwise("TARGET_NAME")
    holds = holds_now(kind, F.when(kind == "TARGET_ENABLED", "true").otherwise(F.col("name")), F.col("now.enabled"), F.col("now.name"), F.col("node").cast("string"), F.col("has_point"), F.col("topmost").cast("string"))
    tier = F.when((F.col("role") == "link") | F.col("name").rlike("(?i)" + _TIER), "CONFIRM_REQUIRED").otherwise("ROUTINE")
    # the rules read a row's claim through one variable: written out in the code of the join, they make a method that is too long to be compiled
    row = F.struct("kind", claim.alias("claim"), point.alias("point"), graph.alias("graph"), "now")
    reason = bound(row, lambda r: freshness(r["kind"], r["claim"], r["point"], r["graph"], r["now"]))
    return d.select("id", reason.alias("reason"), hit_agreement(F.col("node"), F.col("topmost"), F.col("answer_ms")).alias("hit"), tier.alias("tier"), holds.alias("holds"))


#: What steps name: fields from parts, references from suppliers, grants from nations and from lines shipped later.
BINDING = f"""steps as (select row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) + l_orderkey * 100 id, l_partkey, l_suppkey, l_shipdate now_, l_quantity q, l_linestatus ls from lineitem),
fields as (select p_partkey field, case p_size % 7 when 0 then 'OTP' when 1 then 'UNKNOWN' when 2 then 'FREE_TEXT' when 3 then 'AADHAAR' when 4 then 'DOB' when 5 then 'PHONE' else 'NAME' end accepts, 'o' || cast(p_partkey % 2 as string) field_origin from part where p_partkey % 19 <> 0),
refs as (select s_suppkey k, '<PII:' || case s_nationkey % 4 when 0 then 'AADHAAR' when 1 then 'DOB' when 2 then 'PHONE' else 'NAME' end || ':' || cast(s_suppkey + 1 as string) || '>' token, case s_nationkey % 4 when 0 then 'AADHAAR' when 1 then 'DOB' when 2 then 'PHONE' else 'NAME' end cls, 'o' || cast(s_suppkey % 2 as string) origin, s_acctbal < -500 consumed from supplier where s_suppkey % 13 <> 0),
class_grants as (select distinct case n_nationkey % 5 when 0 then 'AADHAAR' when 1 then 'DOB' when 2 then 'PHONE' when 3 then 'NAME' else 'OTP' end cls, 'o' || cast(n_regionkey % 2 as string) origin from nation where n_nationkey < 8)"""


@query("bind_steps", "P-06 J-08 P-08 W-09", f"""with {BINDING}, j as (select s.*, f.accepts, f.field_origin, r.token, r.cls, r.origin, r.consumed, exists (select 1 from class_grants g where g.cls = r.cls and g.origin = f.field_origin) class_grant,
  exists (select 1 from lineitem u where u.l_suppkey = s.l_suppkey and u.l_partkey = s.l_partkey and u.l_linestatus = 'O' and s.now_ < u.l_shipdate) use_grant from steps s left join fields f on f.field = s.l_partkey left join refs r on r.k = s.l_suppkey),
d as (select *, case when q = 50 then 'REFUSE:VAULT_DESTROYED' when q = 49 then 'REFUSE:SESSION_MISMATCH' when q = 48 then 'REFUSE:STALE_VIEW' when q = 47 then 'REFUSE:STALE_BINDING' when accepts is null then 'REFUSE:UNKNOWN_TARGET' when q = 46 or cls is null then 'REFUSE:UNKNOWN_TOKEN' when accepts = 'OTP' then 'NEEDS_USER:CRITICAL_FIELD'
  when accepts in ('UNKNOWN', 'FREE_TEXT') then 'NEEDS_USER:AMBIGUOUS_FIELD' when accepts <> cls then 'REFUSE:CLASS_MISMATCH' when field_origin <> origin then 'REFUSE:ORIGIN_MISMATCH' when consumed then 'REFUSE:CONSUMED' when not class_grant then 'NEEDS_USER:CLASS_ORIGIN_GRANT_REQUIRED'
  when cls in ('AADHAAR', 'DOB') and not use_grant then 'NEEDS_HUMAN_GRANT' else 'BIND_OK' end decision from j)
select id, decision, case when decision <> 'BIND_OK' then '-' when id = min(id) filter (decision = 'BIND_OK') over (partition by token) then 'REVEALED' else 'CONSUMED' end rehydrated from d""")  # fmt: skip
def bind_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on each step from what it names, and which step of a reference gets its value: the first one bound, no other."""
    t = {n: run_sql(spark, sf_dir, f"with {BINDING} select * from {n}") for n in ("steps", "fields", "refs", "class_grants")}
    lines = t["steps"].where("ls = 'O'").groupBy(F.col("l_suppkey").alias("gs"), F.col("l_partkey").alias("gp")).agg(F.max("now_").alias("expires"))
    d = t["steps"].join(t["fields"], F.col("l_partkey") == F.col("field"), "left").join(t["refs"], F.col("l_suppkey") == F.col("k"), "left")
    d = d.join(t["class_grants"].select(F.col("cls").alias("gc"), F.col("origin").alias("go"), F.lit(True).alias("class_grant")), (F.col("cls") == F.col("gc")) & (F.col("field_origin") == F.col("go")), "left")
    d = d.join(lines, (F.col("l_suppkey") == F.col("gs")) & (F.col("l_partkey") == F.col("gp")), "left")
    q = F.col("q")
    s = F.struct(
        (q == 50).alias("destroyed"), F.when(q == 49, "other").otherwise("s").alias("vault_session"), F.lit("s").alias("session"), F.when(q == 48, "v0").otherwise("v1").alias("view"), F.lit("v1").alias("live_view"), F.when(q == 47, "d0").otherwise("d1").alias("document"),
        F.lit("d1").alias("live_document"), "accepts", "field_origin", F.when(q == 46, "PII:1").otherwise(F.coalesce("token", F.lit("-"))).alias("ref"), "cls", "origin", "consumed", F.coalesce("class_grant", F.lit(False)).alias("class_grant"), F.coalesce(F.col("now_") < F.col("expires"), F.lit(False)).alias("use_grant"),
    )
    d = d.withColumn("s", s).withColumn("decision", bind_decision(F.col("s")))
    first = d.where("decision = 'BIND_OK'").groupBy(F.col("token").alias("ft")).agg(F.min("id").alias("first"))
    d = d.join(first, F.col("token") == F.col("ft"), "left")
    return d.select("id", "decision", F.when(F.col("decision") != "BIND_OK", "-").when(F.col("id") == F.col("first"), "REVEALED").otherwise("CONSUMED").alias("rehydrated"))


#: A log of operations on vaults: one per order, in the order of its lines.
OPERATIONS = f"""{LINES}, ops as (select l_orderkey vault, l_linenumber n, case l_shipmode when 'MAIL' then 'CONSUME' when 'SHIP' then 'DESCRIBE' when 'AIR' then 'ASK' else 'STORE' end op, case when l_shipmode = 'RAIL' and l_quantity > 44 then true else false end destroys, l_partkey % 3 ref,
  case l_partkey % 6 when 0 then 'OTP' when 1 then 'AADHAAR' when 2 then 'PHONE' when 3 then 'DOB' when 4 then 'NAME' else 'UNKNOWN' end cls, case when l_discount < 0.005 then '' else 'v' || cast(l_partkey % 4 as string) end value from li)"""


@query("vault_log", "P-04 P-05 P-08", f"""with {OPERATIONS}, o as (select vault, n, case when destroys then 'DESTROY' else op end op, ref, cls, value from ops),
s as (select *, exists (select 1 from o d where d.vault = o.vault and d.n < o.n and d.op = 'DESTROY') gone from o),
k as (select *, op = 'STORE' and not gone and value <> '' and cls not in ('OTP', 'UNKNOWN') stored from s),
f as (select k.*, (select count(*) from k e where e.vault = k.vault and e.n < k.n and e.ref = k.ref and e.stored) held, (select count(*) from k e where e.vault = k.vault and e.n < k.n and e.ref = k.ref and e.op = 'CONSUME' and exists (select 1 from k b where b.vault = e.vault and b.n < e.n and b.ref = e.ref and b.stored)) uses,
  (select count(*) from k e where e.vault = k.vault and e.n < k.n and e.op in ('STORE', 'DESCRIBE') and e.value = k.value) learned from k)
select vault, n, op, case when op = 'DESTROY' then 'OK' when gone then 'VAULT_DESTROYED' when op = 'STORE' then case when value = '' then 'EMPTY_VALUE' when cls = 'OTP' then 'CRITICAL_NOT_STORED' when cls = 'UNKNOWN' then 'UNKNOWN_NOT_STORED' else 'OK' end
  when op = 'ASK' then case when learned > 0 then 'ANSWERED' else 'NOT_LEARNED' end when held = 0 then 'UNKNOWN_REFERENCE' when op = 'DESCRIBE' then case when uses > 0 then 'SPENT' else 'UNSPENT' end when uses > 0 then 'CONSUMED' else 'OK' end outcome from f""")  # fmt: skip
def vault_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every operation on a vault came to. Lines are dealt by vault and sorted once; one pass numbers and judges them, and holds what a vault was told, not its rows."""
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select(*keys, "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").sortWithinPartitions(*keys)
    o = spark.sql(f"with {_UNNUMBERED} select vault, case when destroys then 'DESTROY' else op end op, ref, cls, value from ops", lines=lines)
    return o.mapInArrow(judged_operations, f"vault {o.schema['vault'].dataType.simpleString()}, n long, op string, outcome string")


#: OPERATIONS of lines that come in order, which are numbered as they come.
_UNNUMBERED = re.sub(r"row_number\(\) over \(.*?\)", "0", OPERATIONS).replace("from lineitem", "from {lines}")


def judged_operations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vault, n, op and outcome of operations (vault, op, ref, cls, value) that come by vault and in order. A null vault, reference or value is like no other."""
    own, n, gone, told, held, used = None, 0, False, set(), set(), set()
    for b in batches:
        numbers, outcomes = [], []
        for vault, op, ref, cls, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if vault != own:
                own, n, gone, told, held, used = vault, 0, False, set(), set(), set()
            n += 1
            if op == "DESTROY":
                outcome = "OK"
            elif gone:
                outcome = "VAULT_DESTROYED"
            elif op == "STORE":
                outcome = "EMPTY_VALUE" if value == "" else "CRITICAL_NOT_STORED" if cls == "OTP" else "UNKNOWN_NOT_STORED" if cls == "UNKNOWN" else "OK"
            elif op == "ASK":
                outcome = "ANSWERED" if value in told else "NOT_LEARNED"
            elif ref not in held:
                outcome = "UNKNOWN_REFERENCE"
            elif op == "DESCRIBE":
                outcome = "SPENT" if ref in used else "UNSPENT"
            else:
                outcome = "CONSUMED" if ref in used else "OK"
            numbers.append(n)
            outcomes.append(outcome)
            if vault is None:
                continue
            if op == "CONSUME" and ref in held:
                used.add(ref)
            if op in ("STORE", "DESCRIBE") and value is not None:
                told.add(value)
            if op == "STORE" and outcome == "OK" and value and ref is not None:
                held.add(ref)
            gone = gone or op == "DESTROY"
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.int64()), b.column(1), pa.array(outcomes, pa.string())], ["vault", "n", "op", "outcome"])


PLANS = f"""{LINES}, ps as (select l_orderkey plan, l_linenumber n, case when l_shipmode in ('MAIL', 'TRUCK') then 'insert' when l_shipmode = 'SHIP' then 'done' else 'click' end op, l_partkey % 11 target, case when l_tax < 0.02 then '98765' || cast(10000 + l_partkey % 90000 as string) when l_tax < 0.04 then 'plain text' end literal,
  '<PII:PHONE:' || cast(1 + l_discount * 100 % 2 as bigint) || '>' ref from li),
live as (select n_nationkey target, n_nationkey % 4 <> 1 actionable, n_nationkey % 3 = 0 redacted, case when n_nationkey % 2 = 0 then '<PII:PHONE:1>' end grounded from nation where n_nationkey <> 7),
heads as (select o_orderkey plan, o_orderstatus st, o_custkey % 31 c from orders)"""


@query("plan_checks", "F-16 W-10 J-09 W-07", f"""with {PLANS.replace("cast(1 + l_discount * 100 % 2 as bigint)", "cast(1 + cast(round(l_discount * 100) as bigint) % 2 as string)")}, j as (select p.*, v.target is not null known, v.actionable, v.redacted, v.grounded,
  (select count(*) from ps e where e.plan = p.plan and e.n < p.n and e.op = p.op and e.target = p.target and e.op <> 'done') dup, (select count(*) from ps e where e.plan = p.plan and e.n < p.n and e.op = 'click') clicks, (select count(*) from ps e where e.plan = p.plan and e.n < p.n and e.op = 'insert') ins,
  (select count(*) from ps e where e.plan = p.plan and e.op = 'insert') all_ins from ps p left join live v on v.target = p.target),
c as (select plan, n, op, case when op = 'done' then null when not known then 'UNKNOWN_TARGET' when dup > 0 then 'DUPLICATE_TARGET' when op = 'click' then case when clicks > 0 then 'MORE_THAN_ONE_CLICK' when not actionable then 'TARGET_NOT_ACTIONABLE' when ins = 0 and all_ins > 0 then 'CLICK_BEFORE_INSERT' end
  when literal is not null then case when redacted or regexp_full_match(literal, '[6-9][0-9]{{9}}') then 'LITERAL_REFUSED' end when grounded is null then 'NOT_AN_EMPTY_FIELD' when grounded <> ref then 'NOT_THE_GROUNDED_REFERENCE' end cause from j),
f as (select plan, min(n) filter (cause is not null) at_step, arg_min(cause, n) filter (cause is not null) cause, count(*) n_steps, count(*) filter (op = 'click') clicks, count(*) filter (op = 'done') dones from c group by plan)
select f.plan, case when h.c = 1 then 'REQUEST_MISMATCH' when h.c = 2 then 'SESSION_MISMATCH' when h.c = 3 then 'ORIGIN_MISMATCH' when h.st = 'P' then 'STALE_VIEW' when f.cause is not null then f.cause when n_steps = 1 and dones = 1 then 'DONE' when clicks = 0 then 'NO_EXECUTABLE_STEP' else 'OK' end verdict,
  case when h.c in (1, 2, 3) or h.st = 'P' then 0 else coalesce(f.at_step, 0) end at_step from f join heads h on h.plan = f.plan""")  # fmt: skip
def plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing wrong with a plan against the live page: whose plan it is, then its steps in order, then whether it does anything."""
    sql = PLANS.replace("cast(1 + l_discount * 100 % 2 as bigint)", "cast(1 + cast(round(l_discount * 100) as bigint) % 2 as string)")
    t = {n: run_sql(spark, sf_dir, f"with {sql} select * from {n}") for n in ("ps", "live", "heads")}
    p = t["ps"].join(F.broadcast(t["live"]).withColumnRenamed("target", "known"), F.col("target") == F.col("known"), "left")  # as many rows as there are nations
    before = Window.partitionBy("plan").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("plan", "op", "target").orderBy("n")

    def count(op: str, w) -> Column:
        return F.coalesce(F.sum((F.col("op") == op).cast("int")).over(w), F.lit(0))

    click = F.when(count("click", before) > 0, "MORE_THAN_ONE_CLICK").when(~F.col("actionable"), "TARGET_NOT_ACTIONABLE").when((count("insert", before) == 0) & (count("insert", Window.partitionBy("plan")) > 0), "CLICK_BEFORE_INSERT")
    literal = F.when(F.col("redacted") | F.col("literal").rlike("^[6-9][0-9]{9}$"), "LITERAL_REFUSED")
    reference = F.when(F.col("grounded").isNull(), "NOT_AN_EMPTY_FIELD").when(F.col("grounded") != F.col("ref"), "NOT_THE_GROUNDED_REFERENCE")
    cause = F.when(F.col("op") == "done", None).when(F.col("known").isNull(), "UNKNOWN_TARGET").when(F.row_number().over(same) > 1, "DUPLICATE_TARGET").when(F.col("op") == "click", click).when(F.col("literal").isNotNull(), literal).otherwise(reference)
    g = p.withColumn("cause", cause).groupBy("plan").agg(F.min(F.when(F.col("cause").isNotNull(), F.struct("n", "cause"))).alias("bad"), F.count("*").alias("steps"), F.count_if(F.col("op") == "click").alias("clicks"), F.count_if(F.col("op") == "done").alias("dones"))
    g = g.join(t["heads"], "plan")
    head = F.when(F.col("c") == 1, "REQUEST_MISMATCH").when(F.col("c") == 2, "SESSION_MISMATCH").when(F.col("c") == 3, "ORIGIN_MISMATCH").when(F.col("st") == "P", "STALE_VIEW")
    tail = F.when((F.col("steps") == 1) & (F.col("dones") == 1), "DONE").when(F.col("clicks") == 0, "NO_EXECUTABLE_STEP").otherwise("OK")
    return g.select("plan", F.coalesce(head, "bad.cause", tail).alias("verdict"), F.when(head.isNotNull(), 0).otherwise(F.coalesce("bad.n", F.lit(0))).cast("long").alias("at_step"))


#: Logs of runs from events: the next state in order, but errors refuse, slow ones ask, and some logs go on after their end or leave states out.
LOG = f"""lg as (select event_id id, user_id, ms, k, cast(floor(k / 14) as bigint) run, case when event_type = 'error' and value < 30 then 'REFUSED' else case k % 14 when 0 then 'IDLE' when 1 then 'OBSERVE' when 2 then 'SANITIZE' when 3 then 'VERIFY_PAYLOAD' when 4 then case when value > 20 then 'AWAIT_CLARIFICATION' else 'SEND' end
  when 5 then 'SEND' when 6 then 'VALIDATE_PLAN' when 7 then case when value < 4 then 'DONE' else 'AWAIT_GRANT' end when 8 then 'REHYDRATE' when 9 then 'ACT' when 10 then 'VERIFY_RESULT' else 'DONE' end end state
  from (select event_id, user_id, event_type, value, cast(floor(epoch_us / 1000) as bigint) ms, row_number() over (partition by user_id order by epoch_us, event_id) - 1 k from e) t)"""
_STEPS = ("OBSERVE", "SANITIZE", "VERIFY_PAYLOAD", "SEND", "VALIDATE_PLAN", "ACT", "VERIFY_RESULT")


@query("run_transitions", "T-11 W-06", f"""with {DUCK_E}, {LOG}, ok(a, b) as (values ('IDLE', 'OBSERVE'), ('OBSERVE', 'SANITIZE'), ('SANITIZE', 'VERIFY_PAYLOAD'), ('VERIFY_PAYLOAD', 'AWAIT_CLARIFICATION'), ('VERIFY_PAYLOAD', 'SEND'), ('AWAIT_CLARIFICATION', 'SEND'), ('SEND', 'VALIDATE_PLAN'), ('VALIDATE_PLAN', 'DONE'),
  ('VALIDATE_PLAN', 'AWAIT_GRANT'), ('AWAIT_GRANT', 'REHYDRATE'), ('REHYDRATE', 'ACT'), ('ACT', 'VERIFY_RESULT'), ('VERIFY_RESULT', 'DONE')),
p as (select a.*, b.state prev, b.ms before from lg a left join lg b on b.user_id = a.user_id and b.run = a.run and b.k = a.k - 1)
select coalesce(prev, '-') from_state, state to_state, case when prev is null then case when state = 'IDLE' then 'START' else 'NOT_A_TRANSITION' end when prev in ('DONE', 'REFUSED') then 'AFTER_TERMINAL' when state = 'REFUSED' or ok.a is not null then 'OK' else 'NOT_A_TRANSITION' end verdict, count(*) n, coalesce(max(ms - before), 0)::bigint worst_ms
from p left join ok on ok.a = p.prev and ok.b = p.state group by all""")  # fmt: skip
def run_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of state in the logs of runs, whether the state machine knows it, and how long the longest took."""
    log = run_sql(spark, sf_dir, f"with {SPARK_E}, {LOG} select * from lg")
    w = Window.partitionBy("user_id", "run").orderBy("k")
    d = log.withColumn("prev", F.lag("state").over(w)).withColumn("took", F.col("ms") - F.lag("ms").over(w))
    return d.groupBy(F.coalesce("prev", F.lit("-")).alias("from_state"), F.col("state").alias("to_state"), transition(F.col("prev"), F.col("state")).alias("verdict")).agg(F.count("*").alias("n"), F.coalesce(F.max("took"), F.lit(0)).alias("worst_ms"))


@query("run_steps", "E-06", f"""with {DUCK_E}, {LOG}, s(step, rank) as (values {', '.join(f"('{s}', {STATES.index(s)})" for s in _STEPS)}), rk(state, rank) as (values {', '.join(f"('{s}', {i})" for i, s in enumerate(STATES))}),
x as (select l.user_id, l.run, l.k, l.state, r.rank from lg l join rk r on r.state = l.state where not exists (select 1 from lg e where e.user_id = l.user_id and e.run = l.run and e.k < l.k and e.state in ('DONE', 'REFUSED'))),
t as (select user_id, run, arg_max(state, k) last, max(rank) filter (state <> 'REFUSED') far from x group by user_id, run)
select s.step, case when last = 'DONE' or s.rank < far then 'done' when last = 'REFUSED' and s.rank = far then 'blocked' when s.rank = far then 'current' when last = 'REFUSED' then 'blocked' else 'pending' end status, count(*) n from t, s group by all""")  # fmt: skip
def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far runs came, by step: done, current, pending, or blocked by a refusal. What a log says after its end does not count."""
    log = run_sql(spark, sf_dir, f"with {SPARK_E}, {LOG} select * from lg")
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state")) - 1
    end = F.min(F.when(F.col("state").isin("DONE", "REFUSED"), F.col("k"))).over(Window.partitionBy("user_id", "run"))
    live = log.withColumn("rank", rank).withColumn("end", end).where("end is null or k <= end")
    t = live.groupBy("user_id", "run").agg(F.max_by("state", "k").alias("last"), F.max(F.when(F.col("state") != "REFUSED", F.col("rank"))).alias("far"))
    t = t.select("last", "far", F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.lit(STATES.index(s)).alias("at")) for s in _STEPS])).alias("s"))
    refused = F.col("last") == "REFUSED"
    status = F.when((F.col("last") == "DONE") | (F.col("s.at") < F.col("far")), "done").when(refused, "blocked").when(F.col("s.at") == F.col("far"), "current").otherwise("pending")
    return t.groupBy(F.col("s.step").alias("step"), status.alias("status")).agg(F.count("*").alias("n"))
