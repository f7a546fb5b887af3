"""Queries on handoffs, answers, trees, planners, schedules, baselines, confirmations and what follows an act."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.geometry import Box
from quillon.functions.records import answer_cause, kind_of, text_at
from quillon.operators import scheduling
from quillon.plans.actions import CLAIMS, NODES
from quillon.plans.boxes import BOXES, at_least_half
from quillon.plans.detection import gt
from quillon.plans.events import DUCK_E, SPARK_E
from quillon.plans.records import LINES
from quillon.registry import query, run_sql, table

#: Drafts of handoffs from orders, with the defects a draft can have; tokens are of the order's own vault.
DRAFTS = """dr as (select o_orderkey id, o_custkey c, o_orderstatus st, o_orderkey % 29 d, 's' || cast(o_custkey as string) session_, 'r' || cast(o_orderkey as string) request, 'https://h' || cast(o_custkey % 3 as string) || '.example' origin, '98' || lpad(cast(o_custkey as string), 8, '0') stored from orders),
dj as (select *, '{"manifestVersion":"' || case d when 1 then '1.0' else '1.1' end || '","capture":{"origin":"' || case d when 2 then '' when 3 then 'https://other.example' else origin end || '","w":' || case d when 4 then '"wide"' else '800' end || ',"h":600,"dpr":1.5},"goal":"' || case d when 5 then '  ' else 'Fill in my phone' end ||
  '","elements":[{"id":"#a","role":"textbox","name":"' || case d when 6 then stored else 'Phone' end || '"}],"redactions":[{"token":"<PII:' || case d when 7 then 'OTP' else 'PHONE' end || ':' || case d when 8 then '9' else '1' end || '>"}' || case d when 9 then ',{"token":"<PII:PHONE:1>"}' when 10 then ',{"token":""}' else ',{"token":"<PII:NAME:2>"}' end ||
  '],"request":{"requestId":"' || case d when 11 then 'r0' else request end || '","sessionId":' || case d when 12 then '"s0"' when 13 then 'null' else '"' || session_ || '"' end || '}}' j from dr)"""


@query("handoff_verification", "F-12 F-13 P-13 P-02", f"""with {DRAFTS}, k as (select *, list_filter(list_transform(json_extract(j, '$.redactions[*]'), lambda r: json_extract_string(r, '$.token')), lambda t: t <> '') toks from dj)
select id, case when json_extract_string(j, '$.manifestVersion') <> '1.1' or json_extract_string(j, '$.capture.origin') = '' or json_type(j, '$.capture.w') not in ('UBIGINT', 'BIGINT', 'DOUBLE') or trim(json_extract_string(j, '$.goal')) = '' or json_type(j, '$.request.sessionId') <> 'VARCHAR' then 'MALFORMED_STRUCTURE'
  when json_extract_string(j, '$.request.requestId') <> request then 'REQUEST_IDENTITY_MISMATCH' when json_extract_string(j, '$.request.sessionId') <> session_ then 'SESSION_IDENTITY_MISMATCH' when json_extract_string(j, '$.capture.origin') <> origin then 'ORIGIN_MISMATCH' when st = 'P' then 'VAULT_DESTROYED'
  when len(list_filter(toks, lambda t: t not in ('<PII:PHONE:1>', '<PII:NAME:2>', '<PII:OTP:1>'))) > 0 then 'UNKNOWN_TOKEN' when len(list_distinct(toks)) < len(toks) then 'DUPLICATE_TOKEN' when len(list_filter(toks, lambda t: t like '<PII:OTP:%')) > 0 then 'NON_TOKENISABLE_CLASS' when contains(j, stored) then 'VAULT_VALUE_IN_HANDOFF' else 'VERIFIED' end cause,
  case when st = 'P' then 'STOP' else 'STRUCTURE_ONLY' end mode, sha256(j) body_sha256 from k""")  # fmt: skip
def handoff_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a draft may become a handoff: its structure, whose it is, its tokens, and that nothing stored is in it."""
    d = run_sql(spark, sf_dir, f"with {DRAFTS} select * from dj").withColumn("v", F.try_parse_json("j"))
    v = F.col("v")
    tokens = F.filter(F.transform(F.from_json(F.get_json_object("j", "$.redactions"), "array<struct<token:string>>"), lambda r: r["token"]), lambda t: t != "")
    held = F.array(*map(F.lit, ("<PII:PHONE:1>", "<PII:NAME:2>", "<PII:OTP:1>")))
    sound = (text_at(v, "$.manifestVersion") == "1.1") & (text_at(v, "$.capture.origin") != "") & (kind_of(v, "$.capture.w") == "NUMBER") & (F.trim(text_at(v, "$.goal")) != "") & text_at(v, "$.request.sessionId").isNotNull()
    cause = (
        F.when(~F.coalesce(sound, F.lit(False)), "MALFORMED_STRUCTURE").when(text_at(v, "$.request.requestId") != F.col("request"), "REQUEST_IDENTITY_MISMATCH").when(text_at(v, "$.request.sessionId") != F.col("session_"), "SESSION_IDENTITY_MISMATCH")
        .when(text_at(v, "$.capture.origin") != F.col("origin"), "ORIGIN_MISMATCH").when(F.col("st") == "P", "VAULT_DESTROYED").when(F.size(F.array_except(tokens, held)) > 0, "UNKNOWN_TOKEN")
        .when(F.size(F.array_distinct(tokens)) < F.size(tokens), "DUPLICATE_TOKEN").when(F.exists(tokens, lambda t: t.startswith("<PII:OTP:")), "NON_TOKENISABLE_CLASS").when(F.contains("j", F.col("stored")), "VAULT_VALUE_IN_HANDOFF").otherwise("VERIFIED")
    )
    return d.select("id", cause.alias("cause"), F.when(F.col("st") == "P", "STOP").otherwise("STRUCTURE_ONLY").alias("mode"), F.sha2("j", 256).alias("body_sha256"))


_BOUND = (("clarificationId", "NOT_THIS_CLARIFICATION"), ("sessionId", "SESSION_MISMATCH"), ("origin", "ORIGIN_MISMATCH"), ("viewId", "STALE_VIEW"), ("documentId", "DOCUMENT_CHANGED"), ("target", "TARGET_MISMATCH"), ("candidateSetId", "CANDIDATE_SET_CHANGED"))
ASKED = """ak as (select o_orderkey id, 'q' || cast(o_orderkey as string) clarification_id, 's' || cast(o_custkey as string) session_id, 'https://h' || cast(o_custkey % 5 as string) || '.example' origin, 'v' || cast(o_orderkey % 9 as string) view_id, 'd' || cast(o_orderkey % 100 as string) document_id, '#f' || cast(o_orderkey % 7 as string) target,
  'k' || cast(o_orderkey % 4 as string) candidate_set_id, 'n' || cast(o_custkey % 4 as string) candidate, o_totalprice < 30000 late, o_orderkey % 41 d from orders),
aj as (select *, case d when 1 then '5' when 2 then '{"kind":"DECLINED","clarificationId":"' || clarification_id || '"}' when 3 then '{"kind":"DECLINED","clarificationId":"q0"}' when 4 then '{"kind":"DECLINED"}' when 5 then '{"kind":"CHOSEN"}'
  else '{"kind":"CHOSEN","clarificationId":"' || case d when 6 then 'q0' else clarification_id end || '","sessionId":"' || case d when 7 then 's' else session_id end || '","origin":"' || case d when 8 then 'https://x.example' else origin end || '","viewId":"' || case d when 9 then 'v' else view_id end ||
   '","documentId":"' || case d when 10 then 'd' else document_id end || '","target":"' || case d when 11 then '#x' else target end || '","candidateSetId":"' || case d when 12 then 'k' else candidate_set_id end || '","candidateId":"' || candidate || '"' || case d when 13 then ',"x":"y"' else '' end || '}' end j from ak)"""


@query("clarification_answers", "P-15", f"""with {ASKED}, k as (select *, coalesce(json_type(j), '') t, case when json_type(j) = 'OBJECT' then list_sort(json_keys(j)) else [] end ks, json_extract_string(j, '$.kind') kind from aj)
select id, case when t <> 'OBJECT' then 'MALFORMED_ANSWER' when kind = 'DECLINED' and ks <> ['clarificationId', 'kind'] then 'MALFORMED_ANSWER' when kind = 'DECLINED' and json_extract_string(j, '$.clarificationId') <> clarification_id then 'NOT_THIS_CLARIFICATION' when kind = 'DECLINED' then 'CLARIFICATION_DECLINED'
  when kind <> 'CHOSEN' or ks <> ['candidateId', 'candidateSetId', 'clarificationId', 'documentId', 'kind', 'origin', 'sessionId', 'target', 'viewId'] then 'MALFORMED_ANSWER' when json_extract_string(j, '$.clarificationId') <> clarification_id then 'NOT_THIS_CLARIFICATION' when json_extract_string(j, '$.sessionId') <> session_id then 'SESSION_MISMATCH'
  when json_extract_string(j, '$.origin') <> origin then 'ORIGIN_MISMATCH' when json_extract_string(j, '$.viewId') <> view_id then 'STALE_VIEW' when json_extract_string(j, '$.documentId') <> document_id then 'DOCUMENT_CHANGED' when json_extract_string(j, '$.target') <> target then 'TARGET_MISMATCH' when json_extract_string(j, '$.candidateSetId') <> candidate_set_id then 'CANDIDATE_SET_CHANGED'
  when late then 'CLARIFICATION_EXPIRED' when candidate not in ('n0', 'n1', 'n2') then 'UNKNOWN_CANDIDATE' else 'OK' end cause from k""")  # fmt: skip
def clarification_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer chooses one of the candidates it was asked about, in time and on the page as it was."""
    d = run_sql(spark, sf_dir, f"with {ASKED} select * from aj")
    columns = {"clarificationId": "clarification_id", "sessionId": "session_id", "origin": "origin", "viewId": "view_id", "documentId": "document_id", "target": "target", "candidateSetId": "candidate_set_id"}
    asked = {k: F.col(c) for k, c in columns.items()}
    found = answer_cause(F.col("j"), asked, _BOUND, "CHOSEN", ("candidateId",), "DECLINED", "MALFORMED_ANSWER", "CLARIFICATION_DECLINED")
    chosen = text_at(F.try_parse_json("j"), "$.candidateId")
    late = F.when(found != "OK", found).when(F.col("late"), "CLARIFICATION_EXPIRED").when(~chosen.isin("n0", "n1", "n2"), "UNKNOWN_CANDIDATE").otherwise("OK")
    return d.select("id", late.alias("cause"))


@query("element_tree", "J-22 J-01", """with n as (select p_partkey id, case when p_partkey % 9 = 0 then null else p_partkey // 9 * 9 end parent, p_size from part), k as (select parent, string_agg(id::varchar, ',' order by p_size, id) kids, count(*) n from n where parent is not null group by parent)
select n.id, n.parent, coalesce(k.kids, '') kids, coalesce(k.n, 0) n_kids, p.id is null and n.parent is not null orphan from n left join k on k.parent = n.id left join n p on p.id = n.parent""")  # fmt: skip
def element_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their children in document order."""
    k9 = F.col("p_partkey")
    n = table(spark, sf_dir, "part").select(k9.alias("id"), F.when(k9 % 9 != 0, F.floor(k9 / 9) * 9).alias("parent"), "p_size")
    kids = n.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.array_sort(F.collect_list(F.struct("p_size", "id"))).alias("ks"))
    d = n.join(kids, F.col("id") == F.col("of"), "left").join(n.select(F.col("id").alias("pid")), F.col("parent") == F.col("pid"), "left")
    names = F.transform("ks", lambda k: k["id"].cast("string"))
    return d.select("id", "parent", F.coalesce(F.array_join(names, ","), F.lit("")).alias("kids"), F.coalesce(F.size("ks"), F.lit(0)).cast("long").alias("n_kids"), (F.col("pid").isNull() & F.col("parent").isNotNull()).alias("orphan"))


@query("bind_view", "J-24", f"""with {NODES}, f as (select s_suppkey field, case s_nationkey % 5 when 0 then 'PHONE' when 1 then 'NAME' when 2 then 'DOB' when 3 then 'AADHAAR' else 'OTP' end cls from supplier)
select n.node, coalesce(f.cls, 'UNKNOWN') accepts, '#n' || n.node || '|' || n.role || '|' || n.name fingerprint, 'o' || n.node % 3 origin from nodes n left join f on f.field = n.node where n.role in ('textbox', 'button')""")  # fmt: skip
def bind_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as fields of the live view: what each accepts, unknown where no field was read, and its fingerprint."""
    n = run_sql(spark, sf_dir, f"with {NODES} select * from nodes").where(F.col("role").isin("textbox", "button"))
    cls = F.element_at(F.array(*map(F.lit, ("PHONE", "NAME", "DOB", "AADHAAR", "OTP"))), (F.col("s_nationkey") % 5 + 1).cast("int"))
    f = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("field"), cls.alias("cls"))
    d = n.join(f, F.col("node") == F.col("field"), "left")
    return d.select("node", F.coalesce("cls", F.lit("UNKNOWN")).alias("accepts"), F.concat_ws("|", F.concat(F.lit("#n"), F.col("node").cast("string")), "role", "name").alias("fingerprint"), F.concat(F.lit("o"), (F.col("node") % 3).cast("string")).alias("origin"))


@query("worst_finding", "K-07 P-09", f"""with {LINES}, s as (select l_orderkey doc, l_linenumber n, case l_shipmode when 'MAIL' then 'VAULT_ECHO' when 'SHIP' then 'REDACTED_TARGET' when 'AIR' then 'PII_SHAPE' else 'NONE' end cause, case l_shipmode when 'MAIL' then 3 when 'SHIP' then 2 when 'AIR' then 1 else 0 end severity from li)
select doc, cause, severity::int severity, n::bigint n from (select *, row_number() over (partition by doc order by severity desc, n) rn from s) where rn = 1""")  # fmt: skip
def worst_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest finding of a document, the first of equally grave ones."""
    li = run_sql(spark, sf_dir, f"with {LINES} select * from li")
    rank = F.create_map(*[F.lit(x) for p in (("MAIL", 3), ("SHIP", 2), ("AIR", 1), ("RAIL", 0), ("TRUCK", 0)) for x in p])
    name = F.create_map(*[F.lit(x) for p in ((3, "VAULT_ECHO"), (2, "REDACTED_TARGET"), (1, "PII_SHAPE"), (0, "NONE")) for x in p])
    worst = F.max(F.struct(rank[F.col("l_shipmode")].alias("s"), (-F.col("l_linenumber")).alias("n"))).alias("w")
    return li.groupBy(F.col("l_orderkey").alias("doc")).agg(worst).select("doc", name[F.col("w.s")].alias("cause"), F.col("w.s").alias("severity"), (-F.col("w.n")).cast("long").alias("n"))


_PAGE = f"""{LINES}, pg as (select l_orderkey doc, l_linenumber n, case when l_shipmode in ('MAIL', 'TRUCK') then 'textbox' else 'button' end role, case when l_shipmode = 'MAIL' then 'PHONE' when l_shipmode = 'TRUCK' then 'NAME' end accepts, l_shipmode = 'SHIP' submit, case when l_discount > 0.05 then '<PII:PHONE:' || cast(l_linenumber as string) || '>' end token from li)"""


@query("reference_plan", "P-17", f"""with {_PAGE}, f as (select doc, min(n) filter (accepts = 'PHONE') field, min(n) filter (submit) button, arg_min(token, n) filter (token is not null) token from pg group by doc)
select doc, case when field is null then 'NO_PHONE_FIELD' when token is null then 'NO_PHONE_REFERENCE' when button is null then 'NO_SUBMIT' else 'insert #' || field || ' ' || token || '; click #' || button end plan from f""")  # fmt: skip
def reference_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the planner without a model: the first phone field, the first phone reference, the first submit button."""
    p = run_sql(spark, sf_dir, f"with {_PAGE} select * from pg")
    g = p.groupBy("doc").agg(F.min(F.when(F.col("accepts") == "PHONE", F.col("n"))).alias("f"), F.min(F.when(F.col("submit"), F.col("n"))).alias("b"), F.min(F.when(F.col("token").isNotNull(), F.struct("n", "token"))).alias("t"))
    plan = F.format_string("insert #%s %s; click #%s", F.col("f"), F.col("t.token"), F.col("b"))
    return g.select("doc", F.when(F.col("f").isNull(), "NO_PHONE_FIELD").when(F.col("t").isNull(), "NO_PHONE_REFERENCE").when(F.col("b").isNull(), "NO_SUBMIT").otherwise(plan).alias("plan"))


@query("act_results", "T-09 T-10", f"""with {NODES}, {CLAIMS}, a as (select c.*, n.node found, n.name nname, n.role nrole, n.enabled, (select count(*) from nodes m where m.node = c.node and m.frame = 'f0') same from claims c left join nodes n on n.node = c.node where kind <> 'type' and has_claim),
g as (select *, case when found is null then 'VALIDATE' when role = 'link' and not has_point then 'AUTHORISE' when topmost is null or answer_ms > 2000 or topmost <> node then 'HIT_TEST' when seq <> 1 then 'PERMIT' when not enabled then 'ACT' end failed from a)
select id, coalesce(failed, '-') failed_stage, case when failed = 'ACT' then 'NOT_CONFIRMED:ACTION_NOT_DISPATCHED' when failed is not null then 'NOT_RUN' when not watching then 'UNKNOWN:DISPATCH_OUTCOME_UNKNOWN' when frame = 'f1' then 'UNKNOWN:OBSERVATION_STALE' when same = 0 then 'UNKNOWN:TARGET_ABSENT_AFTER_ACTION' when nrole <> role then 'UNKNOWN:TARGET_IDENTITY_CHANGED'
  when kind = 'focus' then case when not has_point then 'UNKNOWN:FOCUS_NOT_OBSERVED' else 'CONFIRMED' end when nname = name then 'CONFIRMED' else 'NOT_CONFIRMED:STATE_DIFFERS' end verification from g""")  # fmt: skip
def act_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first guard that stops an act, and after acts that ran whether the page shows what was expected."""
    c = run_sql(spark, sf_dir, f"with {CLAIMS} select * from claims").where((F.col("kind") != "type") & F.col("has_claim"))
    n = run_sql(spark, sf_dir, f"with {NODES} select * from nodes").select(F.col("node").alias("found"), F.col("name").alias("nname"), F.col("role").alias("nrole"), "enabled", (F.col("frame") == "f0").alias("same"))
    d = c.join(n, F.col("node") == F.col("found"), "left")
    hit = F.coalesce((F.col("topmost") == F.col("node")) & (F.col("answer_ms") <= 2000), F.lit(False))
    stages = (("VALIDATE", F.col("found").isNull()), ("AUTHORISE", (F.col("role") == "link") & ~F.col("has_point")), ("HIT_TEST", ~hit), ("PERMIT", F.col("seq") != 1), ("ACT", ~F.col("enabled")))
    failed = F.coalesce(*[F.when(bad, name) for name, bad in stages])
    focus = F.when(~F.col("has_point"), "UNKNOWN:FOCUS_NOT_OBSERVED").otherwise("CONFIRMED")
    after = (
        F.when(~F.col("watching"), "UNKNOWN:DISPATCH_OUTCOME_UNKNOWN").when(F.col("frame") == "f1", "UNKNOWN:OBSERVATION_STALE").when(~F.col("same"), "UNKNOWN:TARGET_ABSENT_AFTER_ACTION").when(F.col("nrole") != F.col("role"), "UNKNOWN:TARGET_IDENTITY_CHANGED")
        .when(F.col("kind") == "focus", focus).when(F.col("nname") == F.col("name"), "CONFIRMED").otherwise("NOT_CONFIRMED:STATE_DIFFERS")
    )
    return d.select("id", F.coalesce(failed, F.lit("-")).alias("failed_stage"), F.when(failed == "ACT", "NOT_CONFIRMED:ACTION_NOT_DISPATCHED").when(failed.isNotNull(), "NOT_RUN").otherwise(after).alias("verification"))


@query("baselines", "D-02", f"""with {BOXES}, b as (select 'perfect' baseline, sample, cls, x, y, w, h, uid from gt union all select 'shifted', sample, cls, x + 25, y + 10, w, h, uid from gt union all select 'swapped', sample, (cls + 1) % 3, x, y, w, h, uid from gt)
select n.baseline, coalesce(c.predictions, 0) predictions, coalesce(c.right_, 0) right_, round(coalesce(c.right_, 0) / (select count(*) from gt)::double, 9) recall from (values ('perfect'), ('empty'), ('shifted'), ('swapped')) n(baseline)
left join (select b.baseline, count(*) predictions, count(*) filter (b.cls = g.cls and {at_least_half('b', 'g')}) right_ from b join gt g on g.uid = b.uid group by b.baseline) c on c.baseline = n.baseline""")  # fmt: skip
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions made from the labels themselves: the same, none, moved and of the next class; how many are right."""
    g = gt(spark, sf_dir)
    a, b = Box.of(), Box.of("b")
    made = {"perfect": (F.lit(0), F.lit(0), F.col("cls")), "empty": None, "shifted": (F.lit(25), F.lit(10), F.col("cls")), "swapped": (F.lit(0), F.lit(0), (F.col("cls") + 1) % 3)}
    rows = [F.struct(F.lit(k).alias("baseline"), F.lit(m is not None).alias("made"), *[v.cast("bigint").alias(n) for n, v in zip(("dx", "dy", "bcls"), m or (F.lit(0), F.lit(0), F.col("cls")), strict=True)]) for k, m in made.items()]
    d = g.withColumn("b", F.explode(F.array(*rows))).select("*", (F.col("x") + F.col("b.dx")).alias("bx"), (F.col("y") + F.col("b.dy")).alias("by"), F.col("w").alias("bw"), F.col("h").alias("bh"))
    right = F.col("b.made") & (F.col("b.bcls") == F.col("cls")) & (3 * a.overlap(b) >= a.w * a.h + b.w * b.h)
    s = d.groupBy(F.col("b.baseline").alias("baseline")).agg(F.count_if(F.col("b.made")).alias("predictions"), F.count_if(right).alias("right_"), F.count("*").alias("n"))
    return s.select("baseline", "predictions", "right_", F.round(F.col("right_") / F.col("n"), 9).alias("recall"))


@query("regression_gate", "D-17", """with m as (select p.p_brand cls, avg(case when l.l_returnflag = 'N' then 1.0::double else 0 end) cur, avg(case when l.l_linestatus = 'O' then 1.0::double else 0 end) base, count(distinct l.l_suppkey % 3) fp_cur, count(distinct p.p_size % 3) fp_base from lineitem l join part p on p.p_partkey = l.l_partkey group by 1)
select cls, round(cur, 9) cur, round(base, 9) base, case when fp_cur <> fp_base then 'FINGERPRINT_DIFFERS' when cur < base - 0.02 then 'REGRESSED' else 'OK' end verdict from m""")  # fmt: skip
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of each class against its baseline: only runs of the same pipeline compare, and none may drop by more than 0.02."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = j.groupBy(F.col("p_brand").alias("cls")).agg(F.avg((F.col("l_returnflag") == "N").cast("double")).alias("cur"), F.avg((F.col("l_linestatus") == "O").cast("double")).alias("base"), F.countDistinct(F.col("l_suppkey") % 3).alias("a"), F.countDistinct(F.col("p_size") % 3).alias("b"))
    verdict = F.when(F.col("a") != F.col("b"), "FINGERPRINT_DIFFERS").when(F.col("cur") < F.col("base") - 0.02, "REGRESSED").otherwise("OK")
    return m.select("cls", F.round("cur", 9).alias("cur"), F.round("base", 9).alias("base"), verdict.alias("verdict"))


_CALLS = """cl as (select event_id id, user_id, event_type kind, cast(floor(epoch_us / 1000) as bigint) ms, row_number() over (partition by user_id order by epoch_us, event_id) k from e)"""


@query("call_times", "T-13 T-15", f"""with {DUCK_E}, {_CALLS}, p as (select a.*, b.ms - a.ms took from cl a left join cl b on b.user_id = a.user_id and b.k = a.k + 1)
select kind, case when took is null then 'UNTIMED:NO_END' when kind = 'view' then case when took > 10000000 then 'DEADLINE' else 'IN_TIME' end when took > 30000000 then 'DEADLINE' else 'IN_TIME' end state, count(*) n, coalesce(sum(took), 0)::bigint total_ms, coalesce(max(took), 0)::bigint worst_ms from p group by 1, 2""")  # fmt: skip
def call_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by how they raced their deadline, views having the shorter one; a call that never ended is not timed, and says so."""
    c = run_sql(spark, sf_dir, f"with {SPARK_E}, {_CALLS} select * from cl")
    took = F.lead("ms").over(Window.partitionBy("user_id").orderBy("k")) - F.col("ms")
    c = c.withColumn("took", took)
    limit = F.when(F.col("kind") == "view", 10_000_000).otherwise(30_000_000)
    state = F.when(F.col("took").isNull(), "UNTIMED:NO_END").when(F.col("took") > limit, "DEADLINE").otherwise("IN_TIME")
    return c.groupBy("kind", state.alias("state")).agg(F.count("*").alias("n"), F.coalesce(F.sum("took"), F.lit(0)).alias("total_ms"), F.coalesce(F.max("took"), F.lit(0)).alias("worst_ms"))


@query("quota_check", "D-05", """with q as (select p_brand cls, p_type bucket, count(*) n, min(p_size) lo from part group by 1, 2), s as (select *, case when lo = 1 then -1 else n end quota, case when bucket like '%BRASS%' then 'metal' when n > 3 then 'wide' else 'plain' end region from q)
select cls, bucket, quota, case when quota < 0 then 'NEGATIVE' when region = 'metal' and quota > 2 then 'UNKNOWN_REGION' when quota > (select 20) then 'TOO_MANY' else 'OK' end verdict from s""")  # fmt: skip
def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of a schedule that cannot be planned, by their first defect."""
    q = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cls"), F.col("p_type").alias("bucket")).agg(F.count("*").alias("n"), F.min("p_size").alias("lo"))
    quota = F.when(F.col("lo") == 1, -1).otherwise(F.col("n")).cast("long")
    return q.select("cls", "bucket", quota.alias("quota"), F.when(quota < 0, "NEGATIVE").when(F.col("bucket").contains("BRASS") & (quota > 2), "UNKNOWN_REGION").when(quota > 20, "TOO_MANY").otherwise("OK").alias("verdict"))


@query("set_scores", "A-23", f"""with {BOXES}, i as (select sample, count(*) glyphs, count(*) filter (r % 41 = 0) exposed, sum(w * h) / 120000.0::double over_mask from gt group by sample), s as (select sample % 5 set_, count(*) images, sum(glyphs)::bigint glyphs, sum(exposed)::bigint exposed, max(over_mask) worst, bool_and(exposed = 0) none_exposed, bool_and(over_mask < 3) bounded from i group by 1)
select *, round(3.0::double / glyphs, 9) upper_bound, case when images < 3 or glyphs < 100 then 'TOO_SMALL' when not none_exposed then 'EXPOSED' when not bounded then 'OVER_MASKED' else 'PASS' end verdict from (select set_, images, glyphs, exposed, round(worst, 9) worst, none_exposed, bounded from s)""")  # fmt: skip
def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of redacted images passes if it is large enough and every image of it does; with none exposed, the true share is under 3 / n."""
    i = gt(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("glyphs"), F.count_if(F.col("r") % 41 == 0).alias("exposed"), (F.sum(F.col("w") * F.col("h")) / 120000.0).alias("m"))
    s = i.groupBy((F.col("sample") % 5).alias("set_")).agg(F.count("*").alias("images"), F.sum("glyphs").alias("glyphs"), F.sum("exposed").alias("exposed"), F.round(F.max("m"), 9).alias("worst"), F.bool_and(F.col("exposed") == 0).alias("none_exposed"), F.bool_and(F.col("m") < 3).alias("bounded"))
    verdict = F.when((F.col("images") < 3) | (F.col("glyphs") < 100), "TOO_SMALL").when(~F.col("none_exposed"), "EXPOSED").when(~F.col("bounded"), "OVER_MASKED").otherwise("PASS")
    return s.select("*", F.round(F.lit(3.0) / F.col("glyphs"), 9).alias("upper_bound"), verdict.alias("verdict"))


@query("quad_bounds", "M-22", """with q as (select s_suppkey id, [s_suppkey % 90, s_suppkey * 7 % 80, s_suppkey * 3 % 70, s_nationkey] xs, [s_suppkey % 60, s_suppkey * 5 % 50, s_nationkey * 2, s_suppkey * 11 % 40] ys from supplier)
select id, list_min(xs) x, list_min(ys) y, list_max(xs) - list_min(xs) w, list_max(ys) - list_min(ys) h from q""")  # fmt: skip
def quad_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned bounds of quads."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("bigint")
    xs, ys = F.array(k % 90, k * 7 % 80, k * 3 % 70, n), F.array(k % 60, k * 5 % 50, n * 2, k * 11 % 40)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


@query("overflow_plan", "D-08")
def overflow_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of each split dealt to samples; what does not fit goes to further samples, and the split is refused if these run out. A split's targets are one task's: its schedule is bounded by design."""
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("split"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))
    return t.groupBy("split").applyInPandas(scheduling.overflow_plan, "split string, id long, sample long, rescheduled boolean, samples long, verdict string")
