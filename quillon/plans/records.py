"""Queries on JSON records: findings, redaction plans, consent, evidence, controls, contexts, turns and attested sends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.records import FAILURES, consent_cause, exact_record, finding_cause, must_redact, output_cause
from quillon.plans.boxes import BOXES
from quillon.plans.detection import gt
from quillon.registry import query, run_sql, table

#: Lines in order within their order, with modes and instructions told by their keys.
LINES = """li as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) l_linenumber, l_partkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
  case l_suppkey % 6 when 0 then 'MAIL' when 1 then 'SHIP' when 2 then 'RAIL' when 3 then 'AIR' else 'TRUCK' end l_shipmode, case l_partkey % 4 when 0 then 'DELIVER IN PERSON' when 1 then 'COLLECT COD' when 2 then 'NONE' else 'TAKE BACK RETURN' end l_shipinstruct from lineitem)"""

# Records with every defect, alike on both engines: text put together from keys and values.
FINDINGS = """fd as (select event_id id, user_id, case when event_id % 2 = 0 then
  case event_id % 46 when 2 then '{"kind":"UNREAD_REGION","text":"a","piiClass":null,"box":{"x":1,"y":2,"w":3,"h":4},"score":0.5,"regionId":"canvas:1","treatment":"REDACT_UNREAD"}'
   when 4 then '{"kind":"UNREAD_REGION","box":{"x":1,"y":2,"w":3,"h":4},"score":0.5}' when 6 then '{"kind":"UNREAD_REGION","box":{"x":1,"y":2,"w":3,"h":4},"score":0.5,"regionId":"canvas:1","treatment":"BLUR"}'
   when 8 then '{"kind":"UNREAD_REGION","box":{"x":1,"y":2,"w":0,"h":4},"score":0.5,"regionId":"canvas:1","treatment":"REDACT_UNREAD"}' when 10 then '{"kind":"UNREAD_REGION","box":{"x":"1","y":2,"w":3,"h":4},"score":0.5,"regionId":"canvas:1","treatment":"REDACT_UNREAD"}'
   when 12 then '{"kind":"UNREAD_REGION","box":{"x":1,"y":2,"w":3,"h":4,"z":1},"score":0.5,"regionId":"canvas:1","treatment":"REDACT_UNREAD"}' when 14 then '{"kind":"UNREAD_REGION","box":{"x":1,"y":2,"w":3,"h":4},"score":"high","regionId":"canvas:1","treatment":"REDACT_UNREAD"}'
   when 16 then '{"kind":"UNREAD_REGION","box":{"x":1,"y":2,"w":3,"h":4},"score":1.5,"regionId":"canvas:1","treatment":"REDACT_UNREAD"}' when 18 then '{"kind":"UNREAD_REGION","box":{"x":1,"y":2,"w":3,"h":4},"score":0.5,"regionId":"","treatment":"REDACT_UNREAD"}'
   when 20 then '[1,2]' when 22 then '{"box":{"x":1,"y":2,"w":3,"h":4}}' when 24 then '{"kind":"OTHER"}'
   else '{"kind":"UNREAD_REGION","box":{"x":' || cast(event_id % 90 as string) || ',"y":2.5,"w":' || cast(event_id % 7 as string) || ',"h":4},"score":' || cast(event_id % 12 as string) || 'e-1,"regionId":"canvas:' || cast(user_id % 3 as string) || '","treatment":"REDACT_UNREAD"}' end
  else case event_id % 34 when 1 then '{"kind":"READ_TEXT","box":{"x":1,"y":2,"w":3,"h":4},"length":2.5,"piiClass":null,"ref":null}' when 3 then '{"kind":"READ_TEXT","box":{"x":1,"y":2,"w":3,"h":4},"length":-1,"piiClass":null,"ref":null}'
   when 5 then '{"kind":"READ_TEXT","box":{"x":1,"y":2,"w":3,"h":4},"length":2,"piiClass":"CARD","ref":null}' when 7 then '{"kind":"READ_TEXT","box":{"x":1,"y":2,"w":3,"h":4},"length":2,"piiClass":7,"ref":null}'
   when 9 then '{"kind":"READ_TEXT","box":{"x":1,"y":2,"w":3,"h":4},"length":2,"piiClass":null,"ref":5}' when 11 then '{"kind":"READ_TEXT","box":[1,2,3,4],"length":2,"piiClass":null,"ref":null}' when 13 then '{"kind":"READ_TEXT","box":{"x":1,"y":2,"w":3,"h":4},"length":2,"ref":"r","text":"t"}'
   else '{"kind":"READ_TEXT","box":{"x":1,"y":2,"w":3,"h":4},"length":' || cast(event_id % 40 as string) || ',"piiClass":' || case event_id % 3 when 0 then 'null' when 1 then '"PHONE"' else '"UNKNOWN"' end || ',"ref":' || case when event_id % 5 = 0 then '"r1"' else 'null' end || '}' end end j from events)"""

_TYPES = """k as (select *, coalesce(json_type(j), '') top, case when json_type(j) = 'OBJECT' then json_keys(j) else [] end keys, json_extract_string(j, '$.kind') kind, json_type(j, '$.box') bt,
  case when json_type(j, '$.box') = 'OBJECT' then json_keys(j, '$.box') else [] end bk, list_transform(['x', 'y', 'w', 'h'], lambda f: coalesce(json_type(j, '$.box.' || f), '') in ('UBIGINT', 'BIGINT', 'DOUBLE')) bn from fd),
b as (select *, list_sort(bk) = ['h', 'w', 'x', 'y'] and list_bool_and(bn) and coalesce(try_cast(json_extract_string(j, '$.box.w') as double), 0) > 0 and coalesce(try_cast(json_extract_string(j, '$.box.h') as double), 0) > 0 sound,
  coalesce(json_type(j, '$.score'), '') in ('UBIGINT', 'BIGINT', 'DOUBLE') and coalesce(try_cast(json_extract_string(j, '$.score') as double) between 0 and 1, false) score_ok,
  coalesce(json_type(j, '$.length'), '') in ('UBIGINT', 'BIGINT', 'DOUBLE') and coalesce(try_cast(json_extract_string(j, '$.length') as double) >= 0 and try_cast(json_extract_string(j, '$.length') as double) % 1 = 0, false) length_ok from k),
x as (select *, list_sort(list_filter(keys, lambda f: f not in ('kind', 'box', 'score', 'regionId', 'treatment'))) ue, list_filter(['kind', 'box', 'score', 'regionId', 'treatment'], lambda f: not list_contains(keys, f)) um,
  list_sort(list_filter(keys, lambda f: f not in ('kind', 'box', 'length', 'piiClass', 'ref'))) re, list_filter(['kind', 'box', 'length', 'piiClass', 'ref'], lambda f: not list_contains(keys, f)) rm from b),
c as (select *, case when top <> 'OBJECT' then 'NOT_AN_OBJECT' when not list_contains(keys, 'kind') then 'MISSING_KIND'
  when kind = 'UNREAD_REGION' then case when len(ue) > 0 then 'UNREAD_REGION_EXTRA_FIELD:' || array_to_string(ue, ',') when len(um) > 0 then 'UNREAD_REGION_MISSING_FIELD:' || array_to_string(um, ',') when json_extract_string(j, '$.treatment') <> 'REDACT_UNREAD' then 'UNREAD_REGION_TREATMENT'
    when not sound then 'UNREAD_REGION_GEOMETRY' when not score_ok then 'UNREAD_REGION_SCORE' when json_extract_string(j, '$.regionId') = '' then 'UNREAD_REGION_REGION' else 'OK' end
  when kind = 'READ_TEXT' then case when len(re) > 0 then 'READ_TEXT_EXTRA_FIELD:' || array_to_string(re, ',') when len(rm) > 0 then 'READ_TEXT_MISSING_FIELD:' || array_to_string(rm, ',') when not sound then 'READ_TEXT_GEOMETRY' when not length_ok then 'READ_TEXT_LENGTH'
    when json_type(j, '$.piiClass') <> 'NULL' and coalesce(json_extract_string(j, '$.piiClass'), '') not in ('OTP', 'AADHAAR', 'PHONE', 'DOB', 'NAME', 'UNKNOWN') then 'READ_TEXT_UNKNOWN_CLASS' when json_type(j, '$.ref') not in ('NULL', 'VARCHAR') then 'READ_TEXT_REF' else 'OK' end
  else 'UNKNOWN_KIND' end code from x)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"with {FINDINGS} select * from fd")


@query("finding_parse", "F-01 F-02 F-03 F-04", f"with {FINDINGS}, {_TYPES} select id, code, code <> 'OK' or kind = 'UNREAD_REGION' or json_type(j, '$.piiClass') <> 'NULL' must_redact from c")
def finding_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first defect of every finding, and whether it needs redaction: what is not sound always does."""
    d = findings(spark, sf_dir).withColumn("code", finding_cause(F.col("j")))
    return d.select("id", "code", ((F.col("code") != "OK") | must_redact(F.col("j"))).alias("must_redact"))


_REGIONS = """case user_id % 9 when 0 then '[{"id":"canvas:0","rect":{"x":0,"y":0,"w":90,"h":9}},{"id":"canvas:0","rect":{"x":0,"y":0,"w":9,"h":9}}]' when 1 then '[{"id":"","rect":{"x":0,"y":0,"w":9,"h":9}}]' when 2 then '[{"id":"canvas:1","rect":{"x":0,"y":0,"w":9}}]' when 3 then '{}'
  when 4 then '[{"id":"canvas:1","rect":{"x":0,"y":0,"w":9,"h":9}}]' else '[{"id":"canvas:0","rect":{"x":0,"y":0,"w":90,"h":9}},{"id":"canvas:1","rect":{"x":0,"y":0,"w":90,"h":9}},{"id":"canvas:2","rect":{"x":0,"y":0,"w":90,"h":9}}]' end"""
_STATUS = "case user_id % 23 when 7 then 'TIMEOUT' when 9 then 'MAYBE' else 'OK' end"


@query("redaction_plans", "P-10 F-05", f"""with {FINDINGS}, {_TYPES}, rep as (select *, {_REGIONS} regions, {_STATUS} status, cast(floor(id / 3) as bigint) pass_, row_number() over (partition by user_id, cast(floor(id / 3) as bigint) order by id) nth from c),
ids as (select distinct user_id, list_transform(case when json_type(regions) = 'ARRAY' then json_extract(regions, '$[*]') else [] end, lambda r: json_extract_string(r, '$.id')) ids,
  case when json_type(regions) = 'ARRAY' then list_bool_and(list_transform(json_extract(regions, '$[*]'), lambda r: list_sort(json_keys(r, '$.rect')) = ['h', 'w', 'x', 'y'])) else false end rects from rep),
p as (select rep.*, ids.ids, case when json_type(regions) <> 'ARRAY' or list_contains(ids.ids, '') or len(list_distinct(ids.ids)) < len(ids.ids) or not rects then 'REFUSED' when status = 'TIMEOUT' then 'TIMEOUT' when status <> 'OK' then 'MALFORMED:REPORT_STATUS' when code <> 'OK' then 'MALFORMED:' || code
  when kind = 'UNREAD_REGION' and not list_contains(ids.ids, json_extract_string(j, '$.regionId')) then 'MALFORMED:UNKNOWN_REGION' end whole from rep join ids using (user_id)),
q as (select *, case when whole = 'MALFORMED:UNKNOWN_REGION' then 2 when whole like 'MALFORMED:%' then 1 when whole is null then 3 else 0 end sev from p),
g as (select user_id, pass_, min(sev) sev, arg_min(whole, sev * 1000 + nth) whole, any_value(ids) ids from q group by user_id, pass_),
m as (select q.user_id, q.pass_, sum(case when q.kind = 'UNREAD_REGION' then 1 when json_type(q.j, '$.piiClass') <> 'NULL' then len(q.ids) else 0 end)::bigint boxes from q group by q.user_id, q.pass_)
select g.user_id, g.pass_ pass, case when g.whole = 'REFUSED' then 'REFUSED' else 'PLANNED' end outcome, g.sev < 3 and g.whole <> 'REFUSED' fail_closed, case when g.sev < 3 and g.whole <> 'REFUSED' then g.whole end reason,
  case when g.whole = 'REFUSED' then 0 when g.sev < 3 then len(g.ids) else m.boxes end masks from g join m using (user_id, pass_)""")  # fmt: skip
def redaction_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visual redaction of every pass: by its findings, or whole regions if anything about its report is not in order."""
    d = findings(spark, sf_dir)
    # findings are read by all cores, however few parts the table has
    d = d.repartition(F.col("user_id"), F.floor(F.col("id") / 3).alias("pass")).withColumn("code", finding_cause(F.col("j")))
    unread = F.coalesce(F.get_json_object("j", "$.kind") == "UNREAD_REGION", F.lit(False))
    d = d.select("id", "user_id", F.floor(F.col("id") / 3).alias("pass"), "code", "j", unread.alias("unread"))
    d = d.withColumn("region", F.when(F.col("unread"), F.get_json_object("j", "$.regionId"))).withColumn("classed", ~F.col("unread") & must_redact(F.col("j")))
    g = d.groupBy("user_id", "pass").agg(
        F.min(F.when(F.col("code") != "OK", F.struct("id", "code"))).alias("bad"), F.collect_set("region").alias("named"), F.count_if("unread").alias("n_unread"), F.count_if("classed").alias("n_classed"),
    )
    # a report's regions and its status are the user's: they are read once a pass
    g = g.withColumn("regions", F.expr(_REGIONS)).withColumn("status", F.expr(_STATUS)).withColumn("read", F.from_json("regions", "array<struct<id:string,rect:map<string,double>>>"))
    listed = F.col("regions").startswith("[")
    g = g.withColumn("ids", F.when(listed, F.transform("read", lambda r: r["id"])).otherwise(F.array().cast("array<string>")))
    sound = listed & ~F.array_contains("ids", "") & (F.size(F.array_distinct("ids")) == F.size("ids")) & F.forall("read", lambda r: F.size(F.map_keys(r["rect"])) == 4)
    g = g.withColumn("sound", sound).withColumn("foreign", F.size(F.array_except("named", "ids")) > 0).withColumn("boxes", F.col("n_unread") + F.col("n_classed") * F.size("ids"))
    reason = (
        F.when(F.col("status").isin(*FAILURES), F.col("status")).when(F.col("status") != "OK", "MALFORMED:REPORT_STATUS").when(F.col("bad").isNotNull(), F.concat(F.lit("MALFORMED:"), "bad.code"))
        .when(F.col("foreign"), "MALFORMED:UNKNOWN_REGION")
    )
    g = g.withColumn("reason", F.when(F.col("sound"), reason))
    masks = F.when(~F.col("sound"), 0).when(F.col("reason").isNotNull(), F.size("ids")).otherwise(F.col("boxes"))
    return g.select("user_id", "pass", F.when(F.col("sound"), "PLANNED").otherwise("REFUSED").alias("outcome"), (F.col("sound") & F.col("reason").isNotNull()).alias("fail_closed"), "reason", masks.cast("long").alias("masks"))


_ANSWERS = """a as (select o_orderkey id, 'c' || cast(o_orderkey as string) consent, 's' || cast(o_custkey as string) session_, 'https://h' || cast(o_custkey % 5 as string) || '.example' origin, 'd' || cast(o_orderkey % 100 as string) document, '#f' || cast(o_orderkey % 7 as string) target, o_orderpriority pr, o_orderkey % 37 d from orders),
ans as (select *, case d when 1 then '[]' when 2 then '{"kind":"DENY","consentId":"' || consent || '"}' when 3 then '{"kind":"DENY","consentId":"c0"}' when 4 then '{"kind":"DENY","consentId":"' || consent || '","why":"x"}' when 5 then '{"kind":"ALLOW_ONCE"}' when 6 then '{"kind":"ALLOW"}' when 7 then 'null'
  else '{"kind":"ALLOW_ONCE","consentId":"' || case d when 8 then 'c0' else consent end || '","sessionId":"' || case d when 9 then 's' else session_ end || '","origin":"' || case d when 10 then 'https://other.example' else origin end || '","documentId":"' || case d when 11 then 'd' else document end || '","target":' ||
   case d when 12 then '"#x"' when 13 then '5' else '"' || target || '"' end || case d when 14 then ',"more":"1"' else '' end || '}' end j from a)"""


@query("consent_answers", "T-16", f"""with {_ANSWERS}, k as (select *, coalesce(json_type(j), '') t, case when json_type(j) = 'OBJECT' then list_sort(json_keys(j)) else [] end ks, json_extract_string(j, '$.kind') kind, json_extract_string(j, '$.consentId') c from ans)
select id, case when t <> 'OBJECT' then 'MALFORMED_CONSENT' when kind = 'DENY' and ks <> ['consentId', 'kind'] then 'MALFORMED_CONSENT' when kind = 'DENY' and c <> consent then 'NOT_THIS_CONSENT' when kind = 'DENY' then 'CONSENT_DENIED'
  when kind <> 'ALLOW_ONCE' or ks <> ['consentId', 'documentId', 'kind', 'origin', 'sessionId', 'target'] or json_type(j, '$.target') <> 'VARCHAR' then 'MALFORMED_CONSENT' when c <> consent then 'NOT_THIS_CONSENT' when json_extract_string(j, '$.sessionId') <> session_ then 'SESSION_MISMATCH'
  when json_extract_string(j, '$.origin') <> origin then 'ORIGIN_MISMATCH' when json_extract_string(j, '$.documentId') <> document then 'DOCUMENT_CHANGED' when json_extract_string(j, '$.target') <> target then 'TARGET_MISMATCH' else 'OK' end cause from k""")  # fmt: skip
def consent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each answer consents to the request it was given for."""
    d = run_sql(spark, sf_dir, f"with {_ANSWERS} select * from ans")
    return d.select("id", consent_cause(F.col("j"), {"consentId": F.col("consent"), "sessionId": F.col("session_"), "origin": F.col("origin"), "documentId": F.col("document"), "target": F.col("target")}).alias("cause"))


@query("egress_evidence", "E-05", f"""with {LINES}, a as (select l_orderkey run, l_linenumber n, l_shipmode dest, case when l_returnflag = 'R' then 'LEAK_' || l_shipinstruct end refusal, sha256(l_comment_or) client, case when l_linestatus = 'O' then sha256(l_comment_or) when l_tax > 0.04 then sha256('x') end peer
  from (select *, l_shipmode || l_partkey::varchar l_comment_or from li)),
f as (select run, min(n) first_n from a where refusal is null group by run)
select a.run, count(*) attempts, coalesce(string_agg(dest || ':' || refusal, '|' order by n) filter (refusal is not null), '') blocked, max(case when a.n = f.first_n and refusal is null then dest end) sent_to, coalesce(max(case when peer = client then 'AGREE' when peer is null then 'NO_RECEIPT' else 'DIFFER' end) filter (a.n = f.first_n and refusal is null), 'NOT_SENT') digests
from a left join f on f.run = a.run group by a.run""")  # fmt: skip
def egress_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run the attempts, the blocked ones in order, and whether the peer's digest of the first sent one agrees."""
    body = F.sha2(F.concat("l_shipmode", F.col("l_partkey").cast("string")), 256)
    li = run_sql(spark, sf_dir, f"with {LINES} select * from li").select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("n"), F.col("l_shipmode").alias("dest"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("LEAK_"), "l_shipinstruct")).alias("refusal"),
        body.alias("client"), F.when(F.col("l_linestatus") == "O", body).when(F.col("l_tax") > 0.04, F.sha2(F.lit("x"), 256)).alias("peer"),
    )
    row = F.struct("n", F.concat_ws(":", "dest", "refusal").alias("s"))
    sent = F.min(F.when(F.col("refusal").isNull(), F.struct("n", "dest", "client", "peer")))
    g = li.groupBy("run").agg(F.count("*").alias("attempts"), F.array_sort(F.collect_list(F.when(F.col("refusal").isNotNull(), row))).alias("b"), sent.alias("sent"))
    return g.select("run", "attempts", F.array_join(F.transform("b", lambda r: r["s"]), "|").alias("blocked"), F.col("sent.dest").alias("sent_to"), F.when(F.col("sent").isNull(), "NOT_SENT").when(F.col("sent.peer").isNull(), "NO_RECEIPT").when(F.col("sent.client") == F.col("sent.peer"), "AGREE").otherwise("DIFFER").alias("digests"))


_NODES = f"""{LINES}, n as (select l_orderkey doc, l_linenumber i, '#n' || cast(l_linenumber as string) sel, case l_shipmode when 'MAIL' then 'button' when 'SHIP' then 'link' when 'RAIL' then 'textbox' when 'AIR' then 'tab' else 'generic' end role, l_shipinstruct name, l_returnflag <> 'R' enabled,
  case when l_quantity < 6 then 'CSS_HIDDEN' when l_quantity < 12 then 'OFFSCREEN' when l_quantity < 18 then 'CLIPPED' else 'OBSERVED' end evidence, l_linestatus = 'F' redacted from li)"""


@query("declarable_controls", "E-13", f"""with {_NODES}, f as (select doc, min(i) focus from n where role in ('button', 'textbox') group by doc),
c as (select n.*, f.focus, row_number() over (partition by n.doc order by n.i) k from n left join f using (doc) where role in ('button', 'link', 'tab', 'checkbox', 'radio', 'menuitem', 'option', 'switch') and evidence in ('OBSERVED', 'CLIPPED'))
select doc, sel, 'k' || k control, role, sel || '|' || role || '|' || name fingerprint, case when enabled then 'TARGET_DISABLED,' else '' end || 'TARGET_RENAMED' || case when focus is not null and focus <> i then ',TARGET_FOCUSED' else '' end offers from c""")  # fmt: skip
def declarable_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible controls a person may declare a click for, and the expectations that do not hold yet (unknown focus offers none on it)."""
    n = run_sql(spark, sf_dir, f"with {_NODES} select * from n")
    focus = n.groupBy("doc").agg(F.min(F.when(F.col("role").isin("button", "textbox"), F.col("i"))).alias("focus"))
    c = n.where(F.col("role").isin("button", "link", "tab", "checkbox", "radio", "menuitem", "option", "switch") & F.col("evidence").isin("OBSERVED", "CLIPPED")).join(focus, "doc")
    offers = F.array_compact(F.array(F.when(F.col("enabled"), "TARGET_DISABLED"), F.lit("TARGET_RENAMED"), F.when(F.col("focus") != F.col("i"), "TARGET_FOCUSED")))
    k = F.row_number().over(Window.partitionBy("doc").orderBy("i"))
    return c.select("doc", "sel", F.concat(F.lit("k"), k.cast("string")).alias("control"), "role", F.concat_ws("|", "sel", "role", "name").alias("fingerprint"), F.array_join(offers, ",").alias("offers"))


@query("model_context", "E-14", f"""with {_NODES} select doc, coalesce(string_agg(sel || case when redacted then '' else '*' end, ' ' order by i) filter (role = 'textbox'), '') fields, coalesce(string_agg(sel || case when enabled then '+' else '-' end, ' ' order by i) filter (role = 'button'), '') buttons,
  coalesce(string_agg('<PII:NAME:' || i || '>', ' ' order by i) filter (redacted and name not like 'NONE%'), '') refs, coalesce(string_agg(sel, ' ' order by i) filter (evidence in ('OBSERVED', 'CLIPPED') and enabled and role in ('button', 'link', 'tab')), '') clickable, count(*) targets from n group by doc""")  # fmt: skip
def model_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a planner may see of a document: fields (* empty), buttons (+ enabled), references; and what it may click. No value of a field."""
    n = run_sql(spark, sf_dir, f"with {_NODES} select * from n")
    g = n.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("i", "sel", "role", "name", "enabled", "evidence", "redacted"))).alias("els"), F.count("*").alias("targets"))

    def shown(keep, text) -> Column:
        return F.array_join(F.transform(F.filter("els", keep), text), " ")

    return g.select(
        "doc", shown(lambda e: e["role"] == "textbox", lambda e: F.concat(e["sel"], F.when(e["redacted"], "").otherwise("*"))).alias("fields"),
        shown(lambda e: e["role"] == "button", lambda e: F.concat(e["sel"], F.when(e["enabled"], "+").otherwise("-"))).alias("buttons"),
        shown(lambda e: e["redacted"] & ~e["name"].startswith("NONE"), lambda e: F.concat(F.lit("<PII:NAME:"), e["i"].cast("string"), F.lit(">"))).alias("refs"),
        shown(lambda e: e["evidence"].isin("OBSERVED", "CLIPPED") & e["enabled"] & e["role"].isin("button", "link", "tab"), lambda e: e["sel"]).alias("clickable"), "targets",
    )


_TURNS = """tn as (select conv_id, turn, '{"state":"' || case role when 'user' then 'OBSERVED' else 'ACTED' end || '","secret":"' || substr(sha2(text, 256), 1, 8) || '","refusal":' || case when turn % 5 = 4 then '{"stage":"VALIDATE","cause":"STALE","raw":"x"}' else 'null' end ||
  ',"plan":{"steps":[{"op":"insert","target":"#f","literal":"9876543210"},{"op":"done","note":1}]},"consents":[' || case when turn % 3 = 1 then '{"target":"#f","piiClass":"PHONE","outcome":"ALLOWED","value":"987"}' else '' end || '],"timings":{"plan":' || cast(turn * 3 as string) || ',"act":"slow"},"declaredDone":' || case when turn > 2 then 'true' else '1' end || '}' j from conversations)"""


@query("turn_projection", "C-32", f"""with {_TURNS.replace("sha2(text, 256)", "sha256(text)")}
select conv_id, turn, json_extract_string(j, '$.state') state, case when json_type(j, '$.refusal') = 'OBJECT' then json_extract_string(j, '$.refusal.stage') || ':' || json_extract_string(j, '$.refusal.cause') end refusal,
  array_to_string(list_transform(json_extract(j, '$.plan.steps[*]'), lambda s: json_extract_string(s, '$.op') || coalesce('>' || json_extract_string(s, '$.target'), '')), ' ') ops, len(json_extract(j, '$.consents[*]')) consents, coalesce(json_extract(j, '$.declaredDone') = 'true', false) done,
  case when json_type(j, '$.timings.plan') in ('UBIGINT', 'BIGINT', 'DOUBLE') then json_extract_string(j, '$.timings.plan')::double end plan_ms, case when json_type(j, '$.timings.act') in ('UBIGINT', 'BIGINT', 'DOUBLE') then json_extract_string(j, '$.timings.act')::double end act_ms from tn""")  # fmt: skip
def turn_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allowed fields of a turn and no others: no value, literal or unknown key of the record is carried along."""
    schema = "state string, refusal struct<stage:string,cause:string>, plan struct<steps:array<struct<op:string,target:string>>>, consents array<struct<target:string,piiClass:string,outcome:string>>"
    d = run_sql(spark, sf_dir, f"with {_TURNS} select * from tn").withColumn("d", F.from_json("j", schema)).withColumn("v", F.parse_json("j"))
    ops = F.transform("d.plan.steps", lambda s: F.concat_ws(">", s["op"], s["target"]))

    def timing(name: str) -> Column:
        at = f"$.timings.{name}"
        return F.when(F.schema_of_variant(F.try_variant_get("v", at, "variant")).isin("BIGINT", "DOUBLE"), F.try_variant_get("v", at, "double"))

    done = F.coalesce((F.schema_of_variant(F.try_variant_get("v", "$.declaredDone", "variant")) == "BOOLEAN") & F.try_variant_get("v", "$.declaredDone", "boolean"), F.lit(False))
    refusal = F.when(F.col("d.refusal").isNotNull(), F.concat_ws(":", "d.refusal.stage", "d.refusal.cause"))
    return d.select("conv_id", "turn", F.col("d.state").alias("state"), refusal.alias("refusal"), F.array_join(ops, " ").alias("ops"), F.size("d.consents").cast("long").alias("consents"), done.alias("done"), timing("plan").alias("plan_ms"), timing("act").alias("act_ms"))


_PLANS = f"""{LINES}, pl as (select l_orderkey id, l_linenumber i, case l_shipmode when 'MAIL' then 'done' when 'SHIP' then 'click' else 'insert' end op, '#t' || cast(l_partkey % 9 as string) target, case when l_tax > 0.05 then l_shipinstruct end literal, case when l_discount > 0.05 then '<PII:PHONE:1>' end ref, cast(l_orderkey % 4 as bigint) session_ from li),
vault as (select 'DELIVER IN PERSON' literal, 'NAME' cls, cast(1 as bigint) session_ union all select 'COLLECT COD', 'PHONE', cast(1 as bigint) union all select 'NONE', 'OTP', cast(2 as bigint))"""


@query("plan_display", "P-18", f"""with {_PLANS}, s as (select pl.id, i, case op when 'done' then 'done' when 'click' then 'click ' || target else 'insert ' || target || case when pl.literal is not null then ' ' || coalesce('[' || v.cls || ']', '[TEXT]') when ref is not null then ' ' || ref else '' end end step
  from pl left join vault v on v.literal = pl.literal and v.session_ = pl.session_) select id, string_agg(step, '; ' order by i) shown from s group by id""")  # fmt: skip
def plan_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as they may be shown: a literal by the class the session's vault holds it under, never itself."""
    views = {n: run_sql(spark, sf_dir, f"with {_PLANS} select * from {n}") for n in ("pl", "vault")}
    marker = F.concat(F.lit("["), F.coalesce("cls", F.lit("TEXT")), F.lit("]"))
    tail = F.when(F.col("literal").isNotNull(), marker).otherwise(F.col("ref"))
    step = F.when(F.col("op") == "done", "done").when(F.col("op") == "click", F.concat_ws(" ", "op", "target")).otherwise(F.concat_ws(" ", F.col("op"), F.col("target"), tail))
    d = views["pl"].join(F.broadcast(views["vault"]), ["literal", "session_"], "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", step.alias("s")))).alias("steps"))
    return d.select("id", F.array_join(F.transform("steps", lambda s: s["s"]), "; ").alias("shown"))


_SENDS = """sd as (select event_id id, event_id % 400 att, user_id, 'body' || cast(event_id % 400 as string) body, case when event_type = 'error' then 'tampered' else 'body' || cast(event_id % 400 as string) end now_body, case when value < 3 then 's' || cast(user_id + 1 as string) else 's' || cast(user_id as string) end expected,
  case when event_type = 'click' then 'STRUCTURE_ONLY' else 'MASK_VERIFIED' end state, event_type in ('click', 'view') has_frame, case when user_id % 8 = 0 then null when user_id % 8 = 1 then 'http://prod.example' when user_id % 8 = 2 then 'https://localhost' when user_id % 8 = 3 then 'https://prod.example/path' else 'https://prod.example' end origin,
  case when user_id % 3 = 0 then 'https://prod.example/in' when user_id % 3 = 1 then 'https://prod.example:8443/in' else 'nowhere' end destination, user_id % 5 = 0 authenticated from events)"""


@query("send_gate", "P-14", f"""with {_SENDS}, w as (select *, row_number() over (partition by att order by id) nth from sd)
select id, case when nth > 1 then 'ATTESTATION_SPENT' when expected <> 's' || user_id then 'RUN_IDENTITY_MISMATCH' when has_frame and state <> 'MASK_VERIFIED' then 'STATE_NOT_ADMISSIBLE' when sha256(now_body) <> sha256(body) then 'BODY_HASH_MISMATCH' when origin is null then 'CONFIGURATION_MISSING'
  when not regexp_full_match(origin, 'https://[a-z0-9.]+(:[0-9]+)?') or origin = 'https://localhost' then 'CONFIGURATION_INVALID' when coalesce(regexp_extract(destination, '^(https?://[^/]+)', 1), '') <> origin then 'DESTINATION_NOT_CONFIGURED_ORIGIN' when not authenticated then 'AUTHENTICATION_NOT_CONFIGURED' else 'PRODUCTION_TRANSPORT_ABSENT' end cause from w""")  # fmt: skip
def send_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why no attested body is sent to production: each attestation is good for one use, and everything about it must be as attested."""
    d = run_sql(spark, sf_dir, f"with {_SENDS} select * from sd")
    first = d.groupBy("att").agg(F.min("id").alias("first"))
    d = d.join(first, "att")
    host, scheme = F.try_parse_url("origin", F.lit("HOST")), F.try_parse_url("origin", F.lit("PROTOCOL"))
    authority = F.try_parse_url("origin", F.lit("AUTHORITY"))
    to = F.concat(F.try_parse_url("destination", F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url("destination", F.lit("AUTHORITY")))
    invalid = F.coalesce((scheme != "https") | host.isin("127.0.0.1", "localhost", "::1", "[::1]") | (F.concat(scheme, F.lit("://"), authority) != F.col("origin")), F.lit(True))
    cause = (
        F.when(F.col("id") != F.col("first"), "ATTESTATION_SPENT").when(F.col("expected") != F.concat(F.lit("s"), F.col("user_id").cast("string")), "RUN_IDENTITY_MISMATCH")
        .when(F.col("has_frame") & (F.col("state") != "MASK_VERIFIED"), "STATE_NOT_ADMISSIBLE").when(F.sha2("now_body", 256) != F.sha2("body", 256), "BODY_HASH_MISMATCH")
        .when(F.col("origin").isNull(), "CONFIGURATION_MISSING").when(invalid, "CONFIGURATION_INVALID").when(F.coalesce(to, F.lit("")) != F.col("origin"), "DESTINATION_NOT_CONFIGURED_ORIGIN")
        .when(~F.col("authenticated"), "AUTHENTICATION_NOT_CONFIGURED").otherwise("PRODUCTION_TRANSPORT_ABSENT")
    )
    return d.select("id", cause.alias("cause"))


@query("probability_maps", "F-22", """with m as (select l_orderkey id, list(case when l_tax > 0.079 then 1.5 else l_discount::double end) data, min(l_partkey) k, count(*) n from lineitem group by l_orderkey),
d as (select *, case when k % 17 = 0 then null when k % 13 = 0 then [1, 1, n] when k % 11 = 0 then [1, 3, 1, n] when k % 7 = 0 then [1, 1, 2, n] else [1, 1, 1, n] end dims, case when k % 5 = 0 then n + 1 else n end w from m)
select id, case when dims is null then 'NO_DIMS' when len(dims) <> 4 or dims[1] <> 1 or dims[2] <> 1 then 'NOT_ONE_MAP' when dims[3] <> 1 or dims[4] <> w then 'OTHER_SIZE' when len(data) <> w then 'OTHER_LENGTH' when list_max(data) > 1 or list_min(data) < 0 then 'NOT_A_PROBABILITY' else 'OK' end cause from d""")  # fmt: skip
def probability_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of a text-region model: dimensions, length, and every value a probability."""
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(F.col("l_tax") > 0.079, 1.5).otherwise(F.col("l_discount").cast("double"))).alias("d"), F.min("l_partkey").alias("k"), F.count("*").alias("n"))
    one, n = F.lit(1).cast("long"), F.col("n")
    dims = F.when(F.col("k") % 17 == 0, None).when(F.col("k") % 13 == 0, F.array(one, one, n)).when(F.col("k") % 11 == 0, F.array(one, F.lit(3).cast("long"), one, n)).when(F.col("k") % 7 == 0, F.array(one, one, F.lit(2).cast("long"), n)).otherwise(F.array(one, one, one, n))
    return m.select("id", output_cause(dims, F.col("d"), one, F.when(F.col("k") % 5 == 0, n + 1).otherwise(n)).alias("cause"))


_BOXES_JSON = """bj as (select p_partkey id, case p_partkey % 7 when 0 then '{"x":1,"y":2,"w":3,"h":4,"score":0.5,"text":"a"}' when 1 then '{"x":1,"y":"2","w":3,"h":4,"score":0.5}' when 2 then '{"x":1,"y":2,"w":3,"h":4,"score":null,"cls":1,"ocr":"b"}' else '{"x":1,"y":2,"w":' || cast(p_size as string) || ',"h":4,"score":0.5}' end j from part)"""


@query("plaintext_check", "F-24", f"""with {_BOXES_JSON}, f as (select id, j, unnest(json_keys(j)) k from bj)
select bj.id, coalesce(string_agg(case when k not in ('x', 'y', 'w', 'h', 'score') then 'box field ' || k || ' is not permitted' when json_type(f.j, '$.' || k) not in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'box field ' || k || ' is not a finite number' end, '|'
  order by k in ('x', 'y', 'w', 'h', 'score'), case when k in ('x', 'y', 'w', 'h', 'score') then list_position(['x', 'y', 'w', 'h', 'score'], k) end, k), '') reasons from bj join f on f.id = bj.id group by bj.id""")  # fmt: skip
def plaintext_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output boxes carry numbers under five names and nothing that could hold text."""
    return run_sql(spark, sf_dir, f"with {_BOXES_JSON} select * from bj").select("id", F.array_join(exact_record(F.col("j"), ("x", "y", "w", "h", "score")), "|").alias("reasons"))


@query("frame_regions", "J-19 J-23", f"""with {BOXES}, r as (select sample, uid, x, y, w, h, sample * 3 + case when r % 19 = 0 then 1 else 0 end frame from gt), s as (select sample, sample * 3 graph_frame, count(*) n, count(*) filter (frame <> sample * 3) foreign_n from r group by sample),
v as (select r.sample, 'canvas:' || k.k region, count(*) findings, round(min(r.x * 0.5::double), 6) left_css, round(max((r.y + r.h) * 0.5::double), 6) bottom_css from r, (values (0), (1), (2)) k(k) where k.k <= r.sample % 3 group by all)
select s.sample, v.region, case when foreign_n > 0 then 'STALE_FRAME' else 'OK' end status, foreign_n, case when foreign_n = 0 then findings else 0 end findings, case when foreign_n = 0 then left_css end left_css, case when foreign_n = 0 then bottom_css end bottom_css from s join v using (sample)""")  # fmt: skip
def frame_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region gets every detection of its frame, in CSS pixels; one detection of another frame and nothing is reported."""
    d = gt(spark, sf_dir).withColumn("frame", F.col("sample") * 3 + F.when(F.col("r") % 19 == 0, 1).otherwise(0))
    g = d.groupBy("sample").agg(F.count_if(F.col("frame") != F.col("sample") * 3).alias("foreign_n"), F.count("*").alias("n"), F.min(F.col("x") * 0.5).alias("l"), F.max((F.col("y") + F.col("h")) * 0.5).alias("b"))
    g = g.withColumn("region", F.explode(F.sequence(F.lit(0), (F.col("sample") % 3).cast("int"))))
    same = F.col("foreign_n") == 0
    return g.select("sample", F.concat(F.lit("canvas:"), F.col("region").cast("string")).alias("region"), F.when(same, "OK").otherwise("STALE_FRAME").alias("status"), "foreign_n", F.when(same, F.col("n")).otherwise(0).alias("findings"), F.when(same, F.round("l", 6)).alias("left_css"), F.when(same, F.round("b", 6)).alias("bottom_css"))
