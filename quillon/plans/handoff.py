"""Plans, handoffs, manifests, frames and egress: documents as JSON columns, rules in their fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.registry import both, query, run_sql

#: Plan documents derived from events; every defect of the parser occurs.
PLANS = """p as (select event_id id, '{"planVersion":"' || case when event_id % 23 = 0 then '2' else '1' end || '","steps":[' ||
  case event_id % 6 when 0 then '{"op":"done"}' when 1 then '{"op":"insert","target":"f' || cast(event_id % 5 as string) || '","ref":"<PII:PHONE:1>"},{"op":"click","target":"b"}'
   when 2 then '{"op":"insert","target":"f1","ref":"<PII:NAME:1>","literal":"x"}' when 3 then '{"op":"click","target":"b"},{"op":"click","target":"c"}' when 4 then '{"op":"insert","target":"f2","literal":"hello"},{"op":"done"}'
   else case event_id % 4 when 1 then '{"op":"scroll","target":"b"}' when 3 then '{"op":"click"}' else '{"op":"insert","target":"f3"}' end end ||
  '],"provenance":{"requestId":"r' || cast(event_id % 3 as string) || '","sessionId":"' || case when event_id % 29 = 0 then '' else 's1' end || '","viewId":"v' || cast(event_id % 7 as string) || '"}}' doc from events)"""
_STEP_CAUSE = """case when op is null or op not in ('insert', 'click', 'done') then 'UNSUPPORTED_OPERATION' when op = 'done' and n <> 1 then 'DONE_NOT_ALONE' when op = 'done' then null when target is null then 'MALFORMED_TARGET'
  when op = 'click' then null when ref is not null and literal is not null then 'INSERT_NOT_BOTH' when ref is null and literal is null then 'INSERT_NEEDS_REF_OR_LITERAL' end"""


@query("plan_parse", "F-15 W-09", f"""with {PLANS}, d as (select id, doc, len(json_extract(doc, '$.steps')::json[]) n, json_extract_string(doc, '$.planVersion') v, json_extract_string(doc, '$.provenance.sessionId') s from p),
s as (select id, n, unnest(json_extract(doc, '$.steps')::json[]) st, unnest(range(0, n)) pos from d),
c as (select id, pos, {_STEP_CAUSE} cause from (select id, n, pos, json_extract_string(st, '$.op') op, json_extract_string(st, '$.target') target, json_extract_string(st, '$.ref') ref, json_extract_string(st, '$.literal') literal from s)),
f as (select id, min(pos) filter (cause is not null) pos, arg_min(cause, pos) filter (cause is not null) cause from c group by id)
select d.id, case when v <> '1' then 'UNSUPPORTED_VERSION' when n < 1 or n > 8 then 'STEP_COUNT' when coalesce(s, '') = '' then 'MISSING_PROVENANCE' else coalesce(f.cause, 'OK') end verdict,
  case when v <> '1' or n < 1 or n > 8 or coalesce(s, '') = '' then null else f.pos end::int at_step from d left join f using (id)""")  # fmt: skip
def plan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First defect of every plan document, and the step that has it."""
    schema = "struct<planVersion:string,steps:array<struct<op:string,target:string,ref:string,literal:string>>,provenance:struct<requestId:string,sessionId:string,viewId:string>>"
    d = run_sql(spark, sf_dir, f"with {PLANS} select * from p").select("id", F.from_json("doc", schema).alias("d")).withColumn("n", F.size("d.steps"))
    s = F.transform("d.steps", lambda x, i: F.struct(i.alias("at"), x.alias("s")))
    d = d.withColumn("rows", s)
    causes = F.expr(f"filter(transform(rows, r -> named_struct('at', r.at, 'cause', {_STEP_CAUSE.replace('op ', 'r.s.op ').replace('target ', 'r.s.target ').replace('ref ', 'r.s.ref ').replace('literal ', 'r.s.literal ')})), c -> c.cause is not null)")
    d = d.withColumn("bad", F.try_element_at(causes, F.lit(1)))
    head = F.when(F.col("d.planVersion") != "1", "UNSUPPORTED_VERSION").when(~F.col("n").between(1, 8), "STEP_COUNT").when(F.coalesce("d.provenance.sessionId", F.lit("")) == "", "MISSING_PROVENANCE")
    return d.select("id", F.coalesce(head, "bad.cause", F.lit("OK")).alias("verdict"), F.when(head.isNull(), F.col("bad.at")).alias("at_step"))


URLS = r"""u as (select page_id id, case page_id % 6 when 0 then 'http://127.0.0.1:8080/x' when 1 then 'https://localhost/p' when 2 then 'ftp://localhost/p' when 3 then 'not a url' else url end d from pages)"""
both(
    "loopback_destinations", "F-17",
    f"""with {URLS} select id, coalesce(try_parse_url(d, 'HOST') in ('127.0.0.1', 'localhost', '::1', '[::1]') and try_parse_url(d, 'PROTOCOL') in ('http', 'https'), false) loopback,
  case when id % 13 = 0 then 'HANDOFF_NOT_VERIFIED' when not coalesce(try_parse_url(d, 'HOST') in ('127.0.0.1', 'localhost', '::1', '[::1]') and try_parse_url(d, 'PROTOCOL') in ('http', 'https'), false) then 'DESTINATION_NOT_LOOPBACK' when id % 7 = 0 then 'UNDECLARED_TOKEN' when id % 5 = 0 then 'VAULT_VALUE_IN_PAYLOAD' else 'SENT' end status from u""",
    rf"""with {URLS}, v as (select id, regexp_matches(d, '^https?://(127\.0\.0\.1|localhost|\[::1\])([:/?#]|$)') loopback from u)
select id, loopback, case when id % 13 = 0 then 'HANDOFF_NOT_VERIFIED' when not loopback then 'DESTINATION_NOT_LOOPBACK' when id % 7 = 0 then 'UNDECLARED_TOKEN' when id % 5 = 0 then 'VAULT_VALUE_IN_PAYLOAD' else 'SENT' end status from v""",
)

both("element_graph", "J-01", """with n as (select p_partkey id, case when p_partkey % 10 = 0 then null else cast(floor(p_partkey / 10) as bigint) * 10 end parent, p_name name, p_size size from part),
k as (select parent, count(*) kids, min(id) first_kid, max(id) last_kid from n where parent is not null group by parent)
select n.id, n.parent, p.name parent_name, coalesce(k.kids, 0) kids, k.first_kid, k.last_kid, case when n.name like '%red%' then 'CONFIRM' when n.name like '%blue%' then 'WARN' else 'NONE' end tier from n left join n p on p.id = n.parent left join k on k.parent = n.id""")  # fmt: skip

both(
    "visual_regions", "W-02",
    r"""with l as (select page_id, posexplode(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as (i, href) from pages) select page_id, 'link:' || cast(i as string) id, href, length(href) n from l where href <> ''""",
    r"""with l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) href, unnest(range(0, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) i from pages) select page_id, 'link:' || i id, href, length(href)::int n from l where href <> ''""",
)

both("deterministic_prefix", "S-03", """with r as (select doc_id, lang, row_number() over (partition by lang order by doc_id) rn from documents) select lang, doc_id from r where rn <= 7""")
