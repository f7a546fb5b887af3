"""What became of a planner's answer, and whether another planner may answer in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.records import kind_of, text_at
from quillon.plans.actions import plan_checks
from quillon.registry import ORACLES, query, run_sql

# Refusals of a plan that say that something is wrong which a second plan would only hide.
HOSTILE_CAUSES = ("LITERAL_REFUSED", "PRIVACY_REFUSED", "NOT_A_PARSED_PLAN", "REFERENCE_NOT_GROUNDED")
#: As plan_checks names them, which calls the last one otherwise.
HOSTILE_REFUSALS = (*HOSTILE_CAUSES, "NOT_THE_GROUNDED_REFERENCE")
#: Responses as they were recorded, one for each event: nothing came, for one reason or another, or something did, of whatever kind.
_RESPONSES = """rs as (select event_id id, case when event_type = 'error' then '{"received":false,"cause":' || case when value < 10 then '"REASONER_TIMEOUT"' when value < 20 then 'null' else '"REASONER_THREW"' end || '}'
  else '{"received":true' || case event_id % 11 when 0 then '' when 1 then ',"raw":null' when 2 then ',"raw":"plan"' when 3 then ',"raw":7' when 4 then ',"raw":[1]' when 5 then ',"raw":true' else ',"raw":{"steps":[' || cast(user_id as string) || ']}' end || ',"elapsedMs":' || cast(cast(floor(value * 10) as bigint) as string) || '}' end j from events)"""


@query("planner_outcomes", "P-16 F-23", f"""with pc as ({ORACLES['plan_checks']}), {_RESPONSES},
o as (select rs.id, j, pc.verdict, case when not (j->>'$.received')::boolean then case when j->>'$.cause' = 'REASONER_TIMEOUT' then 'TIMEOUT' else 'UNAVAILABLE' end when coalesce(json_type(j, '$.raw'), 'NULL') = 'NULL' then 'UNAVAILABLE' when json_type(j, '$.raw') not in ('OBJECT', 'ARRAY') then 'MALFORMED' end missed from rs left join pc on pc.plan = rs.id),
c as (select id, verdict, coalesce(missed, case when verdict in {HOSTILE_REFUSALS} then 'HOSTILE' when verdict in ('OK', 'DONE') then 'PLANNED' else 'UNUSABLE' end) outcome from o)
select id, outcome, outcome not in ('HOSTILE', 'PLANNED') fell_back, case when outcome = 'PLANNED' then 'LOCAL_MODEL' when outcome <> 'HOSTILE' then 'DETERMINISTIC_FALLBACK' end planner, case when outcome in ('HOSTILE', 'UNUSABLE') then verdict end refusal from c""")  # fmt: skip
def planner_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each response what came of it: nothing usable, a plan that the checks of plans refuse (hostile or only unusable; no plan is unusable too), or one to run; and who plans then."""
    r = run_sql(spark, sf_dir, f"with {_RESPONSES} select * from rs").select("id", F.try_parse_json("j").alias("v"))
    v = F.col("v")
    raw = F.coalesce(kind_of(v, "$.raw"), F.lit("VOID"))
    missed = F.when(~F.try_variant_get(v, "$.received", "boolean"), F.when(text_at(v, "$.cause") == "REASONER_TIMEOUT", "TIMEOUT").otherwise("UNAVAILABLE")).when(raw == "VOID", "UNAVAILABLE").when(~raw.isin("OBJECT", "ARRAY"), "MALFORMED")
    d = r.select("id", missed.alias("missed")).join(plan_checks(spark, sf_dir).select("plan", "verdict"), F.col("id") == F.col("plan"), "left")
    judged = F.when(F.col("verdict").isin(*HOSTILE_REFUSALS), "HOSTILE").when(F.col("verdict").isin("OK", "DONE"), "PLANNED").otherwise("UNUSABLE")
    d = d.select("id", "verdict", F.coalesce("missed", judged).alias("outcome"))
    at = F.col("outcome")
    return d.select("id", "outcome", (~at.isin("HOSTILE", "PLANNED")).alias("fell_back"), F.when(at == "PLANNED", "LOCAL_MODEL").when(at != "HOSTILE", "DETERMINISTIC_FALLBACK").alias("planner"), F.when(at.isin("HOSTILE", "UNUSABLE"), F.col("verdict")).alias("refusal"))
