"""Sanitising as one chain: fields are classified and stored, element names scrubbed, the handoff put together, checked, and entered in the ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.functions import pii
from quillon.operators.automaton import LEAST, held
from quillon.plans.privacy import DUCK_CLASSIFIED, FIELDS, TODAY, classified_fields, fields
from quillon.registry import query, run_sql
from quillon.streaming.runs import shared_dir

#: Customers of one observation: a page with their fields, and their orders as its elements.
PAGE = 40
_FIELDS = FIELDS.replace("c_nationkey session", f"cast(floor(c_custkey / {PAGE}) as bigint) session")
_DUCK = DUCK_CLASSIFIED.replace("c_nationkey session", f"cast(floor(c_custkey / {PAGE}) as bigint) session")
# Elements of a page: some carry a customer's value, as it is or written another way, some a value that is nobody's, most plain words.
_ELEMENTS = f"""el as (select o_orderkey id, cast(floor(o_custkey / {PAGE}) as bigint) session, case o_orderkey % 3 when 0 then 'button' when 1 then 'link' else 'text' end role,
  case o_orderkey % 7 when 0 then 'Call ' || fv.value || ' today' when 1 then 'Submit order' when 2 then '98765' || lpad(cast(o_orderkey % 100000 as string), 5, '0') when 3 then '' when 4 then 'ID:' || replace(fv.value, ' ', '-') when 5 then 'Order ' || cast(o_orderkey as string) else fv.value end name,
  o_orderkey % 5 <> 0 enabled, case o_orderkey % 4 when 0 then 'OBSERVED' when 1 then 'CLIPPED' when 2 then 'OFFSCREEN' else 'UNKNOWN' end evidence, o_orderkey % 300 x, o_orderkey % 200 y, o_orderkey % 11 = 0 relabelled
  from orders join fv on fv.id = o_custkey)"""
# A page's goal, the user's words: now and then blank, or with a value of the page's first field.
_GOALS = "gl as (select session, case when session % 23 = 0 then '  ' when session % 17 = 1 then 'Pay for ' || max(case when id % 40 = 0 then value end) else 'Pay the bill' end goal, max(case when session % 19 = 2 and id % 40 = 3 then 1 else 0 end) = 1 foreign_field from fv group by session)"
_HELD = rf"""st as (select id vid, session, effective cls, value, regexp_replace(translate(value, 'oOlIiSs', '0011155'), '[^0-9]', '', 'g') sd, regexp_replace(lower(value), '[^\p{{L}}\p{{N}}]', '', 'g') sl from c where ref is not null),
fold(id, session, text, d, l) as (select id, session, text, regexp_replace(translate(text, 'oOlIiSs', '0011155'), '[^0-9]', '', 'g'), regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g') from (select id, session, name as text from el union all select -1 - session, session, goal from gl) where trim(text) <> ''),
hit as (select fold.id, min({{'vid': vid, 'cls': cls}}) m from fold join st on st.session = fold.session and (value = text or (length(sd) >= {LEAST} and contains(d, sd)) or (length(sl) >= {LEAST} and contains(l, sl))) group by fold.id)"""


def _duck_class(col: str) -> str:
    """The class of a text by itself, as DUCK_CLASSIFIED finds it for fields."""
    from quillon.plans.privacy import DUCK_VERHOEFF

    d = f"regexp_replace({col}, '[\\s-]', '', 'g')"
    return f"""case when coalesce(case when regexp_full_match({d}, '[2-9][0-9]{{11}}') then {DUCK_VERHOEFF.replace('(d)', f'({d})')} end, false) then 'AADHAAR'
  when regexp_full_match({d}, '[6-9][0-9]{{9}}') or regexp_full_match({d}, '(\\+91|0091|91|0)[6-9][0-9]{{9}}') then 'PHONE' when coalesce(case when regexp_full_match(trim({col}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(trim({col}) as date) between date '1900-01-01' and date '{TODAY}' end, false) then 'DOB'
  when length(trim({col})) between 3 and 60 and regexp_full_match(trim({col}), '\\p{{Lu}}\\p{{L}}+(\\s+\\p{{Lu}}\\p{{L}}+){{1,3}}') then 'NAME' else 'UNKNOWN' end"""


_SCRUBBED = f"""{_DUCK}, fv as (select * from c), {_ELEMENTS}, {_GOALS}, {_HELD.replace('{{', '{').replace('}}', '}')},
el2 as (select *, regexp_replace(name, '[\\s-]', '', 'g') d from el),
sc as (select el2.*, hit.m.cls held_class, {_duck_class('name')} own_class from el2 left join hit on hit.id = el2.id),
sn as (select *, coalesce(held_class, nullif(own_class, 'UNKNOWN')) scrub, case when coalesce(held_class, nullif(own_class, 'UNKNOWN')) is not null then '⟨redacted:' || coalesce(held_class, own_class) || '⟩' else name end shown from sc)"""


def tables(spark: SparkSession, sf_dir: str, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(classified fields, elements, goals, what stored value each element and goal holds); fields are read and classified once, into a table."""
    classified_fields(fields(spark, sf_dir, _FIELDS)).write.parquet(f"{root}/fields")
    c = spark.read.parquet(f"{root}/fields")
    c.createOrReplaceTempView("fv")
    elements = run_sql(spark, sf_dir, f"with {_ELEMENTS} select * from el")
    goals = spark.sql(f"with {_GOALS} select * from gl")
    texts = elements.select("session", "id", F.col("name").alias("text")).union(goals.select("session", -1 - F.col("session"), "goal"))
    found = held(c.where("ref is not null").select("session", F.col("id").alias("vid"), F.col("effective").alias("cls"), "value"), texts)
    return c, elements, goals, found.select(F.col("id").alias("hid"), F.col("vid").alias("held_id"), F.col("cls").alias("held_class"))


def scrubbed(elements: DataFrame, found: DataFrame) -> DataFrame:
    """elements with scrub, the class for which a name goes, and shown, what stands in its place."""
    own = pii.classify_value(F.col("name"), TODAY)
    e = elements.join(found, F.col("id") == F.col("hid"), "left").withColumn("own_class", own)
    e = e.withColumn("scrub", F.coalesce("held_class", F.when(F.col("own_class") != "UNKNOWN", F.col("own_class"))))
    return e.withColumn("shown", F.when(F.col("scrub").isNotNull(), pii.class_marker(F.col("scrub"))).otherwise(F.col("name")))


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sanitise-{uuid.uuid4().hex}"


@query("scrubbed_names", "P-01", f"with {_SCRUBBED} select id, session, shown, scrub, held_class from sn")
def scrubbed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of elements as they may leave: none that is, contains or spells out another way a value stored for its page, and none that is such a value by itself."""
    _, elements, _, found = tables(spark, sf_dir, _root(spark))
    return scrubbed(elements, found).select("id", "session", "shown", "scrub", "held_class")


def _text(col: Column) -> Column:
    return F.regexp_replace(col, r'(["\\])', r"\\$1")


_ELEMENT_SQL = """'{"id":"#' || id || '","role":"' || role || '","name":"' || regexp_replace(shown, '(["\\\\])', '\\\\\\1', 'g') || '","source":"' || case when relabelled then 'ax' else 'dom' end || '","visible":' || (evidence in ('OBSERVED', 'CLIPPED'))::varchar || ',"offscreen":' || (evidence = 'OFFSCREEN')::varchar || ',"enabled":' || enabled::varchar || case when evidence in ('OBSERVED', 'CLIPPED') then ',"bbox":[' || x || ',' || y || ',40,12]' else '' end || '}'"""


@query("sanitised_pages", "P-02 P-03", f"""with {_SCRUBBED},
pe as (select session, count(*) n, count(scrub) scrubbed, '[' || string_agg({_ELEMENT_SQL}, ',' order by id) || ']' j from sn group by session),
pr as (select session, count(*) filter (outcome = 'TOKENISED') tokenised, count(*) filter (outcome = 'MASKED_NO_TOKEN') masked, count(*) fields, '[' || coalesce(string_agg('{{"token":"' || coalesce(ref, '') || '","class":"' || effective || '","method":"' || case when ref is null then 'masked_no_token' else 'token_reference' end || '","targetId":"#c' || id || '"}}', ',' order by id) filter (outcome <> 'NOT_SENSITIVE'), '') || ']' j from c group by session),
pp as (select pr.session, case when trim(goal) = '' then 'EMPTY_GOAL' when foreign_field then 'ORIGIN_MISMATCH' when hit.m is not null then 'VERIFY_VAULT_VALUE_IN_HANDOFF' end refused, fields, tokenised, masked, coalesce(pe.n, 0) elements, coalesce(scrubbed, 0) scrubbed_names,
  '{{"manifestVersion":"1.1","elements":' || coalesce(pe.j, '[]') || ',"goal":"' || goal || '","redactions":' || pr.j || ',"request":{{"requestId":"r' || pr.session || '"}},"verified":true}}' j from pr join gl on gl.session = pr.session left join pe on pe.session = pr.session left join hit on hit.id = -1 - pr.session)
select session, refused, fields, tokenised, masked, elements, scrubbed_names, case when refused is null then sha256(j) end handoff_sha256, case when refused is null then strlen(j) end::bigint bytes from pp
union all select -1, null, sum(fields)::bigint, sum(tokenised)::bigint, sum(masked)::bigint, sum(elements)::bigint, sum(scrubbed_names)::bigint, count(*) filter (refused is null)::varchar, sum(case when refused is null then strlen(j) end)::bigint from pp""")  # fmt: skip
def sanitised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page from its fields to its line in the ledger, or why it is refused; and a last line (session -1) with the report's sums.

    A page's handoff is one document, as large as the page. The report is observed while the ledger is written, so
    nothing is read again for it.
    """
    root = _root(spark)
    c, elements, goals, found = tables(spark, sf_dir, root)
    flag = lambda x: x.cast("string")
    seen = F.col("evidence").isin("OBSERVED", "CLIPPED")
    element = F.concat(
        F.format_string('{"id":"#%s","role":"%s","name":"%s","source":"%s","visible":%s,"offscreen":%s,"enabled":%s', "id", "role", _text(F.col("shown")), F.when(F.col("relabelled"), "ax").otherwise("dom"), flag(seen), flag(F.col("evidence") == "OFFSCREEN"), flag(F.col("enabled"))),
        F.when(seen, F.format_string(',"bbox":[%s,%s,40,12]', "x", "y")).otherwise(""), F.lit("}"),
    )
    ordered = lambda j, keep=None: F.array_join(F.array_sort(F.collect_list(F.struct("id", j.alias("j")) if keep is None else F.when(keep, F.struct("id", j.alias("j")))))["j"], ",")
    e = scrubbed(elements, found).groupBy(F.col("session").alias("es")).agg(F.count("*").alias("elements"), F.count("scrub").alias("scrubbed_names"), ordered(element).alias("ej"))
    redaction = F.format_string('{"token":"%s","class":"%s","method":"%s","targetId":"#c%s"}', F.coalesce("ref", F.lit("")), "effective", F.when(F.col("ref").isNull(), "masked_no_token").otherwise("token_reference"), "id")
    r = c.groupBy("session").agg(F.count("*").alias("fields"), F.count_if(F.col("outcome") == "TOKENISED").alias("tokenised"), F.count_if(F.col("outcome") == "MASKED_NO_TOKEN").alias("masked"), ordered(redaction, F.col("outcome") != "NOT_SENSITIVE").alias("rj"))
    p = r.join(goals.withColumnRenamed("session", "gs"), F.col("session") == F.col("gs")).join(e, F.col("session") == F.col("es"), "left").join(found.where("hid < 0"), -1 - F.col("session") == F.col("hid"), "left")
    refused = F.when(F.trim("goal") == "", "EMPTY_GOAL").when(F.col("foreign_field"), "ORIGIN_MISMATCH").when(F.col("held_id").isNotNull(), "VERIFY_VAULT_VALUE_IN_HANDOFF")
    handoff = F.format_string('{"manifestVersion":"1.1","elements":[%s],"goal":"%s","redactions":[%s],"request":{"requestId":"r%s"},"verified":true}', F.coalesce("ej", F.lit("")), "goal", "rj", "session")
    p = p.withColumn("refused", refused).withColumn("j", F.when(F.col("refused").isNull(), handoff))
    counts = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("fields", "tokenised", "masked", "elements", "scrubbed_names")]
    p = p.select("session", "refused", *counts, F.sha2("j", 256).alias("handoff_sha256"), F.octet_length("j").cast("long").alias("bytes"))
    report = Observation()
    sums = [F.sum(x).alias(x) for x in ("fields", "tokenised", "masked", "elements", "scrubbed_names", "bytes")]
    p.observe(report, *sums, F.count_if(F.col("refused").isNull()).alias("sent")).write.mode("append").parquet(f"{root}/ledger")
    t = report.get
    last = spark.range(1).select(*[F.lit(x).cast(k).alias(n) for n, x, k in (("session", -1, "long"), ("refused", None, "string"), *((x, t[x], "long") for x in ("fields", "tokenised", "masked", "elements", "scrubbed_names")), ("handoff_sha256", t["sent"], "string"), ("bytes", t["bytes"], "long"))])
    return spark.read.schema(p.schema).parquet(f"{root}/ledger").unionByName(last)
