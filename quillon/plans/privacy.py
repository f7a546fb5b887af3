"""Queries of the privacy family: classify, tokenise, preview, echo and leak checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import pii
from quillon.registry import both, query, run_sql, table

TODAY = "2024-06-30"

#: Form fields derived from customers: a value of every kind, valid and not, and the field's own description.
FIELDS = """
select c_custkey id, c_nationkey session,
  case c_custkey % 9
    when 0 then '2' || lpad(cast(c_custkey * 7919 as string), 11, '0')
    when 1 then '+91 9' || lpad(cast(c_custkey * 104729 % 1000000000 as string), 9, '0')
    when 2 then '5' || lpad(cast(c_custkey as string), 9, '0')
    when 3 then cast(1890 + c_custkey % 140 as string) || '-' || lpad(cast(c_custkey % 14 as string), 2, '0') || '-' || lpad(cast(c_custkey % 33 as string), 2, '0')
    when 4 then 'R' || repeat('a', cast(c_custkey % 5 as int)) || 'vi Kumar'
    when 5 then lpad(cast(c_custkey * 31 % 1000000 as string), 6, '0')
    when 6 then 'note ' || c_mktsegment
    when 7 then ' 2' || substr(lpad(cast(c_custkey * 7919 as string), 11, '0'), 1, 3) || ' ' || substr(lpad(cast(c_custkey * 7919 as string), 11, '0'), 4, 4) || '-' || substr(lpad(cast(c_custkey * 7919 as string), 11, '0'), 8, 4)
    else '' end as value,
  case c_custkey % 7 when 0 then 'tel' when 1 then 'one-time-code' when 2 then 'email' when 3 then 'bday' when 4 then 'NAME ' else null end as autocomplete,
  case c_custkey % 5 when 0 then 'tel' when 1 then 'text' when 2 then 'date' when 3 then 'password' else null end as type,
  case c_custkey % 11 when 0 then 'aadhaar_no' when 1 then 'mobile-number' when 2 then 'dob' when 3 then 'full_name' when 4 then 'father_name' when 5 then 'feedback' when 6 then 'otp' else null end as name,
  case c_custkey % 13 when 0 then 'Aadhaar number' when 1 then 'Mobile' when 2 then 'Date of birth' when 3 then 'Name' when 4 then 'Company name' else null end as label,
  case c_custkey % 3 when 0 then 'textarea' else 'input' end as tag
from customer
"""


def fields(spark: SparkSession, sf_dir: str, sql: str = FIELDS) -> DataFrame:
    """FIELDS, or what sql makes of them, of dealt customers: the table is a few bytes a row, so one task would read, and judge, a great many."""
    dealt = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return spark.sql(sql.replace("from customer", "from {customer}"), customer=dealt)


DUCK_VERHOEFF = f"""list_reduce(list_prepend(0, range(1, length(d) + 1)), lambda c, i: substr('{pii.VERHOEFF_D}', c * 10 + substr('{pii.VERHOEFF_P}', ((i - 1) % 8) * 10 + substr(reverse(d), i, 1)::int + 1, 1)::int + 1, 1)::int) = 0"""
DUCK_VALUE = f"""
f as ({FIELDS}), t as (select *, trim(value) tv, regexp_replace(value, '[\\s-]', '', 'g') d from f),
v as (select *, coalesce(case when regexp_full_match(d, '[2-9][0-9]{{11}}') then {DUCK_VERHOEFF} end, false) aadhaar,
  case when regexp_full_match(d, '[6-9][0-9]{{9}}') then d when regexp_full_match(d, '(\\+91|0091|91|0)[6-9][0-9]{{9}}') then right(d, 10) end mobile,
  coalesce(case when regexp_full_match(tv, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(tv as date) between date '1900-01-01' and date '{TODAY}' end, false) dob,
  length(tv) between 3 and 60 and regexp_full_match(tv, '\\p{{Lu}}\\p{{L}}+(\\s+\\p{{Lu}}\\p{{L}}+){{1,3}}') nm from t),
w as (select *, case when aadhaar then 'AADHAAR' when mobile is not null then 'PHONE' when dob then 'DOB' when nm then 'NAME' else 'UNKNOWN' end value_class from v)"""


@query("value_validators", "C-01 C-02 C-03 C-04 C-05 C-06 C-07 C-08 C-09 C-12 C-14", f"""with {DUCK_VALUE}
select id, d digits, coalesce(case when regexp_full_match(d, '[0-9]+') then {DUCK_VERHOEFF} end, false) verhoeff, aadhaar, case when aadhaar then d end aadhaar_norm, mobile, dob birth_date, nm is_name,
  regexp_full_match(tv, '[0-9]{{4,8}}') otp_shaped, regexp_replace(translate(value, 'oOlIiSs', '0011155'), '[^0-9]', '', 'g') digit_fold,
  regexp_replace(lower(value), '[^\\p{{L}}\\p{{N}}]', '', 'g') text_fold, value_class,
  case value_class when 'AADHAAR' then 'SENSITIVE' when 'UNKNOWN' then 'PUBLIC' else 'PERSONAL' end tier,
  list_position(['UNKNOWN','NAME','DOB','PHONE','AADHAAR','OTP'], value_class)::int - 1 rank, value_class <> 'UNKNOWN' tokenisable from w""")  # fmt: skip
def value_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    cls = pii.classify_value(v, TODAY)
    return fields(spark, sf_dir).select(
        "id", pii.digits_only(v).alias("digits"), pii.verhoeff_valid(pii.digits_only(v)).alias("verhoeff"), pii.is_aadhaar(v).alias("aadhaar"), pii.normalise_aadhaar(v).alias("aadhaar_norm"),
        pii.normalise_mobile(v).alias("mobile"), pii.is_birth_date(v, TODAY).alias("birth_date"), pii.is_name(v).alias("is_name"), pii.is_otp_shaped(v).alias("otp_shaped"),
        pii.digit_fold(v).alias("digit_fold"), pii.text_fold(v).alias("text_fold"), cls.alias("value_class"), pii.tier_of(cls).alias("tier"), pii.rank_of(cls).alias("rank"), pii.is_tokenisable(cls).alias("tokenisable"),
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_fields(fields(spark, sf_dir))


def classified_fields(d: DataFrame) -> DataFrame:
    """Fields with field, value and effective class, tier and outcome; ordinals per session and class in order of id."""
    fc = pii.classify_field(F.col("tag"), F.col("type"), F.col("autocomplete"), F.col("name"), F.col("label"))
    d = d.withColumn("field_class", fc).withColumn("value_class", pii.classify_value(F.col("value"), TODAY))
    plain = pii.as_class(F.col("field_class"))
    # never null, and said to be: a join on it would else ask for that where the table is read, before customers are dealt
    d = d.withColumn("effective", F.coalesce(pii.most_protective(plain, F.col("value_class")), F.lit("UNKNOWN")))
    d = d.withColumn("disagreement", (plain != "UNKNOWN") & (F.col("value_class") != "UNKNOWN") & (plain != F.col("value_class")))
    issued = pii.is_tokenisable(F.col("effective")) & (F.col("value") != "")
    d = d.withColumn("outcome", F.when(F.col("effective") == "OTP", "MASKED_NO_TOKEN").when(issued, "TOKENISED").otherwise("NOT_SENSITIVE"))
    n = F.row_number().over(Window.partitionBy("session", "effective", "outcome").orderBy("id"))
    return d.withColumn("ref", F.when(F.col("outcome") == "TOKENISED", pii.format_token(F.col("effective"), n)))


def _duck_signals(col: str) -> str:
    def q(p: str) -> str:
        return p.replace("'", "''")

    s = f"regexp_replace(coalesce({col}, ''), '[_-]+', ' ', 'g')"
    parts = [f"case when regexp_matches({s}, '{q(p)}') then '{c}' end" for c, p in pii.KEYWORDS if c != "NAME"]
    parts.append(f"case when regexp_matches({s}, '{q(dict(pii.KEYWORDS)['NAME'])}') then case when regexp_matches({s}, '{q(pii.NAME_QUALIFIER)}') then 'OTHER' else 'NAME' end end")
    return ", ".join(parts)


def _duck_map(table: dict, other: tuple, col: str) -> str:
    return f"case {' '.join(f'when {col} = {k!r} then {v!r}' for k, v in table.items())} when {col} in {other!r} then 'OTHER' end"


DUCK_CLASSIFIED = f"""{DUCK_VALUE}, s as (select *, list_distinct(list_filter([{_duck_map(pii.AUTOCOMPLETE, pii.AUTOCOMPLETE_OTHER, "lower(trim(coalesce(autocomplete, '')))")},
  {_duck_map(pii.FIELD_TYPES, pii.FIELD_TYPES_OTHER, "lower(coalesce(type, ''))")}, {_duck_signals("name")}, {_duck_signals("label")}], lambda x: x is not null)) g from w),
k as (select *, case when list_contains(g, 'OTHER') or len(g) > 1 then 'UNKNOWN' when len(g) = 1 then g[1] when tag = 'textarea' then 'FREE_TEXT' else 'UNKNOWN' end field_class from s),
m as (select *, case when field_class = 'FREE_TEXT' then 'UNKNOWN' else field_class end plain, ['UNKNOWN','NAME','DOB','PHONE','AADHAAR','OTP'] r from k),
e as (select *, case when list_position(r, value_class) > list_position(r, plain) then value_class else plain end effective, plain <> 'UNKNOWN' and value_class <> 'UNKNOWN' and plain <> value_class disagreement from m),
o as (select *, case when effective = 'OTP' then 'MASKED_NO_TOKEN' when effective <> 'UNKNOWN' and value <> '' then 'TOKENISED' else 'NOT_SENSITIVE' end outcome from e),
c as (select *, case when outcome = 'TOKENISED' then '<PII:' || effective || ':' || row_number() over (partition by session, effective, outcome order by id) || '>' end ref from o)"""


@query("classify_tokenise", "C-11 C-13 U-06 W-01 P-01 C-16", f"with {DUCK_CLASSIFIED} select id, session, field_class, value_class, effective, disagreement, outcome, ref from c")
def classify_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("id", "session", "field_class", "value_class", "effective", "disagreement", "outcome", "ref")


@query("hints_and_previews", "C-15 C-17 C-18 C-20", f"""with {DUCK_CLASSIFIED}, h as (select *, lower(trim(coalesce(autocomplete, ''))) ac, lower(trim(coalesce(type, ''))) ty from c)
select id, length(tv)::int len, case when effective = 'DOB' then 'date' when regexp_full_match(tv, '[0-9\\s-]+') then 'numeric' when regexp_full_match(tv, '[\\p{{L}}\\s.''-]+') then 'alpha' else 'alphanumeric' end kind,
  case when ac <> '' then ac when ty not in ('', 'text') then ty end field_role,
  case when effective = 'PHONE' and mobile is not null then repeat('•', 8) || right(mobile, 2) else '••••••' end preview,
  '⟨redacted:' || effective || '⟩' marker, concat_ws('|', 'sel' || id, tag, coalesce(name, '')) fingerprint from h""")  # fmt: skip
def hints_and_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = pii.hint(F.col("effective"), F.col("value"), pii.field_role(F.col("autocomplete"), F.col("type")))
    return classified(spark, sf_dir).select(
        "id", h["len"].alias("len"), h["kind"].alias("kind"), h["field_role"].alias("field_role"), pii.preview(F.col("effective"), F.col("value")).alias("preview"),
        pii.class_marker(F.col("effective")).alias("marker"), F.concat_ws("|", F.concat(F.lit("sel"), "id"), "tag", F.coalesce("name", F.lit(""))).alias("fingerprint"),
    )


def _any(patterns: tuple, col: str) -> str:
    return ", ".join(f"case when regexp_matches({col}, '{p}') then '{c}' end" for c, p in patterns)


@query("tripwire_by_lang", "F-20 F-21 A-05", f"""with d as (select lang, list_filter([{_any(pii.TRIPWIRES, "text")}], lambda x: x is not null) wires, list_filter([{_any(pii.SECRET_SHAPES, "text")}], lambda x: x is not null) secrets from documents)
select lang, count(*) n, count(*) filter (list_contains(wires, 'PHONE')) phone, count(*) filter (list_contains(wires, 'AADHAAR')) aadhaar, count(*) filter (list_contains(wires, 'DOB')) dob,
  count(*) filter (list_contains(wires, 'OTP')) otp, count(*) filter (len(secrets) > 0) secret from d group by lang""")  # fmt: skip
def tripwire_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language, and how many of them hold a shape of each sensitive class or of a secret."""
    d = table(spark, sf_dir, "documents").select("lang", pii.tripwire(F.col("text")).alias("wires"), pii.secret_shapes(F.col("text")).alias("secrets"))
    wires = [F.count_if(F.array_contains("wires", c)).alias(c.lower()) for c, _ in pii.TRIPWIRES]
    return d.groupBy("lang").agg(F.count("*").alias("n"), *wires, F.count_if(F.size("secrets") > 0).alias("secret"))


@query("literal_echo", "C-10 J-05 P-09 F-25", f"""with {DUCK_CLASSIFIED},
x as (select id, session, effective, value, regexp_replace(translate(value, 'oOlIiSs', '0011155'), '[^0-9]', '', 'g') sd, regexp_replace(lower(value), '[^\\p{{L}}\\p{{N}}]', '', 'g') st from c where ref is not null),
l as (select id lid, session ls, 'please use ' || value || ' for ' || coalesce(name, 'it') lit, id % 4 = 0 redacted, value_class lit_class from c),
lf as (select *, regexp_replace(translate(lit, 'oOlIiSs', '0011155'), '[^0-9]', '', 'g') ld, regexp_replace(lower(lit), '[^\\p{{L}}\\p{{N}}]', '', 'g') lt from l),
j as (select lid, min(x.id) first_id from lf join x on ls = session and ((length(sd) >= 4 and contains(ld, sd)) or (length(st) >= 4 and contains(lt, st))) group by lid)
select lid id, j.lid is not null held, effective held_class, case when j.lid is not null then 'VAULT_LITERAL_ECHO' when redacted then 'LITERAL_AT_REDACTED_FIELD' when lit_class <> 'UNKNOWN' then 'PII_SHAPED_LITERAL' end cause,
  case when j.lid is not null then 'LEAKAGE_EVENT' when redacted or lit_class <> 'UNKNOWN' then 'PLAN_DEFECT' end severity
from lf left join j using (lid) left join x on x.id = j.first_id""")  # fmt: skip
def literal_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a session's literal echo a value stored in it? The first stored value that it holds names the class."""
    c = classified(spark, sf_dir)
    v = c.where(F.col("ref").isNotNull()).select(F.col("id").alias("vid"), F.col("session").alias("vs"), "effective", pii.digit_fold(F.col("value")).alias("sd"), pii.text_fold(F.col("value")).alias("st"))
    lit = F.concat(F.lit("please use "), "value", F.lit(" for "), F.coalesce("name", F.lit("it")))
    l = c.select("id", "session", lit.alias("lit"), (F.col("id") % 4 == 0).alias("redacted"), "value_class").withColumn("ld", pii.digit_fold(F.col("lit"))).withColumn("lt", pii.text_fold(F.col("lit")))
    # a text that holds a value holds the value's beginning: sessions meet on these grams, not every literal on every value
    def runs(c: str, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))
        return F.when(F.length(c) >= n, every).otherwise(F.array().cast("array<string>"))

    def grams(c: str) -> Column:
        return F.array_distinct(F.concat(runs(c, 4), runs(c, 8)))

    fold = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("t")) for k, c in ((0, "sd"), (1, "st"))])).alias("f")
    # of a session's equal values the first speaks for all, and equal literals are looked at once: what meets is distinct on both sides
    keyed = v.select("vid", "vs", "effective", fold).where("length(f.t) >= 4").groupBy("vs", "f.kind", "f.t").agg(F.min(F.struct("vid", "effective")).alias("v"))
    keyed = keyed.select("v", "vs", "kind", "t", F.when(F.length("t") >= 8, F.left("t", F.lit(8))).otherwise(F.left("t", F.lit(4))).alias("key"))
    said = l.select("session", F.explode(F.array(*[F.struct(F.lit(k).alias("lk"), F.col(c).alias("whole")) for k, c in ((0, "ld"), (1, "lt"))])).alias("g")).select("session", "g.lk", "g.whole").distinct()
    said = said.select("session", "lk", "whole", F.explode(grams("whole")).alias("gram"))
    met = said.join(keyed, (F.col("session") == F.col("vs")) & (F.col("lk") == F.col("kind")) & (F.col("gram") == F.col("key"))).where(F.contains("whole", F.col("t")))
    first = met.groupBy("session", "lk", "whole").agg(F.min("v").alias("v"))
    by = lambda k: first.where(F.col("lk") == k).select(F.col("session").alias(f"s{k}"), F.col("whole").alias(f"w{k}"), F.col("v").alias(f"v{k}"))
    l = l.join(by(0), (F.col("session") == F.col("s0")) & (F.col("ld") == F.col("w0")), "left").join(by(1), (F.col("session") == F.col("s1")) & (F.col("lt") == F.col("w1")), "left")
    out = l.select("id", "redacted", "value_class", F.least("v0", "v1")["effective"].alias("held_class"))
    is_held = F.col("held_class").isNotNull()
    return out.select(
        "id", is_held.alias("held"), "held_class",
        F.when(is_held, "VAULT_LITERAL_ECHO").when(F.col("redacted"), "LITERAL_AT_REDACTED_FIELD").when(F.col("value_class") != "UNKNOWN", "PII_SHAPED_LITERAL").alias("cause"),
        F.when(is_held, "LEAKAGE_EVENT").when(F.col("redacted") | (F.col("value_class") != "UNKNOWN"), "PLAN_DEFECT").alias("severity"),
    )


@query("field_fill", "P-07 J-07 U-04", f"""with {DUCK_CLASSIFIED}, r as (select session, effective cls, ref from c where ref is not null),
g as (select c.id, c.field_class accepts, list_sort(list_distinct(list(r.ref) filter (r.ref is not null))) refs from c left join r on r.session = c.session and r.cls = c.field_class and c.field_class not in ('OTP','UNKNOWN','FREE_TEXT') group by all)
select id, accepts, case when accepts = 'OTP' then 'CRITICAL_FIELD' when accepts in ('UNKNOWN', 'FREE_TEXT') then 'AMBIGUOUS_FIELD' when coalesce(len(refs), 0) = 0 then 'NO_MATCHING_REFERENCE' when len(refs) > 1 then 'CONFLICTING_REFERENCES' end cause,
  case when len(refs) = 1 then refs[1] end fill, coalesce(len(refs), 0)::int candidates from g""")  # fmt: skip
def field_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each field, taken as empty: the one reference of its session that fits, or why none is filled in.

    References are of tokenisable classes, so one of the class that the field accepts always fits (pii.field_fit).
    """
    c = classified(spark, sf_dir)
    # a session's references of a class are numbered from 1, so as many as are issued are different, and a single one is the first; they are
    # counted, not sought: a condition on the outcome would be judged where the table is read, before customers are dealt
    r = c.groupBy(F.col("session").alias("rs"), F.col("effective").alias("cls")).agg(F.count_if(F.col("outcome") == "TOKENISED").cast("int").alias("k"))
    r = r.withColumn("ref", pii.format_token(F.col("cls"), F.lit(1)))
    g = c.select("id", "session", F.col("field_class").alias("accepts")).join(r, (F.col("session") == F.col("rs")) & (F.col("accepts") == F.col("cls")), "left")
    n = F.coalesce("k", F.lit(0))
    cause = F.when(F.col("accepts") == "OTP", "CRITICAL_FIELD").when(F.col("accepts").isin("UNKNOWN", "FREE_TEXT"), "AMBIGUOUS_FIELD").when(n == 0, "NO_MATCHING_REFERENCE").when(n > 1, "CONFLICTING_REFERENCES")
    return g.select("id", "accepts", cause.alias("cause"), F.when(n == 1, F.col("ref")).alias("fill"), n.alias("candidates"))


@query("egress_ledger", "S-14 C-22 J-06 U-03 P-03", f"""with {DUCK_CLASSIFIED}, h as (select session, string_agg(id || '=' || coalesce(ref, '-'), ';' order by id) body, list_sort(list(ref) filter (ref is not null and id % 17 <> 0)) declared from c group by session),
u as (select *, list_distinct(regexp_extract_all(body, '<PII:[A-Z]+:[0-9]+>')) carried from h)
select session, sha256(body) payload_sha256, strlen(body)::int payload_bytes, len(carried)::int n_refs, len(list_filter(carried, lambda t: not list_contains(coalesce(declared, []), t)))::int undeclared, 'b' || substr(sha256(body), 1, 16) boundary from u""")  # fmt: skip
def egress_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger row per session: hash and size of the ordered payload, its references, and those never declared. A payload is hashed as its fields come, in order of id, and held by no task."""
    part = F.concat(F.col("id").cast("string"), F.lit("="), F.coalesce("ref", F.lit("-")))
    c = classified(spark, sf_dir).select("session", "id", "ref", part.alias("p"))
    h = c.repartition("session").sortWithinPartitions("session", "id").select("session", "p").mapInArrow(hashed_payloads, f"session {c.schema['session'].dataType.simpleString()}, payload_sha256 string, payload_bytes int")
    r = c.where("ref is not null").groupBy("session", "ref").agg(F.bool_or(F.col("id") % 17 != 0).alias("declared"))
    r = r.groupBy(F.col("session").alias("rs")).agg(F.count("*").alias("n_refs"), F.count_if(~F.col("declared")).alias("undeclared"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("int").alias(x)
    return h.join(r, F.col("session").eqNullSafe(F.col("rs")), "left").select("session", "payload_sha256", "payload_bytes", zero("n_refs"), zero("undeclared"), F.concat(F.lit("b"), F.substring("payload_sha256", 1, 16)).alias("boundary"))


def hashed_payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """session, hash and size of the parts (session, p) that follow each other in a session, joined by semicolons; null parts are left out."""
    def row() -> pa.RecordBatch:
        none = not size
        return pa.RecordBatch.from_arrays([pa.array([own], kind), pa.array([None if none else digest.hexdigest()], pa.string()), pa.array([None if none else size], pa.int32())], ["session", "payload_sha256", "payload_bytes"])

    begun, own, digest, size = False, None, None, 0
    for b in batches:
        kind = b.column(0).type
        for session, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not begun or session != own:
                if begun:
                    yield row()
                begun, own, digest, size = True, session, hashlib.sha256(), 0
            if p is not None:
                piece = (b";" if size else b"") + p.encode()
                digest.update(piece)
                size += len(piece)
    if begun:
        yield row()


both(
    "conversation_leaks", "W-07 C-19",
    """select conv_id, turn, lower(trim(regexp_replace(text, '\\\\s+', ' '))) norm_label, length(text) n, coalesce(text = lag(text) over (partition by conv_id order by turn), false) repeated,
  regexp_like(role, '^(user|human)$') is_user from conversations""",
    r"""select conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) norm_label, length(text)::int n, coalesce(text = lag(text) over (partition by conv_id order by turn), false) repeated,
  regexp_matches(role, '^(user|human)$') is_user from conversations""",
)
