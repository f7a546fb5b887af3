"""Secret scans over a blob ledger. DataFrame functions only.

Every version of a document is content-addressed; a blob is scanned only for the (rule, version) pairs the ledger
does not hold for it yet, and findings are joined back to every path that ever had the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.base import cut, shared_dir, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A pattern; matches are leftmost and do not overlap, and count if the given group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values of the contract: kinds in their order, patterns and least lengths.
#: Case folding is spelt out, as engines differ on which other letters fold to ASCII ones.
BASE_RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # a run of 16 or more is found whole either way; short runs never list
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"://[A-Za-z0-9._%+-]+:[^\x20\x09-\x0D/@:]{6,}@"),
)
RULES = BASE_RULES + MORE_RULES
#: Rows with less to scan than every rule are broadcast up to so many.
BROADCAST_ROWS = 500_000


def found_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, kind, end>> of the rule's counting matches, in code points.

    The pieces between matches and the matches themselves add up to the text, so running sums of their lengths are
    the places. The costly form runs only on texts with a match.
    """
    p = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = whole if rule.group == 0 else F.regexp_extract_all(text, p, F.lit(rule.group))
    gaps = F.slice(F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s)), 1, F.size(whole))
    items = F.arrays_zip(gaps.alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("len"), F.transform(value, lambda m: F.length(m)).alias("val"))
    kind = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["val"] >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(rule.pattern), F.aggregate(items, empty, step, lambda acc: acc["spans"])).otherwise(F.array().cast(kind))


def content_addressed(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, blob (SHA-256 of the whole text; null counts as empty), body."""
    body = text_or_empty(text_col)
    return versions.select(F.col(path_col).alias("path"), body.alias("body")).withColumn("blob", F.sha2("body", 256))


LEDGER = "blob string, pairs array<string>"


def unseen(versions: DataFrame, ledger: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(what is left to scan: path, blob, body, todo; what the ledger then holds more: blob, pairs).

    todo has the rules, at their versions, that the ledger does not hold for the blob. Of equal versions the one with the
    smallest path (null last) is scanned, of rows repeated with one path each, as nothing tells them apart. All of
    this is found from hashes. Rows with less to scan than every rule are listed: the list is broadcast up to
    BROADCAST_ROWS rows, so that texts need not move, and joined beyond it. What is scanned depends on a column of the
    list, so no filter on findings can be moved below the join and scan the rest after all.
    """
    pairs = F.array(*[F.lit(r.pair) for r in rules])
    rows = content_addressed(versions, path_col, text_col)
    one = rows.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path")).alias("first"), F.count("*").alias("copies"))
    held = ledger.groupBy(F.col("blob").alias("held_blob")).agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("held"))
    one = one.join(held, F.col("blob") == F.col("held_blob"), "left").drop("held_blob")
    one = cut(one.select("blob", F.col("first.path").alias("first"), "copies", F.array_except(pairs, F.coalesce("held", F.array().cast("array<string>"))).alias("rest")), "blobs")
    odd = one.where((F.col("copies") > 1) | (F.size("rest") < len(rules))).select(F.col("blob").alias("odd_blob"), "first", "rest")
    listed = content_addressed(versions, path_col, text_col).select("path", "blob").distinct().join(odd, F.col("blob") == F.col("odd_blob"))
    listed = listed.withColumn("todo", F.when(F.col("path").eqNullSafe(F.col("first")), F.col("rest")).otherwise(F.array().cast("array<string>"))).where(F.size("todo") < len(rules))
    listed = cut(listed.select(F.col("path").alias("odd_path"), "odd_blob", "todo"), "seen-paths")
    listed = F.broadcast(listed) if listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else listed
    left = rows.join(listed, (F.col("blob") == F.col("odd_blob")) & F.col("path").eqNullSafe(F.col("odd_path")), "left").withColumn("todo", F.coalesce("todo", pairs))
    return left.where(F.size("todo") > 0).select("path", "blob", "body", "todo"), one.where(F.size("rest") > 0).select("blob", F.col("rest").alias("pairs"))


def scanned(left: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans (all kinds, by start, then rule order) and pairs scanned of the blobs left to scan that have any, for their todo rules alone."""
    spans = [F.when(F.array_contains("todo", r.pair), found_spans(F.col("body"), r, i)).otherwise(F.array()) for i, r in enumerate(rules)]
    return left.select("blob", F.array_sort(F.concat(*spans)).alias("spans"), F.col("todo").alias("pairs")).where(F.size("spans") > 0).dropDuplicates(["blob"])


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings: blob, spans; ledger rows to add: blob, pairs) for the blobs of versions that the ledger does not hold."""
    left, added = unseen(versions, ledger if ledger is not None else versions.sparkSession.createDataFrame([], LEDGER), path_col, text_col, rules)
    return scanned(left, rules).select("blob", "spans"), added


def update_ledger(versions: DataFrame, folder: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger in a folder does not hold, writes it there, and returns all findings: blob, spans.

    The folder has two tables: pairs (blob, pairs) and findings (blob, spans, pairs). Findings are written first: a run
    that is lost before the pairs are written scans these blobs again, and equal findings count once. Findings of a
    rule count as long as they are of its present version.
    """
    spark = versions.sparkSession
    span = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"

    def read(name: str, schema: str) -> DataFrame:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        return spark.read.schema(schema).parquet(f"{folder}/{name}") if there else spark.createDataFrame([], schema)

    left, added = unseen(versions, read("pairs", LEDGER), path_col, text_col, rules)
    scanned(left, rules).write.mode("append").parquet(f"{folder}/findings")
    added.write.mode("append").parquet(f"{folder}/pairs")
    now = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.pair)])
    found = read("findings", f"blob string, spans {span}, pairs array<string>").withColumn("spans", F.filter("spans", lambda s: F.array_contains(F.col("pairs"), now[s["kind"]])))
    return found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def findings_by_path(versions: DataFrame, findings: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, blob, spans for every row of versions; paths without findings have an empty list.

    A blob with very many paths is a hot key of this join; the findings side has one row per blob, so Spark splits it.
    """
    f = findings.select(F.concat(F.lit("b:"), "blob").alias("fb"), "spans")
    out = content_addressed(versions, path_col, text_col).select("path", "blob", F.concat(F.lit("b:"), "blob").alias("k")).join(f, F.col("k") == F.col("fb"), "left")
    return out.select("path", "blob", F.coalesce("spans", F.array().cast(findings.schema["spans"].dataType)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, by a ledger that begins empty. Null ids keep their row; repeated rows repeat; null and empty texts have none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = findings_by_path(docs, update_ledger(docs, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))

    def count(order: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["ord"] == order)).cast("long").alias(f"n_{BASE_RULES[order].kind}")

    return out.select(F.col("path").alias("doc_id"), *map(count, range(len(BASE_RULES))), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def oracle() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = [
        f"""select doc_id, {i} ord, '{r.kind}' kind, unnest(range(1, len(m) + 1)) i, p, m, v from (select doc_id, string_split_regex(t, {quoted(r.pattern)}) p,
        regexp_extract_all(t, {quoted(r.pattern)}) m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) v from d where regexp_matches(t, {quoted(r.pattern)}))"""
        for i, r in enumerate(RULES)
    ]
    least = "case ord " + " ".join(f"when {i} then {r.least}" for i, r in enumerate(RULES)) + " end"
    return f"""with d as (select doc_id, coalesce(text, '') t from documents), r as ({' union all '.join(parts)}),
s as (select doc_id, ord, kind, i, v, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint a, length(m[i]) n from r),
f as (select doc_id, ord, kind || ':' || a || ':' || (a + n) span, a from s where length(v[i]) >= {least}),
g as (select doc_id, count(*) filter (ord = 0) n_assign, count(*) filter (ord = 1) n_access, count(*) filter (ord = 2) n_hex,
  string_agg(span, ',' order by a, ord) filter (ord < {len(BASE_RULES)}) base, string_agg(span, ',' order by a, ord) spans from f group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join g on d.doc_id = g.doc_id"""
