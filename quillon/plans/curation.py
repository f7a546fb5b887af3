"""Dataset curation: seeded numbers, allocation, leakage, layouts, coverage, gates, builds and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.tiles import near_layouts
from quillon.plans.boxes import BOXES, inter, iou
from quillon.plans.detection import gt
from quillon.registry import both, query, table

M32 = 4294967295


def _imul(a: str, b: str) -> str:
    """Product of two 32-bit numbers modulo 2**32 without leaving 64 bits."""
    return f"(((({a}) & 65535) * ({b}) + (((({a}) >> 16) * ({b})) & 65535) * 65536) & {M32})"


def mulberry(seed: str, duck: bool) -> str:
    """A subquery's columns t1 to t3 in turn: the i-th number of the seeded stream needs no state, only seed + (i + 1) * step."""

    def xor(a: str, b: str) -> str:
        return f"xor({a}, {b})" if duck else f"(({a}) ^ ({b}))"

    t1 = _imul(xor("a", "(a >> 15)"), "(a | 1)")
    t2 = xor("t1", f"((t1 + {_imul(xor('t1', '(t1 >> 7)'), '(t1 | 61)')}) & {M32})")
    return f"""q0 as (select *, ({seed}) & {M32} a from idx), q1 as (select *, {t1} t1 from q0), q2 as (select *, {t2} t2 from q1), rnd as (select *, cast({xor('t2', '(t2 >> 14)')} as double) / 4294967296 u from q2)"""


SEED_IDX = "idx as (select p_partkey id, p_partkey % 3 split, cast(floor(p_partkey / 3) as bigint) i from part)"
SEED = "42 + split * 1000000 + i + 1831565813"
for _n, _body in (("seeded_numbers", "select id, a, round(u, 12) u from rnd"), ("seeded_samples", """select id, case split when 0 then 'train' when 1 then 'dev' else 'test' end || '-' || lpad(cast(i as string), 4, '0') sample_id, case i % 3 when 0 then 'sparse' when 1 then 'normal' else 'dense' end density,
  round((u - 0.5) * 6, 6) jitter, 40 + round((u - 0.5) * 6, 6) + 12 x, case when 40 + (u - 0.5) * 6 + 122 <= 1024 then 'VISIBLE' else 'CLIPPED' end visibility, 52 + round((u - 0.5) * 6, 6) + 20 shifted_x, case when split = 1 then 'icon' else 'button' end swapped from rnd""")):  # fmt: skip
    both(_n, "C-24" if _n == "seeded_numbers" else "D-01 C-26", f"with {SEED_IDX}, {mulberry(SEED, False)} {_body}", f"with {SEED_IDX}, {mulberry(SEED, True)} {_body}".replace("0.5", "0.5::double"))


@query("fnv_hash", "C-23 C-21", """with recursive p as (select p_partkey id, p_name t from part), w as (select id, t, 1 i, 2166136261::bigint h from p union all select id, t, i + 1, (xor(h, ascii(substr(t, i, 1)) & 255) * 16777619) & 4294967295 from w where i <= length(t))
select id, printf('%08x', h) fnv from w where i = length(t) + 1""")  # fmt: skip
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit FNV-1a of each name, folded over its characters."""
    t = F.col("p_name")

    def step(h: Column, i: Column) -> Column:
        return (h.bitwiseXOR(F.ascii(F.substr(t, i, F.lit(1))).cast("bigint").bitwiseAND(F.lit(255))) * 16777619).bitwiseAND(F.lit(M32))

    h = F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(2166136261).cast("bigint"), step)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(F.lpad(F.hex(F.when(F.length(t) > 0, h).otherwise(2166136261)), 8, "0")).alias("fnv"))


both("capped_allocation", "D-06", """with w as (select c_nationkey k, count(*) weight from customer group by 1), t as (select count(*) n, sum(weight) total from w),
s as (select w.k, w.weight, t.n, row_number() over (order by w.weight desc, w.k) rn, sum(w.weight) over (order by w.weight, w.k desc rows between unbounded preceding and current row) rest_w from w cross join t),
l as (select *, 6 as extra_cap, n * 3 rest, cast(n * 3 - (rn - 1) * 6 as double) / rest_w lam from s),
pick as (select min(rn) first_free from l where lam * weight < extra_cap), lam as (select l.lam, p.first_free from l join pick p on l.rn = p.first_free),
r as (select l.k, l.weight, l.rest, l.extra_cap, l.rn < lam.first_free fixed, case when l.rn < lam.first_free then cast(l.extra_cap as double) else lam.lam * l.weight end re from l cross join lam),
f as (select *, cast(floor(re) as bigint) base, row_number() over (partition by fixed order by re - floor(re) desc, k) ord, sum(cast(floor(re) as bigint)) over () given from r)
select k, weight, base + case when not fixed and ord <= rest - given then 1 else 0 end + 1 targets from f""")  # fmt: skip

@query("quota_expansion", "D-07", """with q as (select p_brand cls, p_type bucket, count(*) % 7 n from part group by 1, 2), t as (select cls, bucket, unnest(generate_series(1, n)) k from q where n > 0), o as (select *, row_number() over (order by cls, bucket, k) - 1 pos from t)
select cls, bucket, k, cast(floor(pos / 8) as bigint) sample, cast(pos % 8 as integer) place from o""")  # fmt: skip
def quota_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets in order of class, bucket and number, dealt to samples of eight places. Only the schedule's cells are numbered together, not their targets."""
    q = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cls"), F.col("p_type").alias("bucket")).agg((F.count("*") % 7).alias("n")).where("n > 0")
    before = F.coalesce(F.sum("n").over(Window.orderBy("cls", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = q.withColumn("before", before).select("cls", "bucket", "before", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    pos = F.col("before") + F.col("k") - 1
    return t.select("cls", "bucket", "k", F.floor(pos / 8).alias("sample"), (pos % 8).cast("int").alias("place"))


_SHA = "sha2(text, 256)"
for _n, _c, _q in (
    ("split_leakage", "D-04 W-08 A-20 U-05", """with d as (select doc_id, case doc_id % 3 when 0 then 'train' when 1 then 'dev' else 'test' end split, SHA fp, source seed from documents)
select fp, count(*) n, count(distinct split) splits, min(doc_id) first_id, min(split) lo, max(split) hi, min(seed) seed from d group by fp having count(distinct split) > 1"""),
    ("compare_builds", "U-02 J-12", """with a as (select doc_id, SHA h from documents), b as (select doc_id + doc_id % 2 * 0 id, case when doc_id % 97 = 0 then 'changed' else SHA end h from documents where doc_id % 113 <> 0)
select coalesce(a.doc_id, b.id) id, case when b.id is null then 'MISSING' when a.doc_id is null then 'UNEXPECTED' else 'DIFFERENT' end kind from a full outer join b on a.doc_id = b.id where b.id is null or a.doc_id is null or a.h <> b.h"""),
    ("contamination", "D-04 U-05", """select b.item_id, count(d.doc_id) n, min(d.doc_id) first_doc from benchmark b left join documents d on SHA2D = SHA2B group by b.item_id"""),
):
    both(_n, _c, _q.replace("SHA2D", "sha2(d.text, 256)").replace("SHA2B", "sha2(b.text, 256)").replace("SHA", _SHA), _q.replace("SHA2D", "sha256(d.text)").replace("SHA2B", "sha256(b.text)").replace("SHA", "sha256(text)"))

both("class_size_coverage", "J-20 D-14 A-21", """with c as (select distinct p_brand cls from part), b as (select distinct p_type bucket from part), n as (select p_brand cls, p_type bucket, count(*) n, sum(case when p_size > 25 then 1 else 0 end) placed from part group by 1, 2)
select c.cls, b.bucket, coalesce(n.n, 0) n, coalesce(n.n, 0) < 12 missing, cast(coalesce(n.placed, 0) as bigint) placed, coalesce(n.n, 0) <> coalesce(n.placed, 0) unreconciled from c cross join b left join n on n.cls = c.cls and n.bucket = b.bucket""")  # fmt: skip

both("suspicious_repetition", "A-19", f"""with {BOXES}, s as (select count(distinct sample) n from gt), k as (select cls, cast(floor(x / 40) as bigint) gx, cast(floor(y / 40) as bigint) gy, count(distinct sample) samples from gt group by 1, 2, 3)
select cls, gx, gy, samples, samples >= 2 and samples * 10 >= s.n suspicious from k cross join s""")  # fmt: skip


#: Layouts are near if this share of the larger one's elements match at an overlap of a half.
LAYOUT_SHARE = 0.25


@query("layout_similarity", "J-11 D-10", f"""with recursive {BOXES}, n as (select sample, count(*) n from gt group by sample),
cand as (select a.sample sa, b.sample sb, a.uid i, b.uid j, {iou('a', 'b')} v from gt a join gt b on a.cls = b.cls and a.sample < b.sample and 2 * {inter('a', 'b')} >= a.w * a.h + b.w * b.h - {inter('a', 'b')}),
able as (select sa, sb from cand join n a on a.sample = sa join n b on b.sample = sb group by sa, sb having least(count(distinct i), count(distinct j)) >= {LAYOUT_SHARE} * max(greatest(a.n, b.n))),
ranked as materialized (select cand.*, row_number() over (partition by sa, sb order by v desc, i, j) rn from cand join able using (sa, sb)),
w as (select sa, sb, 0::bigint rn, []::bigint[] ui, []::bigint[] uj from ranked where rn = 1 union all select r.sa, r.sb, r.rn, case when list_contains(w.ui, r.i) or list_contains(w.uj, r.j) then w.ui else list_append(w.ui, r.i) end,
  case when list_contains(w.ui, r.i) or list_contains(w.uj, r.j) then w.uj else list_append(w.uj, r.j) end from w join ranked r on r.sa = w.sa and r.sb = w.sb and r.rn = w.rn + 1),
f as (select sa, sb, arg_max(len(ui), rn) matched from w group by sa, sb)
select sa, sb, matched::int matched, round(matched::double / greatest(a.n, b.n), 9) similarity, sa % 3 <> sb % 3 cross_split from f join n a on a.sample = sa join n b on b.sample = sb where matched >= {LAYOUT_SHARE} * greatest(a.n, b.n)""")  # fmt: skip
def layout_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of near layouts: elements matched one to one, best overlap first, as a share of the larger layout. Quadratic in the layouts, as is what it gives; each two tiles of them are compared in one task."""
    m = near_layouts(gt(spark, sf_dir), LAYOUT_SHARE)
    return m.select("sa", "sb", F.col("matched").cast("int").alias("matched"), F.round(F.col("matched") / F.col("larger"), 9).alias("similarity"), (F.col("sa") % 3 != F.col("sb") % 3).alias("cross_split"))


both("metric_regression", "A-10", """with m as (select l_linenumber cls, round(avg(case when l_returnflag = 'A' then 1.0 else 0.0 end), 6) cur, round(avg(case when l_returnflag = 'R' then 1.0 else 0.0 end), 6) base from lineitem group by 1)
select cls, cast(cur as double) cur, cast(base as double) base, cur < base - 0.02 regressed from m""".replace("avg(case", "avg(case").replace("1.0 else 0.0", "cast(1 as double) else cast(0 as double)").replace("0.02", "cast(0.02 as double)"))  # fmt: skip

# Greedy set cover over all samples: a sample covers the cells (class, size, place) of its elements. There are COVER_CELLS
# cells whatever the data, so a sample is a bit string and what is covered so far one more.
COVER_CELLS = 3 * 4 * 12
_CELL = "cls * 48 + least(cast(floor((w - 41) / 13) as bigint), 3) * 12 + least(cast(floor(x / 100) as bigint), 3) * 3 + least(cast(floor(y / 100) as bigint), 2)"


@query("greedy_cover", "K-06", f"""with recursive {BOXES}, c as materialized (select distinct sample, {_CELL} cell from gt), s as materialized (select sample, list(cell) cells from c group by sample),
w as (select 0 turn, null::bigint pick, 0::bigint covers, []::bigint[] done
  union all select w.turn + 1, b.sample, b.n, list_concat(w.done, b.fresh) from w, lateral (select sample, list_filter(cells, lambda x: not list_contains(w.done, x)) fresh, len(list_filter(cells, lambda x: not list_contains(w.done, x))) n from s order by n desc, sample limit 1) b where b.n > 0)
select turn, pick, covers from w where turn > 0""")  # fmt: skip
def greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in the order in which each covers most cells not covered yet, ties to the smaller; at most COVER_CELLS turns, each one aggregate of one row."""
    cell = F.expr(_CELL)
    words = [F.bit_or(F.when(F.floor(cell / 48) == k, F.expr(f"shiftleft(1L, cast(({_CELL}) % 48 as int))")).otherwise(0)).alias(f"w{k}") for k in range(COVER_CELLS // 48)]
    samples = gt(spark, sf_dir).groupBy("sample").agg(*words).persist()
    done, picks = [0] * len(words), []
    while True:
        fresh = sum((F.bit_count(F.col(f"w{k}").bitwiseAND(F.lit(~d))) for k, d in enumerate(done)), F.lit(0))
        best = samples.agg(F.max(F.struct(fresh.alias("n"), (-F.col("sample")).alias("s"), *[f"w{k}" for k in range(len(words))])).alias("b")).first()["b"]
        if not best or not best["n"]:
            break
        picks.append((len(picks) + 1, -best["s"], best["n"]))
        done = [d | best[f"w{k}"] for k, d in enumerate(done)]
    samples.unpersist()
    return spark.createDataFrame(picks, "turn int, pick long, covers long")


# Canonical text of a record: keys in order, no blanks. A parsed record keeps its keys in order.
@query("canonical_records", "C-21 D-03", """with r as (select event_id id, '{"a":{"t":"' || event_type || '","z":null},"k":[' || event_id % 5 || ',true,"x y"],"u":' || user_id || '}' want from events) select id, want canonical, sha256(want) seal from r""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.format_string('{ "u": %s, "k": [ %s, true, "x y" ],\n "a": {"z": null, "t": "%s"} }', F.col("user_id"), F.col("event_id") % 5, F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.to_json(F.parse_json(messy)).alias("canonical")).withColumn("seal", F.sha2("canonical", 256))


# Named streams: a seed is the digest of an identity, a stream's state that of seed and name; the first number of each.
@query("named_streams", "C-25", """with s as (select p_partkey id, sha256('["' || p_brand || '",' || p_partkey || ']') seed from part), n as (select id, seed, unnest(['place', 'style']) stream from s),
h as (select *, sha256('["' || seed || '","' || stream || '"]') h from n), b as (select *, ('0x' || substr(h, 9, 8))::bigint * 5 % 4294967296 b5 from h),
u as (select *, (((b5 << 7) % 4294967296) | (b5 >> 25)) * 9 % 4294967296 u from b) select id, stream, seed, u, (floor(u / 4294967296.0::double * 10))::bigint digit from u""")  # fmt: skip
def named_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First number of each stream: the second word of the state times five, turned by seven bits, times nine."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.sha2(F.concat(F.lit('["'), "p_brand", F.lit('",'), F.col("p_partkey").cast("string"), F.lit("]")), 256).alias("seed"))
    d = p.withColumn("stream", F.explode(F.array(F.lit("place"), F.lit("style")))).withColumn("h", F.sha2(F.concat(F.lit('["'), "seed", F.lit('","'), "stream", F.lit('"]')), 256))
    word = F.conv(F.substring("h", 9, 8), 16, 10).cast("long")
    five = (word * 5).bitwiseAND(F.lit(0xFFFFFFFF))
    turned = F.shiftleft(five, 7).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftright(five, 25))
    u = (turned * 9).bitwiseAND(F.lit(0xFFFFFFFF))
    return d.select("id", "stream", "seed", u.alias("u"), F.floor(u / 4294967296.0 * 10).alias("digit"))
