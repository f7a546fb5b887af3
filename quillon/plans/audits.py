"""Queries that reconcile, account and summarise: targets, plans against placements, projections, glyphs, noise, forms, builds, leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.geometry import Box, letterbox, pieces, union_area
from quillon.operators.matching import greedy_match
from quillon.operators.rasters import Touching, by_group
from quillon.plans.boxes import BOXES, at_least_half, inter, iou
from quillon.plans.curation import mulberry
from quillon.plans.detection import DUCK_MATCH, gt, matched, pred
from quillon.plans.records import LINES
from quillon.registry import query, run_sql, table

STRIDE, COLS, ROWS = 32, 13, 12


@query("target_cells", "M-19 D-18", f"""with {BOXES}, grid as (select c.c, r.r, c.c * 32 + 16 px, r.r * 32 + 16 py from (select unnest(range({COLS})) c) c, (select unnest(range({ROWS})) r) r),
ins as (select g.sample, g.uid, g.cls, g.w * g.h area, grid.c, grid.r from gt g join grid on px >= g.x and px <= g.x + g.w and py >= g.y and py <= g.y + g.h),
lost as (select g.* from gt g where g.uid not in (select uid from ins)), near as (select l.sample, l.uid, l.cls, l.w * l.h area, grid.c, grid.r, row_number() over (partition by l.uid order by (px - l.x - l.w / 2.0::double) ** 2 + (py - l.y - l.h / 2.0::double) ** 2, grid.r, grid.c) rn from lost l, grid),
every as (select * from ins union all select sample, uid, cls, area, c, r from near where rn = 1), k as (select *, row_number() over (partition by sample, c, r order by area desc, uid desc) rn, count(*) over (partition by sample, c, r) claims from every)
select sample, c, r, uid, cls, claims from k where rn = 1""")  # fmt: skip
def target_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element each cell of a screen is trained on: the largest whose box holds the cell's centre; an element that holds none takes the nearest cell. claims counts collisions."""
    top = F.max(F.struct("area", "uid", "cls")).alias("t")
    return claims(gt(spark, sf_dir)).groupBy("sample", "c", "r").agg(top, F.count("*").alias("claims")).select("sample", "c", "r", "t.uid", "t.cls", "claims")


def claims(g: DataFrame) -> DataFrame:
    """sample, uid, cls, area, x, y, w, h, c, r, fallback: the cells that each element claims. Elements are dealt by their screen first, so what is made per screen or cell moves no claim."""
    def centres(lo: Column, size: Column, n: int) -> Column:
        """Cells whose centre is within [lo, lo + size]."""
        first, last = F.greatest(F.ceil((lo - STRIDE / 2) / STRIDE), F.lit(0)), F.least(F.floor((lo + size - STRIDE / 2) / STRIDE), F.lit(n - 1))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def nearest(lo: Column, size: Column, n: int) -> Column:
        # of two cells as near the smaller one
        return F.greatest(F.lit(0), F.least(F.ceil((lo + size / 2) / STRIDE) - 1, F.lit(n - 1)))

    b = Box.of()
    cs, rs = centres(b.x, b.w, COLS), centres(b.y, b.h, ROWS)
    some = (F.size(cs) > 0) & (F.size(rs) > 0)
    d = g.repartition("sample").withColumn("cs", F.when(some, cs).otherwise(F.array(nearest(b.x, b.w, COLS)))).withColumn("rs", F.when(some, rs).otherwise(F.array(nearest(b.y, b.h, ROWS))))
    d = d.select("sample", "uid", "cls", *"xywh", (b.w * b.h).alias("area"), (~some).alias("fallback"), F.explode("cs").alias("c"), "rs")
    return d.select("sample", "uid", "cls", *"xywh", "area", "fallback", "c", F.explode("rs").alias("r"))


_TOUCH = f"""tb as (select sample, uid, cls, least(cast(floor((x + w / 2.0::double) / {STRIDE}) as bigint), {COLS - 1}) cc, least(cast(floor((y + h / 2.0::double) / {STRIDE}) as bigint), {ROWS - 1}) cr,
  greatest(cast(floor(x / {STRIDE}.0::double) as bigint), 0) c0, least(cast(ceil((x + w) / {STRIDE}.0::double) as bigint) - 1, {COLS - 1}) c1, greatest(cast(floor(y / {STRIDE}.0::double) as bigint), 0) r0, least(cast(ceil((y + h) / {STRIDE}.0::double) as bigint) - 1, {ROWS - 1}) r1 from gt)"""
_CLAIMS = f"""grid as (select c.c, r.r, c.c * 32 + 16 px, r.r * 32 + 16 py from (select unnest(range({COLS})) c) c, (select unnest(range({ROWS})) r) r),
ins as (select g.sample, g.uid, g.cls, g.w * g.h area, grid.c, grid.r, false fallback from gt g join grid on px >= g.x and px <= g.x + g.w and py >= g.y and py <= g.y + g.h),
lost as (select g.* from gt g where g.uid not in (select uid from ins)), near as (select l.sample, l.uid, l.cls, l.w * l.h area, grid.c, grid.r, true fallback, row_number() over (partition by l.uid order by (px - l.x - l.w / 2.0::double) ** 2 + (py - l.y - l.h / 2.0::double) ** 2, grid.r, grid.c) rn from lost l, grid),
every as (select * from ins union all select sample, uid, cls, area, c, r, fallback from near where rn = 1),
k as (select *, row_number() over (partition by sample, c, r order by area desc, uid desc) rn, count(*) over (partition by sample, c, r) n from every),
bound as (select g.uid, grid.c, grid.r, (g.w * g.h) / ((g.w + greatest(0, g.x - px, px - g.x - g.w)) * (g.h + greatest(0, g.y - py, py - g.y - g.h)))::double iou from gt g, grid),
best as (select uid, max(iou) any_cell from bound group by uid),
o as (select k.uid, any_value(k.sample) sample, any_value(k.cls) cls, any_value(k.fallback) fallback, count(*) claimed, count(*) filter (k.rn = 1) owned, bool_or(k.n > 1) collides, max(b.iou) assigned from k join bound b on b.uid = k.uid and b.c = k.c and b.r = k.r group by k.uid)"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, sample, cls, w, h, fallback, claimed, owned, collides, assigned, any_cell of every element.

    A prediction always holds its cell's centre, so of all boxes that one cell can give the best is the element's own, widened to the
    centre: that bounds the overlap a cell can reach. It is a product over the two axes, so the best cell of all is the nearest on each.
    """
    cell = Window.partitionBy("sample", "c", "r")
    k = claims(gt(spark, sf_dir)).withColumn("winner", F.max(F.struct("area", "uid")).over(cell)["uid"]).withColumn("n", F.count("*").over(cell))

    def beside(lo: Column, size: Column, at: Column) -> Column:
        return F.greatest(F.lit(0.0), lo - at, at - lo - size)

    def least_beside(lo: Column, size: Column, n: int) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: beside(lo, size, (i * STRIDE + STRIDE / 2).cast("double"))))

    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    iou = w * h / ((w + beside(x, w, F.col("c") * STRIDE + STRIDE / 2)) * (h + beside(y, h, F.col("r") * STRIDE + STRIDE / 2)))
    o = k.withColumn("iou", iou)
    any_cell = w * h / ((w + least_beside(x, w, COLS)) * (h + least_beside(y, h, ROWS)))
    o = o.groupBy("sample", "uid", "cls", "x", "y", "w", "h").agg(F.bool_or("fallback").alias("fallback"), F.count("*").alias("claimed"), F.count_if(F.col("winner") == F.col("uid")).alias("owned"), F.bool_or(F.col("n") > 1).alias("collides"), F.max("iou").alias("assigned"))
    return o.withColumn("any_cell", any_cell)


@query("assignment_pairs", "D-18", f"""with {BOXES}, {_TOUCH}, pr as (select a.sample, count(*) filter (a.cc = b.cc and a.cr = b.cr) same_centre, count(*) filter (a.cc = b.cc and a.cr = b.cr and a.cls <> b.cls) same_centre_cross,
  count(*) filter (greatest(a.c0, b.c0) <= least(a.c1, b.c1) and greatest(a.r0, b.r0) <= least(a.r1, b.r1)) touching, count(*) filter (greatest(a.c0, b.c0) <= least(a.c1, b.c1) and greatest(a.r0, b.r0) <= least(a.r1, b.r1) and a.cls <> b.cls) touching_cross
  from tb a join tb b on a.sample = b.sample and a.uid < b.uid group by a.sample)
select s.sample, coalesce(same_centre, 0) same_centre, coalesce(same_centre_cross, 0) same_centre_cross, coalesce(touching, 0) touching, coalesce(touching_cross, 0) touching_cross from (select distinct sample from gt) s left join pr on pr.sample = s.sample""")  # fmt: skip
def assignment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a screen's elements with their centres in one cell, and that touch a cell together; and how many of these are of two classes."""
    g = gt(spark, sf_dir)
    cell = lambda v, n: F.least(F.floor(v / STRIDE), F.lit(n - 1))
    low, high = (lambda v: F.greatest(F.floor(v / STRIDE), F.lit(0))), (lambda v, n: F.least(F.ceil(v / STRIDE) - 1, F.lit(n - 1)))
    x, y, w, h = (F.col(c) for c in "xywh")
    cells = {"cls": F.col("cls"), "cc": cell(x + w / 2, COLS), "cr": cell(y + h / 2, ROWS), "c0": low(x), "c1": high(x + w, COLS), "r0": low(y), "r1": high(y + h, ROWS)}
    b = g.select("sample", *[c.cast("long").alias(n) for n, c in cells.items()])
    return by_group(b, "sample", [], lambda: Touching(COLS, ROWS), "sample long, same_centre long, same_centre_cross long, touching long, touching_cross long")


@query("assignment_audit", "D-18", f"""with {BOXES}, {_CLAIMS}, z as (select o.*, best.any_cell, case when least(g.w, g.h) < 44 then 'small' when least(g.w, g.h) < 60 then 'medium' else 'large' end bucket from o join gt g on g.uid = o.uid join best on best.uid = o.uid)
select cls, bucket, count(*) objects, sum(claimed)::bigint claimed, sum(owned)::bigint owned, count(*) filter (fallback) fallback, count(*) filter (collides) in_collision, count(*) filter (owned < claimed) lost_any, count(*) filter (owned = 0) lost_all,
  round(min(assigned), 9) least_assigned_iou, round(avg(assigned), 9) mean_assigned_iou, round(min(any_cell), 9) least_iou_of_any_cell from z group by cls, bucket""")  # fmt: skip
def assignment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each class and size: cells claimed and kept, elements in collisions and those that lose some or all cells, and the overlap that their cells can reach at best."""
    o = audited(spark, sf_dir)
    short = F.least("w", "h")
    o = o.withColumn("bucket", F.when(short < 44, "small").when(short < 60, "medium").otherwise("large"))
    return o.groupBy("cls", "bucket").agg(
        F.count("*").alias("objects"), F.sum("claimed").alias("claimed"), F.sum("owned").alias("owned"), F.count_if("fallback").alias("fallback"), F.count_if("collides").alias("in_collision"),
        F.count_if(F.col("owned") < F.col("claimed")).alias("lost_any"), F.count_if(F.col("owned") == 0).alias("lost_all"), F.round(F.min("assigned"), 9).alias("least_assigned_iou"), F.round(F.avg("assigned"), 9).alias("mean_assigned_iou"),
        F.round(F.min("any_cell"), 9).alias("least_iou_of_any_cell"),
    )


@query("planned_vs_placed", "J-21 D-12", """with p as (select p_brand cls, p_size % 4 bucket, count(*) * 25 planned from part where p_size % 11 <> 0 group by 1, 2), q as (select p.p_brand cls, p.p_size % 4 bucket, count(*) placed from lineitem l join part p on p.p_partkey = l.l_partkey where p.p_size % 13 <> 0 group by 1, 2)
select coalesce(p.cls, q.cls) cls, coalesce(p.bucket, q.bucket) bucket, coalesce(planned, 0) planned, coalesce(placed, 0) placed, case when planned is null then 'UNPLANNED' when placed is null then 'MISSING' when placed < planned then 'SHORT' else 'MET' end state from p full outer join q on p.cls = q.cls and p.bucket = q.bucket""")  # fmt: skip
def planned_vs_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a plan against what was placed in them, both ways."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("cls"), (F.col("p_size") % 4).alias("bucket"), "p_size")
    p = part.where("p_size % 11 <> 0").groupBy("cls", "bucket").agg((F.count("*") * 25).alias("planned"))
    q = table(spark, sf_dir, "lineitem").select("l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).where("p_size % 13 <> 0").groupBy("cls", "bucket").agg(F.count("*").alias("placed"))
    d = p.join(q, ["cls", "bucket"], "full_outer")
    state = F.when(F.col("planned").isNull(), "UNPLANNED").when(F.col("placed").isNull(), "MISSING").when(F.col("placed") < F.col("planned"), "SHORT").otherwise("MET")
    return d.select("cls", "bucket", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("placed", F.lit(0)).alias("placed"), state.alias("state"))


@query("miss_kinds", "A-12 K-04", f"""with recursive {DUCK_MATCH}, left_ as (select * from gt where uid not in (select rid from m)), b as (select l.uid, l.cls, max(case when {inter('p', 'l')} > 0 then {iou('p', 'l')} else 0 end) anyc, max(case when p.cls = l.cls and {inter('p', 'l')} > 0 then {iou('p', 'l')} else 0 end) same from left_ l left join pred p on p.sample = l.sample group by l.uid, l.cls),
fn as (select cls, case when coalesce(anyc, 0) < 0.1 then 'noOverlapAtAll' when same < 0.5 and anyc >= 0.5 then 'overlappedWrongClass' else 'overlappedPoorLocalization' end kind from b),
fp as (select p.* from pred p where p.pid not in (select lid from m)), f as (select p.pid, p.cls, arg_max(g.cls, {iou('g', 'p')} * 1000000 - g.cls / 1000.0) seen, max({iou('g', 'p')}) anyc, max(case when g.cls = p.cls then {iou('g', 'p')} else 0 end) same from fp p join gt g on g.sample = p.sample and {inter('g', 'p')} > 0 group by p.pid, p.cls)
select 'miss' side, kind, cls::varchar who, count(*) n from fn group by all union all select 'confusion', seen || '->' || cls, cls::varchar, count(*) from f where same < 0.5 and anyc >= 0.5 and seen <> cls group by all""")  # fmt: skip
def miss_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed elements by what overlapped them, and pairs of classes that false detections confuse."""
    m = matched(spark, sf_dir)
    g, p = gt(spark, sf_dir), pred(spark, sf_dir)
    left = g.join(m.select(F.col("rid").alias("uid")), "uid", "left_anti")
    o = p.select("sample", "pid", F.col("cls").alias("pcls"), *[F.col(c).alias("o" + c) for c in "xywh"])
    a, b = Box.of(), Box.of("o")
    # per screen first, so pairs stay where the screen's join has them; an iou is 0 where nothing meets
    over = left.join(o, "sample", "left").groupBy("sample", "uid", "cls").agg(F.max(a.iou(b)).alias("any"), F.max(F.when(F.col("pcls") == F.col("cls"), a.iou(b)).otherwise(0.0)).alias("same"))
    fn = over.groupBy("uid", "cls").agg(F.max("any").alias("any"), F.max("same").alias("same")).withColumn("kind", F.when(F.coalesce("any", F.lit(0.0)) < 0.1, "noOverlapAtAll").when((F.col("same") < 0.5) & (F.col("any") >= 0.5), "overlappedWrongClass").otherwise("overlappedPoorLocalization"))
    fn = fn.groupBy(F.lit("miss").alias("side"), "kind", F.col("cls").cast("string").alias("who")).agg(F.count("*").alias("n"))
    wrong = o.join(m.select(F.col("lid").alias("pid")), "pid", "left_anti")
    f = wrong.join(g, "sample").where(a.overlap(b) > 0).groupBy("pid", "pcls").agg(F.max(F.struct(a.iou(b).alias("v"), (-F.col("cls")).alias("c"))).alias("t"), F.max(F.when(F.col("pcls") == F.col("cls"), a.iou(b)).otherwise(0.0)).alias("same"))
    f = f.withColumn("seen", -F.col("t.c")).where((F.col("same") < 0.5) & (F.col("t.v") >= 0.5) & (F.col("seen") != F.col("pcls")))
    fp = f.groupBy(F.lit("confusion").alias("side"), F.concat(F.col("seen").cast("string"), F.lit("->"), F.col("pcls").cast("string")).alias("kind"), F.col("pcls").cast("string").alias("who")).agg(F.count("*").alias("n"))
    return fn.unionByName(fp)


@query("projection_accounting", "M-08 M-03", """with h as (select event_id id, event_id * 37 % 640 cx, event_id * 53 % 640 cy, event_id % 90 w, event_id % 61 h, 600 + user_id % 5 * 100 fw, 400 + user_id % 3 * 100 fh from events), s as (select *, least(640.0::double / fw, 640.0::double / fh) sc from h), p as (select *, (640 - fw * sc) / 2 px, (640 - fh * sc) / 2 py from s),
b as (select *, (cx - w / 2.0::double - px) / sc x0, (cy - h / 2.0::double - py) / sc y0, w / sc bw, h / sc bh from p), c as (select *, greatest(x0, 0) qx, greatest(y0, 0) qy, least(x0 + bw, fw) - greatest(x0, 0) qw, least(y0 + bh, fh) - greatest(y0, 0) qh from b)
select id, case when w <= 0 or h <= 0 then 'DEGENERATE' when cx < px or cx > px + fw * sc or cy < py or cy > py + fh * sc then 'IN_PADDING' when qw <= 0 or qh <= 0 then 'OUTSIDE' when qw < bw - 1e-9 or qh < bh - 1e-9 then 'CLIPPED' else 'WHOLE' end kind,
  round(qx / 1.25::double, 6) css_x, round((qy + 10) / 1.25::double, 6) document_y from c""")  # fmt: skip
def projection_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the model's square back on the captures, with what became of each; capture to CSS and document pixels."""
    e = table(spark, sf_dir, "events")
    d = e.select(F.col("event_id").alias("id"), *[(x).alias(n) for n, x in (("cx", F.col("event_id") * 37 % 640), ("cy", F.col("event_id") * 53 % 640), ("w", F.col("event_id") % 90), ("h", F.col("event_id") % 61), ("fw", F.col("user_id") % 5 * 100 + 600), ("fh", F.col("user_id") % 3 * 100 + 400))])
    scale, px, py = letterbox(F.col("fw"), F.col("fh"), 640)
    box = Box((F.col("cx") - F.col("w") / 2.0 - px) / scale, (F.col("cy") - F.col("h") / 2.0 - py) / scale, F.col("w") / scale, F.col("h") / scale)
    shown = box.clipped(Box(F.lit(0), F.lit(0), F.col("fw"), F.col("fh")))
    padding = (F.col("cx") < px) | (F.col("cx") > px + F.col("fw") * scale) | (F.col("cy") < py) | (F.col("cy") > py + F.col("fh") * scale)
    kind = F.when((F.col("w") <= 0) | (F.col("h") <= 0), "DEGENERATE").when(padding, "IN_PADDING").when((shown.w <= 0) | (shown.h <= 0), "OUTSIDE").when((shown.w < box.w - 1e-9) | (shown.h < box.h - 1e-9), "CLIPPED").otherwise("WHOLE")
    return d.select("id", kind.alias("kind"), F.round(shown.x / 1.25, 6).alias("css_x"), F.round((shown.y + 10) / 1.25, 6).alias("document_y"))


@query("glyph_cover", "M-11 M-12 A-22", f"""with {BOXES}, gl as (select uid, sample, x + 4 x, y + 4 y, least(w - 8, 14) w, 9 h from gt where cls = 2), mk as (select sample, x, y, w, h from pred where conf >= 20),
px as (select distinct g.uid, a.a, b.b from gl g join mk k on k.sample = g.sample and {inter('k', 'g')} > 0, lateral (select unnest(range(greatest(g.x, k.x), least(g.x + g.w, k.x + k.w))) a) a, lateral (select unnest(range(greatest(g.y, k.y), least(g.y + g.h, k.y + k.h))) b) b),
c as (select uid, count(*) covered, count(*) filter (not (a >= 100 and a < 300 and b >= 50 and b < 250)) outside from px group by uid)
select g.sample, count(*) glyphs, count(*) filter (coalesce(c.covered, 0) >= g.w * g.h) masked, count(*) filter (coalesce(c.covered, 0) < g.w * g.h) exposed, coalesce(sum(c.covered), 0)::bigint covered, coalesce(sum(c.outside), 0)::bigint outside from gl g left join c on c.uid = g.uid group by g.sample""")  # fmt: skip
def glyph_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs that the union of the masks covers wholly, and how much of the cover lies outside an excluded rectangle."""
    g = gt(spark, sf_dir).where("cls = 2").select("uid", "sample", (F.col("x") + 4).alias("x"), (F.col("y") + 4).alias("y"), F.least(F.col("w") - 8, F.lit(14)).alias("w"), F.lit(9).cast("long").alias("h"))
    k = pred(spark, sf_dir).where("conf >= 20").groupBy("sample").agg(F.collect_list(F.struct(*"xywh")).alias("masks"))
    b, hole = Box.of(), Box(F.lit(100), F.lit(50), F.lit(200), F.lit(200))
    d = g.join(k, "sample", "left").withColumn("parts", F.transform(F.filter("masks", lambda m: Box.within(m).overlap(b) > 0), lambda m: Box.within(m).clipped(b).struct()))
    d = d.withColumn("covered", F.coalesce(union_area(F.col("parts")), F.lit(0)))
    rest = F.flatten(F.transform("parts", lambda m: F.transform(pieces(Box.within(m), hole), lambda s: F.struct(*[s[c].cast("long").alias(c) for c in "xywh"]))))
    d = d.withColumn("outside", F.coalesce(union_area(rest), F.lit(0)))
    whole = F.col("covered") >= F.col("w") * F.col("h") - 1e-6
    return d.groupBy("sample").agg(F.count("*").alias("glyphs"), F.count_if(whole).alias("masked"), F.count_if(~whole).alias("exposed"), F.sum("covered").alias("covered"), F.sum("outside").alias("outside"))


_TRIALS = "idx as (select p_partkey id, p_retailprice v, t, l from part cross join (values (0), (1), (2)) tl(t) cross join (values (1), (100), (10000)) ll(l))"
_SEED = "l * 1000 + t * 7919 + (id + 1) * 1831565813"


@query("noise_trials", "E-10", f"""with {_TRIALS}, {mulberry(_SEED, True)},
p as (select l, t, v::float o, (v * (1 + (u * 2 - 1) * (l / 1e9::double)))::float n from rnd) select l level_, count(distinct t) trials, count(*) values_, count(*) filter (n <> o) changed, count(*) filter (abs(n - o) > o * 2e-6::double) noticed from p group by l""")  # fmt: skip
def noise_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded relative noise on single-precision values, by level: how many change at all. The generator's state after k numbers is known, so no trial waits for another."""
    d = run_sql(spark, sf_dir, f"with {_TRIALS}, {mulberry(_SEED, False)} select * from rnd")
    old, new = F.col("v").cast("float"), (F.col("v") * (1 + (F.col("u") * 2 - 1) * (F.col("l") / 1e9))).cast("float")
    return d.groupBy(F.col("l").alias("level_")).agg(F.countDistinct("t").alias("trials"), F.count("*").alias("values_"), F.count_if(new != old).alias("changed"), F.count_if(F.abs(new - old).cast("double") > old.cast("double") * 2e-6).alias("noticed"))


_FORMS = """fm as (select c_custkey id, 'https://h' || cast(c_nationkey as string) || '.example' origin, '<form><label for="a' || cast(c_custkey as string) || '">Phone</label><input id="a' || cast(c_custkey as string) || '" type="tel" autocomplete="tel" value="98765' || cast(10000 + c_custkey % 90000 as string) || '">' ||
  case when c_acctbal < 0 then '<input type="hidden" id="h" value="x"><select id="s"><option>1</option></select>' else '<textarea id="t">note</textarea><canvas id="c" width="' || cast(c_custkey % 300 as string) || '" height="40"></canvas><img src="a.png" width="0">' end || '</form>' html from customer)"""
_FIELD = r"""<(input|textarea|select)([^>]*)>"""


@query("form_fields", "S-07 S-08", rf"""with {_FORMS}, f as (select id, origin, html, unnest(regexp_extract_all(html, '{_FIELD}', 2)) a, unnest(regexp_extract_all(html, '{_FIELD}', 1)) tag, unnest(range(len(regexp_extract_all(html, '{_FIELD}')))) n from fm),
x as (select id, origin, html, tag, n, regexp_extract(a, ' id="([^"]*)"', 1) el, regexp_extract(a, ' type="([^"]*)"', 1) type_, regexp_extract(a, ' value="([^"]*)"', 1) value_, regexp_extract(a, ' autocomplete="([^"]*)"', 1) ac from f where not contains(a, 'type="hidden"'))
select id, '#' || el selector, tag, type_, ac autocomplete, coalesce(regexp_extract(html, '<label for="' || el || '">([^<]*)</label>', 1), '') label, case when tag = 'textarea' then regexp_extract(html, '<textarea[^>]*>([^<]*)</textarea>', 1) else value_ end value_, origin,
  len(regexp_extract_all(html, '<canvas[^>]* width="[1-9][0-9]*" height="[1-9][0-9]*"')) + len(regexp_extract_all(html, '<img[^>]* width="[1-9][0-9]*"')) regions from x""")  # fmt: skip
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of forms that hold values, with what names them, and how many canvases and images of a page have pixels."""
    d = run_sql(spark, sf_dir, f"with {_FORMS} select * from fm")
    tags = F.regexp_extract_all("html", F.lit(_FIELD), F.lit(0))
    d = d.select("id", "origin", "html", F.explode(tags).alias("t")).where(~F.contains("t", F.lit('type="hidden"')))

    def attribute(name: str) -> Column:
        return F.regexp_extract("t", rf' {name}="([^"]*)"', 1)

    tag, el = F.regexp_extract("t", _FIELD, 1), attribute("id")
    opening = F.concat(F.lit('<label for="'), el, F.lit('">'))
    label = F.when(F.contains("html", opening), F.split_part(F.split_part("html", opening, F.lit(2)), F.lit("</label>"), F.lit(1))).otherwise("")
    value = F.when(tag == "textarea", F.regexp_extract("html", "<textarea[^>]*>([^<]*)</textarea>", 1)).otherwise(attribute("value"))
    seen = F.regexp_count("html", F.lit('<canvas[^>]* width="[1-9][0-9]*" height="[1-9][0-9]*"')) + F.regexp_count("html", F.lit('<img[^>]* width="[1-9][0-9]*"'))
    return d.select("id", F.concat(F.lit("#"), el).alias("selector"), tag.alias("tag"), attribute("type").alias("type_"), attribute("autocomplete").alias("autocomplete"), label.alias("label"), value.alias("value_"), "origin", seen.cast("long").alias("regions"))


@query("build_differences", "D-16 U-02 J-12", f"""with {LINES}, a as (select l_orderkey id, l_linenumber n, l_partkey pk, l_quantity q, l_tax t from li), b as (select id, n, pk, case when pk % 41 = 0 then q + 1 else q end q, case when id % 53 = 0 then 0 else t end t from a where pk % 97 <> 0 union all select id + 1000000000, n, pk, q, t from a where pk % 101 = 0)
select coalesce(a.id, b.id) id, coalesce(a.n, b.n)::bigint n, case when b.id is null then 'MISSING' when a.id is null then 'UNEXPECTED' else 'DIFFERENT' end kind,
  case when a.id is null or b.id is null then '' else array_to_string(list_filter([case when a.pk <> b.pk then 'part' end, case when a.q <> b.q then 'quantity' end, case when a.t <> b.t then 'tax' end], lambda x: x is not null), ',') end fields
from a full outer join b on a.id = b.id and a.n = b.n where a.id is null or b.id is null or a.pk <> b.pk or a.q <> b.q or a.t <> b.t""")  # fmt: skip
def build_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds aligned by sample: what is missing, unexpected or different, field by field over their hashes."""
    a = run_sql(spark, sf_dir, f"with {LINES} select l_orderkey id, l_linenumber n, l_partkey part, l_quantity quantity, l_tax tax from li")
    b = a.where("part % 97 <> 0").select("id", "n", "part", F.when(F.col("part") % 41 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).alias("quantity"), F.when(F.col("id") % 53 == 0, F.lit(0)).otherwise(F.col("tax")).alias("tax"))
    b = b.unionByName(a.where("part % 101 = 0").withColumn("id", F.col("id") + 1_000_000_000))

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", "n", F.struct(*[F.xxhash64(F.col(c).cast("double")).alias(c) for c in ("part", "quantity", "tax")]).alias(name))

    d = hashed(a, "a").join(hashed(b, "b"), ["id", "n"], "full_outer")
    fields = F.array_compact(F.array(*[F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), c) for c in ("part", "quantity", "tax")]))
    kind = F.when(F.col("b").isNull(), "MISSING").when(F.col("a").isNull(), "UNEXPECTED").otherwise("DIFFERENT")
    d = d.withColumn("fields", F.when(kind == "DIFFERENT", F.array_join(fields, ",")).otherwise("")).withColumn("kind", kind)
    return d.where("kind <> 'DIFFERENT' or fields <> ''").select("id", F.col("n").cast("long").alias("n"), "kind", "fields")


@query("two_pass_greedy", "J-14", f"""with recursive {BOXES}, v as (select * from gt where uid % 6 <> 0), e as (select * from gt where uid % 6 = 0),
cand as (select p.sample, p.cls, p.pid, list(g.uid order by {iou('p', 'g')} desc, g.uid) c from pred p join v g on p.sample = g.sample and p.cls = g.cls and {at_least_half('p', 'g')} group by all),
ranked as materialized (select c.*, row_number() over (partition by c.sample, c.cls order by p.conf desc, p.x, p.y, p.pid) rn from cand c join pred p on p.pid = c.pid),
walk as (select sample, cls, 0::bigint rn, []::bigint[] claimed, null::bigint pid, null::bigint rid from ranked where rn = 1
  union all select r.sample, r.cls, r.rn, case when f.pick is null then w.claimed else list_append(w.claimed, f.pick) end, r.pid, f.pick from walk w join ranked r on r.sample = w.sample and r.cls = w.cls and r.rn = w.rn + 1, lateral (select list_filter(r.c, lambda x: not list_contains(w.claimed, x))[1] pick) f),
m as materialized (select pid from walk where rid is not null)
select p.cls, case when p.pid in (select pid from m) then 'TP' when exists (select 1 from e where e.sample = p.sample and e.cls = p.cls and {at_least_half('e', 'p')}) then 'IGNORED' else 'FP' end verdict, count(*) n from pred p group by all""")  # fmt: skip
def two_pass_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections claim valid elements one to one; what is left over and on an excluded element is neither right nor wrong."""
    g, p = gt(spark, sf_dir), pred(spark, sf_dir)
    a, b = Box.of(), Box.of("o")
    half = 3 * a.overlap(b) >= a.w * a.h + b.w * b.h

    def side(df: DataFrame) -> DataFrame:
        return df.select("sample", "cls", F.col("uid").alias("rid"), F.col("uid").alias("ordinal"), *[F.col(c).alias("o" + c) for c in "xywh"])

    m = greedy_match(p.withColumnRenamed("pid", "lid"), side(g.where("uid % 6 <> 0")), ["sample", "cls"], [-F.col("conf"), F.col("x"), F.col("y")], half).select(F.col("lid").alias("pid"), F.lit(True).alias("hit"))
    d = p.join(m, "pid", "left")
    rest = d.where("hit is null").join(side(g.where("uid % 6 = 0")), ["sample", "cls"]).where(half).select("pid").distinct().withColumn("ignored", F.lit(True))
    verdict = F.when(F.col("hit"), "TP").when(F.col("ignored"), "IGNORED").otherwise("FP")
    return d.join(rest, "pid", "left").groupBy("cls", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("unknown_samples", "J-02 J-17", f"""with {BOXES}, s as (select distinct sample, sample % 3 split from gt where sample % 7 <> 0), p as (select pid, sample, cls, x, y, w, h, sample % 3 split from pred)
select p.split, case when s.sample is null then 'UNKNOWN_SAMPLE' else 'EVALUATED' end state, count(*) n, count(*) filter (exists (select 1 from gt g where g.sample = p.sample and g.cls = 0 and {inter('g', 'p')} > 0)) on_protected,
  sum((select count(*) from gt g where g.sample = p.sample and g.cls = 0 and {inter('g', 'p')} > 0))::bigint regions from p left join s on s.sample = p.sample group by all""")  # fmt: skip
def unknown_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of samples that the split does not have are counted, never dropped; and which regions each survivor meets."""
    p = pred(spark, sf_dir)
    known = gt(spark, sf_dir).where("sample % 7 <> 0").select("sample").distinct().withColumn("known", F.lit(True))
    regions = gt(spark, sf_dir).where("cls = 0").groupBy("sample").agg(F.collect_list(F.struct("uid", *"xywh")).alias("rs"))
    d = p.join(known, "sample", "left").join(regions, "sample", "left")
    hit = F.transform(F.filter("rs", lambda r: Box.within(r).overlap(Box.of()) > 0), lambda r: r["uid"])
    d = d.withColumn("hit", F.coalesce(hit, F.array().cast("array<bigint>")))
    return d.groupBy((F.col("sample") % 3).alias("split"), F.when(F.col("known"), "EVALUATED").otherwise("UNKNOWN_SAMPLE").alias("state")).agg(F.count("*").alias("n"), F.count_if(F.size("hit") > 0).alias("on_protected"), F.sum(F.size("hit")).cast("long").alias("regions"))


@query("distribution_measures", "A-16 A-26", f"""with {BOXES}, m as (select cls, x + w <= 400 and y + h <= 300 whole, least(w, h)::double side, (w * h)::double area, w / h::double ratio, x + w / 2.0::double cx, y + h / 2.0::double cy, uid from gt),
u as (select cls, whole, uid, unnest(['side', 'area', 'ratio', 'cx', 'cy']) measure, unnest([side, area, ratio, cx, cy]) v from m)
select cls, measure, count(*) n, count(*) filter (whole) whole, round(min(v), 9) lo, round(quantile_disc(v, 0.5), 9) p50, round(quantile_disc(v, 0.95), 9) p95, round(max(v), 9) hi, min(uid) filter (v = (select max(v) from u z where z.cls = u.cls and z.measure = u.measure)) slowest from u group by cls, measure""")  # fmt: skip
def distribution_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five measures of each class: count, how many are whole, least, median, 95th percentile, greatest and where it is."""
    g = gt(spark, sf_dir)
    m = {"side": F.least("w", "h"), "area": F.col("w") * F.col("h"), "ratio": F.col("w") / F.col("h"), "cx": F.col("x") + F.col("w") / 2.0, "cy": F.col("y") + F.col("h") / 2.0}
    u = g.select("cls", "uid", ((F.col("x") + F.col("w") <= 400) & (F.col("y") + F.col("h") <= 300)).alias("whole"), F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("v")) for k, v in m.items()])).alias("m"))
    v = F.col("m.v")
    p = [F.round(F.expr(f"percentile_disc({q}) within group (order by m.v)"), 9).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))]
    a = u.groupBy("cls", F.col("m.measure").alias("measure")).agg(F.count("*").alias("n"), F.count_if("whole").alias("whole"), F.round(F.min(v), 9).alias("lo"), *p, F.round(F.max(v), 9).alias("hi"), (-F.max(F.struct(v.alias("v"), (-F.col("uid")).alias("u")))["u"]).alias("slowest"))
    return a


_KNOWN = "kn as (select c_custkey k, '98' || lpad(cast(c_custkey % 100000000 as string), 8, '0') value_ from customer)"
_RECORDS = """rc as (select o_orderkey id, o_custkey k, '{"note":"' || case when o_orderkey % 5 = 0 then 'call 98' || lpad(cast(o_custkey % 100000000 as string), 8, '0') else 'none' end || '","items":[{"t":"' || case when o_orderkey % 7 = 0 then '98' || lpad(cast(o_custkey % 100000000 as string), 8, '0') else o_orderpriority end || '"},"x@y.example",' || cast(o_orderkey as string) || ']}' j from orders)"""


@query("leak_sweep", "C-31 E-04 D-15 C-33", f"""with {_KNOWN}, {_RECORDS}, x as (select rc.id, rc.j, kn.value_ from rc join kn on kn.k = rc.k)
select id, contains(json_extract_string(j, '$.note'), value_) in_note, contains(json_extract_string(j, '$.items[0].t'), value_) in_items, (length(j) - length(replace(j, value_, ''))) // 10 found, position(value_ in j) - 1 first_at, regexp_matches(j, '[a-z]@[a-z]') has_mail, 3 checked from x""")  # fmt: skip
def leak_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which strings of a record hold a value that is known of its owner, how often and where; every string of the record is looked at."""
    d = run_sql(spark, sf_dir, f"with {_KNOWN}, {_RECORDS} select rc.id, rc.j, kn.value_ from rc join kn on kn.k = rc.k")
    note, items = F.get_json_object("j", "$.note"), F.get_json_object("j", "$.items[0].t")
    strings = F.filter(F.regexp_extract_all("j", F.lit(r'"(?:[^"\\]|\\.)*"\s*:?'), F.lit(0)), lambda s: ~s.endswith(":"))  # keys end with a colon
    found = F.floor((F.length("j") - F.length(F.replace("j", F.col("value_"), F.lit("")))) / 10)
    return d.select("id", F.contains(note, F.col("value_")).alias("in_note"), F.contains(items, F.col("value_")).alias("in_items"), found.alias("found"), (F.expr("position(value_, j)") - 1).cast("long").alias("first_at"), F.exists(strings, lambda s: s.rlike("[a-z]@[a-z]")).alias("has_mail"), F.size(strings).alias("checked"))
