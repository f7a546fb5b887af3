"""Statistics: exact percentiles, stage tables, profiles, modes, peaks, verdicts and tensor figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.ranking import selected
from quillon.registry import both, query, table


def nearest(p: float, v: str = "v") -> str:
    """Nearest-rank percentile; null without samples."""
    return f"percentile_disc({p}) within group (order by {v})"


both("summary_by_type", "A-01 A-02 E-12", f"""select event_type, count(value) n, {nearest(0.5, 'value')} p50, {nearest(0.95, 'value')} p95, min(value) lo, max(value) hi, round(avg(value), 6) mean,
  {nearest(0.3, 'value')} p30, {nearest(1.0, 'value')} p100 from events group by event_type""")

#: Places of the order statistics, by a group's size.
_PLACES = {"upper_median": "floor(n / 2) + 1", "q90": "floor(0.9 * (n - 1) + 0.5) + 1", "q50": "floor(0.5 * (n - 1) + 0.5) + 1", "floor_p99": "floor(0.99 * n) + 1"}


@query("upper_median_spread", "A-13 E-12 A-17", """with r as (select l_returnflag k, l_extendedprice v, row_number() over (partition by l_returnflag order by l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) rn, count(*) over (partition by l_returnflag) n from lineitem)
select k, max(case when rn = cast(floor(n / 2) as bigint) + 1 then v end) upper_median, max(case when rn = cast(floor(0.9 * (n - 1) + 0.5) as bigint) + 1 then v end) q90,
  max(case when rn = cast(floor(0.5 * (n - 1) + 0.5) as bigint) + 1 then v end) q50, max(case when rn = cast(floor(0.99 * n) as bigint) + 1 then v end) floor_p99, max(v) - min(v) spread from r group by k""")  # fmt: skip
def upper_median_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics of each group, found by bracketing their places, and the spread."""
    found = selected(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {name: F.expr(at) for name, at in _PLACES.items()})
    return found.select("k", *_PLACES, (F.col("hi") - F.col("lo")).alias("spread"))


STAGES = "('observe', event_id % 17 + 0.5), ('sanitise', event_id % 31 * 1.5), ('plan', event_id % 101 + 0.25)"
both(
    "stage_table", "A-03",
    f"""with t as (select event_id, event_type task, stack(3, 'observe', cast(event_id % 17 + 0.5 as double), 'sanitise', cast(event_id % 31 * 1.5 as double), 'plan', cast(event_id % 101 + 0.25 as double)) as (stage, ms) from events)
select coalesce(task, 'ALL') task, stage, count(*) n, {nearest(0.5, 'ms')} p50, {nearest(0.95, 'ms')} p95, max(ms) hi from t where not (stage = 'plan' and event_id % 3 = 0) group by grouping sets ((task, stage), (stage))""",
    f"""with t as (select event_id, event_type task, s.stage, s.ms from events, lateral (values ('observe', (event_id % 17 + 0.5)::double), ('sanitise', (event_id % 31 * 1.5)::double), ('plan', (event_id % 101 + 0.25)::double)) s(stage, ms))
select coalesce(task, 'ALL') task, stage, count(*) n, {nearest(0.5, 'ms')} p50, {nearest(0.95, 'ms')} p95, max(ms) hi from t where not (stage = 'plan' and event_id % 3 = 0) group by grouping sets ((task, stage), (stage))""",
)

both("resource_peaks", "A-04 J-13", """with s as (select cast(floor(event_id / 20) as bigint) k, event_id % 20 pid, event_type grp, event_id % 1000 * 10 ws, event_id * 7 cpu, event_id * 50 t from events where event_id % 9 <> 0),
prev as (select k + 1 nk, pid, cpu from s),
inst as (select s.grp, s.k, sum(s.ws) ws, sum(case when prev.cpu is null then 0 else greatest(s.cpu - prev.cpu, 0) end) busy from s left join prev on prev.nk = s.k and prev.pid = s.pid group by s.grp, s.k),
per as (select grp, pid, max(ws) peak from s group by grp, pid),
tot as (select grp, cast(sum(peak) as bigint) sum_of_peaks, count(*) procs from per group by grp)
select inst.grp, cast(max(inst.ws) as bigint) peak_of_sums, max(tot.sum_of_peaks) sum_of_peaks, max(tot.procs) procs, round(max(inst.busy) / 1000.0, 6) peak_cores from inst join tot on tot.grp = inst.grp group by inst.grp""".replace("/ 1000.0", "/ cast(1000 as double)"))  # fmt: skip

both("distribution_profile", "A-18 A-21", f"""with m as (select l_returnflag split, l_linestatus cls, cast(l_quantity as bigint) q, count(*) n from lineitem group by 1, 2, 3),
r as (select *, row_number() over (partition by split, cls order by n desc, q) rn, row_number() over (partition by split, cls order by q desc) kth from m),
mode as (select split, cls, max(case when rn = 1 then q end) mode_q, max(case when kth = 3 then q end) third_highest from r group by split, cls),
p as (select l_returnflag split, l_linestatus cls, count(*) n, min(l_quantity) lo, {nearest(0.5, 'l_quantity')} p50, max(l_quantity) hi, sum(case when l_discount > 0.05 then 1 else 0 end) discounted,
  case when sum(case when l_tax > 0 then 1 else 0 end) = 0 then 'NONE' when sum(case when l_tax > 0 then 1 else 0 end) = count(*) then 'ALL' else 'PARTIAL' end population from lineitem group by 1, 2)
select p.split, p.cls, p.n, p.lo, p.p50, p.hi, cast(p.discounted as bigint) discounted, p.population, mode.mode_q, mode.third_highest from p join mode on p.split = mode.split and p.cls = mode.cls""")  # fmt: skip


@query("tensor_stats", "A-24", """with e as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings)
select vec_id, len(v)::int n, list_min(v) lo, list_max(v) hi, round(list_sum(v), 6) s, round(list_sum(list_transform(v, lambda x: abs(x))), 6) sum_abs, round(list_sum(list_transform(v, lambda x: x * x)), 6) sum_sq,
  v[1] first_v, v[len(v) // 2 + 1] mid_v, v[len(v)] last_v from e""")  # fmt: skip
def tensor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, range, sums and sampled positions of every vector, folded inside the row."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

    def total(f) -> F.Column:
        return F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + f(x)), 6)

    n = F.size("v")
    return e.select(
        "vec_id", n.alias("n"), F.array_min("v").alias("lo"), F.array_max("v").alias("hi"), total(lambda x: x).alias("s"), total(F.abs).alias("sum_abs"), total(lambda x: x * x).alias("sum_sq"),
        F.element_at("v", F.lit(1)).alias("first_v"), F.element_at("v", (F.floor(n / 2) + 1).cast("int")).alias("mid_v"), F.element_at("v", -1).alias("last_v"),
    )


@query("tensor_diff", "E-07 J-18", """with p as (select a.vec_id, list_sort(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda z: abs(z[1] - z[2]))) d from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select vec_id, d[len(d)] worst, round(list_sum(d) / len(d), 9) mean, d[floor(0.5::double * len(d))::int + 1] p50, d[floor(0.99::double * len(d))::int + 1] p99, len(list_filter(d, lambda x: x > 0))::int differing from p""")  # fmt: skip
def tensor_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next: largest, mean and floor-index percentiles of the absolute difference."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    d = e.join(nxt, "vec_id").select("vec_id", F.array_sort(F.zip_with("v", "w", lambda x, y: F.abs(x - y))).alias("d"))
    n = F.size("d")
    return d.select(
        "vec_id", F.element_at("d", -1).alias("worst"), F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / n, 9).alias("mean"),
        F.element_at("d", (F.floor(n * 0.5) + 1).cast("int")).alias("p50"), F.element_at("d", (F.floor(n * 0.99) + 1).cast("int")).alias("p99"), F.size(F.filter("d", lambda x: x > 0)).alias("differing"),
    )


both("launch_verdicts", "A-29", """with c as (select o_orderpriority cell, count(*) launches, sum(case when o_orderstatus <> 'P' then 1 else 0 end) loaded, max(o_totalprice) worst from orders group by 1)
select cell, launches, cast(loaded as bigint) loaded, case when loaded = launches then 'ACCEPT' when loaded * 2 >= launches then 'CONDITIONAL' when loaded = 0 then 'BLOCKED' else 'REJECT' end verdict,
  case when loaded = launches then 3 / cast(launches as double) end upper_bound, worst > 400000 flood from c""")  # fmt: skip

both("loss_aggregation", "A-15 A-25", """with b as (select l_orderkey % 40 batch, l_linenumber % 3 cls, case when l_quantity < 10 then 'small' when l_quantity < 30 then 'medium' else 'large' end bucket, cast(l_discount * 100 as bigint) num from lineitem),
p as (select batch, cls, bucket, sum(num) num, count(*) pos from b group by batch, cls, bucket)
select cls, bucket, cast(sum(num) as bigint) num, cast(sum(pos) as bigint) positives, round(cast(sum(num) as double) / sum(pos), 9) loss, cast(max(num) as bigint) worst_batch from p group by cls, bucket""")  # fmt: skip

both("count_maps", "A-28 K-04", """with c as (select event_type a, cast(floor(value) as bigint) % 5 b, count(*) n from events group by 1, 2), r as (select *, row_number() over (order by n desc, a, b) rn from c)
select a, b, n, cast(rn as bigint) rn from r where rn <= 10""")

both("run_timing", "A-27 T-14", """with s as (select cast(floor(event_id / 50) as bigint) run, case when event_id % 211 = 0 then null else event_id % 13 * 1.5 end sec, event_id % 7 * 0.5 cpu, case when event_id % 503 = 0 then -1 else event_id % 13 * 1.5 + 0.5 end biased from events)
select run, case when count(sec) = count(*) then round(sum(cast(sec as double)), 6) end total_s, cast(sum(case when sec is null then 1 else 0 end) as bigint) unmeasured,
  cast(sum(case when biased < 0 then 1 else 0 end) as bigint) backwards, round(sum(cast(cpu as double)) / nullif(sum(case when sec is null then 0 else cast(sec as double) end), 0), 6) cpu_share,
  case when min(biased) < 0 then 'unavailable' else 'measured' end kind from s group by run""")  # fmt: skip
