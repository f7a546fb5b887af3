"""Whole samples from seeds: a screen's elements from the numbers of its stream, canonical, and sealed by a tree of hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.canonical import canonical
from quillon.plans.curation import mulberry
from quillon.registry import query, run_sql

# The screen, cards and inputs of each density in turn, and where the splits' seeds begin.
WIDTH, HEIGHT, DPR = 1024, 640, 2
DENSITIES = (("sparse", 2, 2), ("normal", 3, 2), ("dense", 4, 4))
SEED, SPLIT_SEED, STEP = 42, 1_000_000, 1_831_565_813
#: Numbers that the densest screen draws.
DRAWS = 3 * 4 + 1 + 2 * 4 + 2
#: Samples that are hashed together.
SEALED = 64
_IDX = f"idx as (select p_partkey id, p_partkey % 3 split, cast(floor(p_partkey / 3) as bigint) i, cast(k as bigint) k from part, (select {{each}} k) n)"
_SEED = f"{SEED} + split * {SPLIT_SEED} + i + (k + 1) * {STEP}"


def screen(cards: int, inputs: int, u: Callable, rounded: Callable) -> list[tuple]:
    """(class, x, y, w, h) of a screen's elements in the order in which they draw: u(k) is the stream's k-th number, rounded keeps three decimals.

    Repeated cards, two buttons alike, inputs of differing width, controls inside labels, one element at the fold, two below it.
    """
    def jitter(k: int, span: float):
        return rounded((u(k) - 0.5) * span)

    out = []
    for i in range(cards):
        x = rounded(jitter(3 * i, 6) + (40 + i * 244)) + 12
        out += [("button", x, rounded(jitter(3 * i + 1, 4) + 140), 110, 30), ("link", x, rounded(jitter(3 * i + 2, 4) + 180), 90, 16)]
    at = 3 * cards
    y = rounded(jitter(at, 6) + 240)
    out += [("button", 40, y, 130, 36), ("button", 190, y, 130, 36)]
    for i in range(inputs):
        out.append(("textbox", 40, rounded(jitter(at + 1 + 2 * i, 3) + (310 + i * 44)), rounded(u(at + 2 + 2 * i) * 80 + 280), 32))
    y, at = 330 + inputs * 44, at + 1 + 2 * inputs
    out += [("checkbox", 44, y + 4, 16, 16), ("radio", 140, y + 4, 16, 16), ("select", 240, y, 180, 28), ("icon", rounded(jitter(at, 2) + (WIDTH - 60)), 20, 24, 24), ("tab", 440, 96, 90, 28)]
    return [*out, ("button", 40, rounded(jitter(at + 1, 4) + (HEIGHT - 20)), 200, 44), ("button", 40, HEIGHT + 520, 160, 44), ("link", 40, HEIGHT + 700, 200, 18)]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, i and the whole sample s; its annotations come in no order."""
    rnd = run_sql(spark, sf_dir, f"with {_IDX.format(each=f'explode(sequence(0, {DRAWS - 1}))')}, {mulberry(_SEED, False)} select split, i, k, u from rnd")
    d = rnd.groupBy("split", "i").agg(F.array_sort(F.collect_list(F.struct("k", "u")))["u"].alias("u"))
    split = F.element_at(F.array(*map(F.lit, ("train", "dev", "test"))), (F.col("split") + 1).cast("int"))
    d = d.withColumn("id", F.concat(split, F.lit("-"), F.lpad(F.col("i").cast("string"), 4, "0")))

    def box(part: tuple) -> tuple[str, list[Column]]:
        return part[0], [(x if isinstance(x, Column) else F.lit(x)).cast("double") for x in part[1:]]

    def annotation(n: int, cls: str, b: list[Column]) -> Column:
        x, y, w, h = b
        inside = (x >= 0) & (y >= 0) & (x + w <= WIDTH) & (y + h <= HEIGHT)
        meets = (x < WIDTH) & (y < HEIGHT) & (x + w > 0) & (y + h > 0)
        return F.struct(F.concat("id", F.lit(f"-a{n}")).alias("id"), F.lit(cls).alias("cls"), F.struct(*[v.alias(k) for k, v in zip("xywh", b, strict=True)]).alias("box"), F.when(inside, "VISIBLE").when(meets, "CLIPPED").otherwise("OFFSCREEN").alias("visibility"))

    def notes(cards: int, inputs: int) -> Column:
        return F.array(*[annotation(n + 1, *box(p)) for n, p in enumerate(screen(cards, inputs, lambda k: F.get("u", F.lit(k)), lambda v: F.round(v, 3)))])

    # each density is a plan of its own, as one for all would be too large to compile
    kinds = [d.where(F.col("i") % 3 == n).select("split", "i", "id", notes(cards, inputs).alias("notes")) for n, (_, cards, inputs) in enumerate(DENSITIES)]
    d = kinds[0].union(kinds[1]).union(kinds[2])
    size = lambda a, b: F.struct(F.lit(a).alias("w"), F.lit(b).alias("h"))
    whole = F.struct(
        "id", split.alias("split"), F.struct(F.lit("SYNTHETIC").alias("kind"), F.lit("screens@1").alias("generator"), (SEED + F.col("split") * SPLIT_SEED + F.col("i")).alias("seed")).alias("provenance"),
        size(WIDTH, HEIGHT).alias("viewportCss"), F.lit(float(DPR)).alias("dpr"), F.lit(1.0).alias("zoom"), size(WIDTH * DPR, HEIGHT * DPR).alias("captureSize"),
        F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")).alias("scroll"), F.shuffle("notes", seed=7).alias("annotations"),
    )
    return d.select(split.alias("split"), "i", whole.alias("s"))


def sealed(d: DataFrame) -> DataFrame:
    """split, n, seal of samples (split, i, s): hashes of SEALED texts by id, and of these; the input's order is of no matter."""
    d = d.select("split", "i", canonical(F.col("s"), d.schema["s"].dataType).alias("j"))
    b = d.groupBy("split", F.floor(F.col("i") / SEALED).alias("block")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", "j"))).alias("js"))
    b = b.select("split", "block", "n", F.sha2(F.array_join("js.j", ","), 256).alias("h"))
    return b.groupBy("split").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("block", "h")))["h"], ","), 256).alias("seal"))


_N = "regexp_replace(printf('%.6f', round(({})::double, 6)), '[.]?0+$', '')"
_DUCK = f"""with {_IDX.format(each=f"unnest(range({DRAWS}))")}, {mulberry(_SEED, True)},
sm as (select split, i, list(u order by k) u, case i % 3 when 0 then 2 when 1 then 3 else 4 end c, case i % 3 when 2 then 4 else 2 end n from rnd group by split, i),
q as (select *, 3 * c base, ['train', 'dev', 'test'][split + 1] || '-' || lpad(i::varchar, 4, '0') id from sm),
card as (select q.*, unnest(range(c)) t from q), inp as (select q.*, unnest(range(n)) t from q),
e(split, i, id, pos, cls, x, y, w, h) as (
  select split, i, id, 2 * t + 1, 'button', round(40 + t * 244 + round((u[3 * t + 1] - 0.5::double) * 6, 3), 3) + 12, round(140 + round((u[3 * t + 2] - 0.5::double) * 4, 3), 3), 110::double, 30 from card
  union all select split, i, id, 2 * t + 2, 'link', round(40 + t * 244 + round((u[3 * t + 1] - 0.5::double) * 6, 3), 3) + 12, round(180 + round((u[3 * t + 3] - 0.5::double) * 4, 3), 3), 90, 16 from card
  union all select split, i, id, 2 * c + 1 + p, 'button', 40 + 150 * p, round(240 + round((u[base + 1] - 0.5::double) * 6, 3), 3), 130, 36 from q, (select unnest([0, 1]) p)
  union all select split, i, id, 2 * c + 3 + t, 'textbox', 40, round(310 + t * 44 + round((u[base + 2 + 2 * t] - 0.5::double) * 3, 3), 3), round(280 + u[base + 3 + 2 * t] * 80, 3), 32 from inp
  union all select split, i, id, 2 * c + 3 + n + p.k, p.cls, case when p.cls = 'icon' then round({WIDTH} - 60 + round((u[base + 2 + 2 * n] - 0.5::double) * 2, 3), 3) else p.x end,
    case when p.k < 3 then 330 + n * 44 + p.y when p.k = 5 then round({HEIGHT} - 20 + round((u[base + 3 + 2 * n] - 0.5::double) * 4, 3), 3) else p.y end, p.w, p.h
    from q, (values (0, 'checkbox', 44::double, 4::double, 16, 16), (1, 'radio', 140, 4, 16, 16), (2, 'select', 240, 0, 180, 28), (3, 'icon', 0, 20, 24, 24), (4, 'tab', 440, 96, 90, 28), (5, 'button', 40, 0, 200, 44), (6, 'button', 40, {HEIGHT + 520}, 160, 44), (7, 'link', 40, {HEIGHT + 700}, 200, 18)) p(k, cls, x, y, w, h)),
a as (select split, i, id, id || '-a' || pos aid, cls, x, y, w, h, case when x >= 0 and y >= 0 and x + w <= {WIDTH} and y + h <= {HEIGHT} then 'VISIBLE' when x < {WIDTH} and y < {HEIGHT} and x + w > 0 and y + h > 0 then 'CLIPPED' else 'OFFSCREEN' end v from e),
j as (select split, i, '{{"id":"' || id || '","split":"' || ['train', 'dev', 'test'][split + 1] || '","provenance":{{"kind":"SYNTHETIC","generator":"screens@1","seed":' || ({SEED} + split * {SPLIT_SEED} + i) || '}},"viewportCss":{{"w":{WIDTH},"h":{HEIGHT}}},"dpr":{DPR},"zoom":1,"captureSize":{{"w":{WIDTH * DPR},"h":{HEIGHT * DPR}}},"scroll":{{"x":0,"y":0}},"annotations":['
  || string_agg('{{"id":"' || aid || '","cls":"' || cls || '","box":{{"x":' || {_N.format('x')} || ',"y":' || {_N.format('y')} || ',"w":' || {_N.format('w')} || ',"h":' || {_N.format('h')} || '}},"visibility":"' || v || '"}}', ',' order by aid) || ']}}' j, count(*) filter (v = 'VISIBLE') visible, count(*) notes from a group by split, i, id),
b as (select split, i // {SEALED} k, count(*) n, sum(visible) visible, sum(notes) notes, sha256(string_agg(j, ',' order by i)) h from j group by 1, 2)
select ['train', 'dev', 'test'][split + 1] split, sum(n)::bigint n, sum(notes)::bigint annotations, sum(visible)::bigint visible, sha256(string_agg(h, ',' order by k)) seal from b group by split"""


@query("sealed_samples", "D-01 D-03", _DUCK)
def sealed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each split, their annotations, those that can be seen, and the split's seal."""
    d = samples(spark, sf_dir)
    notes = F.col("s.annotations")
    counts = d.groupBy(F.col("split").alias("c")).agg(F.sum(F.size(notes)).cast("long").alias("annotations"), F.sum(F.size(F.filter(notes, lambda a: a["visibility"] == "VISIBLE"))).cast("long").alias("visible"))
    return sealed(d).join(counts, F.col("split") == F.col("c")).select("split", "n", "annotations", "visible", "seal")
