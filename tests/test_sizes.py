"""Queries on tables that the given ones do not hold: repeated runs, sessions of many fields, equal values, large groups."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from quillon.operators import pixels, redaction, tiles
from quillon.operators.ranking import reverse_maximum, running
from quillon.operators.rasters import whole_groups
from quillon.plans import sanitise
from quillon.plans.privacy import classified, fields
from quillon.queries import ORACLES, QUERIES
from quillon.registry import TABLES
from quillon.sources.named_files import PARTITIONS, ManifestReader, registered
from test_parity import rows

SF = "/root/testdata/sf0.001"


def against_duckdb(spark, folder, name):
    """Both engines on the tables of folder, and those that it lacks as given."""
    c = duckdb.connect()
    for t in TABLES:
        own = folder / f"{t}.parquet"
        if not own.exists():
            own.symlink_to(f"{SF}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{own}'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), c.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert rows(got, cols) == rows(want, cols)
    return got


def remade(folder, table, sql):
    """The given table as sql makes it."""
    duckdb.execute(f"copy ({sql.format(t=f"'{SF}/{table}.parquet'")}) to '{folder}/{table}.parquet'")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_first_run_of_several_rows(spark, tmp_path):
    remade(tmp_path, "lineitem", "select * replace (l_linenumber % 2 as l_linenumber, l_orderkey % 50 as l_orderkey, l_partkey % 20 as l_partkey) from {t}")
    assert against_duckdb(spark, tmp_path, "configuration_agreement")["runs"].max() > 0


def test_a_payload_is_hashed_whole(spark, tmp_path):
    remade(tmp_path, "customer", "select * replace (0 as c_nationkey) from {t}")
    got = against_duckdb(spark, tmp_path, "egress_ledger")
    assert len(got) == 1 and got["n_refs"][0] > 0
    c = sorted((r["id"], r["ref"]) for r in classified(spark, str(tmp_path)).select("id", "ref").collect())
    assert len(c) > 64 and got["payload_sha256"][0] == hashlib.sha256(";".join(f"{i}={r or '-'}" for i, r in c).encode()).hexdigest()


def test_equal_values_meet_once(spark, tmp_path):
    remade(tmp_path, "customer", "select * replace (0 as c_nationkey, c_custkey * 9 + 4 as c_custkey) from {t}")
    against_duckdb(spark, tmp_path, "literal_echo")
    assert re.search(r"Aggregate\(keys?=\[vs", plan(QUERIES["literal_echo"](spark, str(tmp_path))).split("== Physical Plan ==")[-1])


def test_no_frame_ends_with_its_range(spark):
    df = spark.createDataFrame([("a", i, float(i % 7)) for i in range(50)], "g string, id long, v double")
    out = reverse_maximum(running(df, "g", [F.col("id")], {"seen": F.lit(1)}), "g", [F.col("id")], "v", "most")
    frames = [w for w in plan(out.select("g", "id", "v", "most")).split("== Physical Plan ==")[-1].split("windowspecdefinition") if "__p" in w.split(")")[0]]
    assert frames and not any("unboundedfollowing" in f.lower() for f in frames)


def test_customers_are_dealt_before_they_are_judged(spark):
    assert fields(spark, SF).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["assignment_pairs", "set_verdicts"])
def test_a_large_screen_goes_through_one_shuffle_of_boxes(spark, tmp_path, name):
    """A third of the rows are one screen's; boxes are dealt once by their screen, and nothing larger than a box is."""
    remade(tmp_path, "lineitem", "select * replace (case when l_partkey % 3 = 0 then 1000000007 else l_orderkey end as l_orderkey) from {t}")
    against_duckdb(spark, tmp_path, name)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        physical = plan(QUERIES[name](spark, str(tmp_path))).split("== Physical Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "MapInArrow" in physical and "collect_list" not in physical and "Generate" not in physical


def test_many_small_manifests_take_few_partitions(tmp_path):
    for k in range(PARTITIONS + 30):
        (tmp_path / f"m{k}").mkdir()
        (tmp_path / f"m{k}" / "manifest-train.json").write_text("{}")
    parts = ManifestReader({"path": str(tmp_path), "split": "train", "onproblem": "report"}).partitions()
    assert len(parts) == PARTITIONS and sum(len(p.folders) for p in parts) == PARTITIONS + 30


def test_files_are_read_as_they_are(spark, tmp_path):
    registered(spark)
    rows_ = [(f"a/{k}.png", hashlib.sha256(b"%d" % k).hexdigest(), b"%d" % k) for k in range(20)]
    spark.createDataFrame(rows_, "name string, sha256 string, body binary").repartition(3).write.format("named_files").option("path", str(tmp_path)).option("batch", "0").mode("append").save()
    changed = next(tmp_path.glob("batch=0/*/a/7.png"))
    changed.write_bytes(b"other")
    got = {r["name"]: (r["sha256"], bytes(r["body"])) for r in spark.read.format("named_files").load(str(tmp_path)).collect()}
    want = {n: (h, b) for n, h, b in rows_} | {"a/7.png": (hashlib.sha256(b"other").hexdigest(), b"other")}
    assert got == want


def test_images_are_merged_together_as_each_alone():
    """One image of many boxes, one beyond the places of a round, one of equal boxes; and scores as score_image() has them."""
    rng, boxes, image = np.random.default_rng(4), [], []
    for k in range(40):
        n = pixels.MOST_BOXES + 3 if k == 7 else int(rng.integers(1, 40))
        b = np.c_[rng.integers(-9, 400, n), rng.integers(-6, 300, n), rng.integers(20, 90, (n, 2))]
        b[0, 0] = pixels.MOST_PLACE if k == 9 else b[0, 0]
        boxes.append(np.repeat(b[:1], n, axis=0) if k == 11 else b)
        image += [k] * n
    of, m = pixels.redaction_masks(np.vstack(boxes), np.array(image), redaction.PAGE)
    for k, b in enumerate(boxes):
        want = pixels.redaction_mask(b, redaction.PAGE)
        assert m[of == k].tolist() == want[np.lexsort((want[:, 3], want[:, 2], want[:, 0], want[:, 1]))].tolist()

    image, all_ = np.array(image), np.vstack(boxes)
    side, cls = rng.integers(0, 2, len(all_)), rng.integers(0, 3, len(all_))
    side[image == 3], side[image == 5] = 0, 1
    got = redaction.image_scores(image, [image * 10, side, cls, *all_.T])
    for k in range(40):
        pred_, gt_, c = all_[(image == k) & (side == 0)], all_[(image == k) & (side == 1)], cls[(image == k) & (side == 1)]
        glyphs = [((float(x), float(y), 10.0, 10.0), bool(z == 0)) for (x, y, _, _), z in zip(gt_, c, strict=True) if x + 10 <= 400 and y + 10 <= 300]
        want = redaction.score_image(pred_, redaction.PAGE, glyphs, gt_)
        row = [v[k].item() for v in got]
        assert row[0] == k * 10 and [None if v != v else v for v in row[1:]] == list(want.values())


@pytest.mark.parametrize("name", ["redaction_masks", "redaction_scores", "page_layouts"])
def test_many_images_in_a_call(spark, name):
    physical = plan(QUERIES[name](spark, SF)).split("== Physical Plan ==")[-1]
    assert "MapInArrow" in physical and "FlatMapGroups" not in physical


def test_groups_are_whole_whatever_the_batches(spark):
    df = spark.range(400).selectExpr("case when id < 300 then id % 3 else id div 7 end as g", "id as v")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        def sums(n, c):
            return [c[0][np.flatnonzero(np.r_[True, n[1:] != n[:-1]])], np.bincount(n, c[1]).astype(np.int64), np.bincount(n)]

        got = {tuple(r) for r in whole_groups(df, "g", ["v"], sums, "g long, s long, n long").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {tuple(r) for r in df.groupBy("g").agg(F.sum("v"), F.count("*")).collect()}


def test_layouts_meet_in_tiles(spark, tmp_path, monkeypatch):
    """Many tiles, runs of few pairs, and one layout larger than a run; no pair of elements is shuffled."""
    monkeypatch.setattr(tiles, "TILE", 40)
    monkeypatch.setattr(tiles, "PAIRS", 700)
    remade(tmp_path, "lineitem", "select * replace (case when l_orderkey < 40 then 7 else l_orderkey end as l_orderkey) from {t} where l_orderkey < 900")
    assert len(against_duckdb(spark, tmp_path, "layout_similarity"))
    assert "Join" not in plan(QUERIES["layout_similarity"](spark, str(tmp_path))).split("== Physical Plan ==")[-1]


@pytest.mark.parametrize(("name", "shuffles", "joins"), [("assignment_audit", 3, 0), ("run_changes", 14, 5), ("run_change_totals", 15, 5), ("miss_attribution", 8, 2), ("miss_kinds", 20, 6)])
def test_rows_stay_with_their_screen(spark, name, shuffles, joins):
    """What is worked out per screen is not dealt again by element; nothing is broadcast, as in large tables."""
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        physical = plan(QUERIES[name](spark, SF)).split("== Physical Plan ==")[-1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert physical.count("Exchange hashpartitioning") <= shuffles and physical.count("Join") <= joins


def test_findings_are_dealt_before_they_are_judged(spark, tmp_path):
    """A table of one part is judged by all cores, and a report's regions are read once a pass; a pass of many findings is as its SQL has it."""
    optimized = QUERIES["redaction_plans"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in optimized and optimized.count("from_json") == 1
    remade(tmp_path, "events", "select * replace (user_id % 9 + 36 * (user_id % 3) as user_id) from {t}")
    assert against_duckdb(spark, tmp_path, "redaction_plans")["masks"].max() > 0


def test_a_region_meets_the_boxes_that_touch_it(spark, tmp_path):
    """No region looks through all boxes of its screen: what touches it comes in by the join. Screens of many elements are as in SQL."""
    optimized = QUERIES["text_region_screen"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter, .*greatest\(", optimized)
    remade(tmp_path, "lineitem", "select * replace (l_orderkey % 100 as l_orderkey) from {t} where l_orderkey < 300")
    assert against_duckdb(spark, tmp_path, "text_region_screen")["regions"].max() > 20


def test_signatures_are_gathered_once(spark):
    """Twins are joined to the counts of their signatures; the elements behind both are shuffled once."""
    got = QUERIES["layout_twins"](spark, SF)
    assert len(got.collect())
    ran = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("ShuffleQueryStage") <= 6


def test_manifests_are_judged_where_they_are_built(spark):
    """A manifest is put together once: its lines come in by one join, and no join brings it together with its verdict."""
    optimized = QUERIES["manifest_build"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin (?:Inner|LeftOuter)", optimized)) == 2 and "get_json_object" not in optimized


def test_claims_are_made_where_their_screen_is(spark):
    assert re.search(r"Exchange hashpartitioning\(sample", plan(QUERIES["target_cells"](spark, SF))) and not re.search(r"hashpartitioning\(sample[^,]*, c#", plan(QUERIES["target_cells"](spark, SF)))


def test_fusion_deals_lines_once_and_makes_no_pair_rows(spark, tmp_path):
    """Ids of long orders come in two screens, and some boxes have no area."""
    remade(tmp_path, "lineitem", "select * replace (l_orderkey % 25 as l_orderkey, case when l_suppkey % 9 = 0 then l_quantity - 100 else l_quantity end as l_quantity) from {t} where l_orderkey % 4 = 0")
    assert len(against_duckdb(spark, tmp_path, "fusion")) > 100
    seen = []
    write = DataFrameWriter.parquet
    try:
        DataFrameWriter.parquet = lambda self, *a, **b: (seen.append(plan(self._df)), write(self, *a, **b))[1]
        QUERIES["fusion"](spark, SF)
    finally:
        DataFrameWriter.parquet = write
    physical = seen[0].split("== Physical Plan ==")[-1]
    assert physical.count("Exchange") == 1 and "Join" not in physical


def test_fields_are_judged_after_they_are_dealt(spark, tmp_path):
    """Nothing above the dealing asks for a class below it, where one task reads the table."""
    remade(tmp_path, "customer", "select * replace (c_custkey % 60 as c_nationkey) from {t}")
    got = against_duckdb(spark, tmp_path, "field_fill")
    assert got["fill"].notna().any()
    physical = plan(QUERIES["field_fill"](spark, SF)).split("== Physical Plan ==")[-1]
    filters = [l for l in physical.splitlines() if re.match(r"[ :+*()0-9-]*Filter ", l)]
    assert not any("rlike" in l.lower() for l in filters) and "Window" not in physical


def test_pages_are_judged_by_many_tasks(spark, tmp_path):
    against_duckdb(spark, tmp_path, "sanitised_pages")
    assert fields(spark, SF, sanitise._FIELDS).rdd.getNumPartitions() == 4


def test_a_claim_is_put_together_once(spark, tmp_path):
    """Rules that each write a claim out make a method too long to be compiled."""
    remade(tmp_path, "part", "select * replace (p_size % 6 as p_size) from {t}")
    assert against_duckdb(spark, tmp_path, "claim_freshness")["reason"].nunique() > 5
    assert plan(QUERIES["claim_freshness"](spark, SF)).split("== Physical Plan ==")[-1].count("CASE WHEN has_claim") == 1


def test_a_log_is_sorted_once(spark, tmp_path):
    """Vaults of many operations, after some of which they are gone."""
    remade(tmp_path, "lineitem", "select * replace (l_orderkey % 100 as l_orderkey) from {t}")
    assert against_duckdb(spark, tmp_path, "vault_log")["outcome"].nunique() > 7
    physical = plan(QUERIES["vault_log"](spark, SF)).split("== Physical Plan ==")[-1]
    assert physical.count("Sort ") == 1 and physical.count("Exchange") == 1


def test_cells_of_a_mask_are_counted_without_joining_them(spark, tmp_path):
    """Lines are shuffled once for elements and detections, and cells are not joined with targets."""
    remade(tmp_path, "lineitem", "select * replace (l_orderkey % 25 as l_orderkey) from {t} where l_orderkey % 4 = 0")
    against_duckdb(spark, tmp_path, "occlusion_ignore_mask")
    physical = plan(QUERIES["occlusion_ignore_mask"](spark, SF)).split("== Physical Plan ==")[-1]
    assert len(re.findall(r"\w*Join ", physical)) == 1


@pytest.mark.parametrize("name", ["run_changes", "run_change_totals"])
def test_runs_are_compared_where_their_screen_is(spark, tmp_path, name):
    """Lines are dealt once and no pair moves; boxes without an area, ids that come twice on a screen or on two, nulls and dense screens are as in SQL."""
    nulls = "case when l_suppkey % 31 = 0 then null else l_quantity end as l_quantity, case when l_suppkey % 17 = 0 then null else l_partkey end as l_partkey"
    for k, odd in enumerate((
        "l_orderkey % 25 as l_orderkey", "case when l_suppkey % 9 = 0 then l_quantity - 100 else l_quantity end as l_quantity", nulls, f"case when l_orderkey % 50 = 0 then null else l_orderkey % 300 end as l_orderkey, {nulls}",
        "case when l_orderkey % 400 < 100 then 19 else l_orderkey % 1100 end as l_orderkey",
    )):
        folder = tmp_path / str(k)
        folder.mkdir()
        remade(folder, "lineitem", f"select * replace ({odd}) from {{t}} where l_orderkey % 4 = 0")
        assert len(against_duckdb(spark, folder, name))
    seen = []
    write = DataFrameWriter.parquet
    try:
        DataFrameWriter.parquet = lambda self, *a, **b: (seen.append(plan(self._df)), write(self, *a, **b))[1]
        out = QUERIES[name](spark, SF)
    finally:
        DataFrameWriter.parquet = write
    physical = seen[0].split("== Physical Plan ==")[-1]
    assert physical.count("Exchange") == 1 and "Join" not in physical + plan(out)


def test_stretches_hold_all_halves_and_little_else():
    """Of boxes of any sizes, some without an area, every pair of a class that overlaps by a half lies in a stretch, once; of like boxes stretches hold few others."""
    rng = np.random.default_rng(8)
    for like in (False, True):
        def boxes(n, like=like):
            size = rng.integers(40, 90, (2, n)) if like else rng.integers(-3, 120, (2, n)) * rng.choice([1, 1, 7], (2, n))
            return [np.sort(rng.integers(0, n // 20 + 1, n)), rng.integers(0, 4, n) if like else rng.choice([-1, 2, 900], n), np.arange(n), *rng.integers(-300, 300, (2, n)), *size]

        a, b = boxes(700), boxes(900)
        a[1][:5] = 77  # a class that b lacks
        row, start, n, order = tiles._stretches(a, b)
        pairs = [(i, j) for i, s, k in zip(row.tolist(), start.tolist(), n.tolist(), strict=True) for j in order[s : s + k].tolist()]
        assert len(pairs) == len(set(pairs))
        inter = [np.clip(np.minimum(a[k][:, None] + a[k + 2][:, None], b[k] + b[k + 2]) - np.maximum(a[k][:, None], b[k]), 0, None) for k in (3, 4)]
        half = (3 * inter[0] * inter[1] >= (a[5] * a[6])[:, None] + b[5] * b[6]) & (inter[0] * inter[1] > 0) & (a[1][:, None] == b[1])
        want = set(zip(*(v.tolist() for v in np.nonzero(half)), strict=True))
        assert len(want) > 50 and want <= set(pairs)
        assert not like or len(pairs) < 4 * len(want)
        i, j = tiles._halves([tiles._edges(a), tiles._edges([v[order] for v in b])], row, start, n)
        assert set(zip(i.tolist(), order[j].tolist(), strict=True)) == want


def test_each_pair_of_tiles_is_a_task(spark, monkeypatch):
    monkeypatch.setattr(tiles, "LEAST", 40)
    df = QUERIES["layout_similarity"](spark, SF)
    assert df.rdd.getNumPartitions() == 10
