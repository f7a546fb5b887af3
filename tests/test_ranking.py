"""Two-level scans and distributed selection against plain Python, with groups that take many ranges and many rounds."""

import random

from pyspark.sql import functions as F

from quillon.operators.ranking import reverse_maximum, running, selected


def test_running_sums_and_reverse_maxima(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice("ab"), i, rnd.randint(0, 50), rnd.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, id long, a long, v double").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that a group takes several ranges here
    try:
        order = [F.desc("a"), F.col("id")]
        out = reverse_maximum(running(df, "g", order, {"total": F.col("a"), "seen": F.lit(1)}), "g", order, "v", "most")
        got = {r["id"]: (r["total"], r["seen"], r["most"]) for r in out.collect()}
        assert out.where("g = 'hot'").select("__p").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for g in ("hot", "a", "b"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        for i, r in enumerate(mine):
            assert got[r[1]] == (sum(x[2] for x in mine[: i + 1]), i + 1, max(x[3] for x in mine[i:]))


def test_selection(spark):
    rnd = random.Random(3)
    groups = {"even": [rnd.random() for _ in range(3000)], "few": [rnd.choice([1.0, 2.0, 3.0]) for _ in range(3000)], "one": [5.0] * 700, "tail": [rnd.expovariate(1) ** 9 for _ in range(2000)], "small": [2.0, 1.0], None: [1.0, 4.0, 9.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("small", None), ("void", None)]
    places = {"first": "1", "mid": "floor(n / 2) + 1", "third": "3", "most": "floor(0.99 * n)", "last": "n"}
    out = selected(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v", {n: F.expr(x) for n, x in places.items()}, few=20)
    got = {r["k"]: r for r in out.collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s, n = sorted(vs), len(vs)
        for name, at in {"first": 1, "mid": n // 2 + 1, "third": 3, "most": int(0.99 * n), "last": n}.items():
            assert got[k][name] == (s[at - 1] if 1 <= at <= n else None), (k, name)
        assert (got[k]["n"], got[k]["lo"], got[k]["hi"]) == (n, s[0], s[-1])
