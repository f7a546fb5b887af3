"""Samples against a plain stream of numbers and plain JSON; seals against any order."""

import json

from pyspark.sql import functions as F

from quillon.functions.canonical import canonical
from quillon.plans import samples as s

SF = "/root/testdata/sf0.001"


def stream(seed):
    m, a, out = 0xFFFFFFFF, seed & 0xFFFFFFFF, []
    for _ in range(s.DRAWS):
        a = (a + 0x6D2B79F5) & m
        t = (a ^ a >> 15) * (a | 1) & m
        t ^= (t + ((t ^ t >> 7) * (t | 61) & m)) & m
        out.append((t ^ t >> 14) / 2**32)
    return out


def test_samples_and_their_text(spark):
    d = s.samples(spark, SF)
    got = {r["id"]: r["j"] for r in d.select("s.id", canonical(F.col("s"), d.schema["s"].dataType).alias("j")).where("i in (0, 1, 2, 40)").collect()}
    assert len(got) == 12
    for own, text in got.items():
        split, i = own.split("-")
        seed = 42 + ("train", "dev", "test").index(split) * 1_000_000 + int(i)
        u = stream(seed)
        _, cards, inputs = s.DENSITIES[int(i) % 3]
        notes = []
        for n, (cls, x, y, w, h) in enumerate(s.screen(cards, inputs, u.__getitem__, lambda v: round(v, 3))):
            seen = "VISIBLE" if x >= 0 and y >= 0 and x + w <= 1024 and y + h <= 640 else "CLIPPED" if x < 1024 and y < 640 and x + w > 0 and y + h > 0 else "OFFSCREEN"
            box = {k: int(v) if v == int(v) else round(v, 6) for k, v in zip("xywh", (x, y, w, h), strict=True)}
            notes.append({"id": f"{own}-a{n + 1}", "cls": cls, "box": box, "visibility": seen})
        want = {"id": own, "split": split, "provenance": {"kind": "SYNTHETIC", "generator": "screens@1", "seed": seed}, "viewportCss": {"w": 1024, "h": 640}, "dpr": 2, "zoom": 1, "captureSize": {"w": 2048, "h": 1280}, "scroll": {"x": 0, "y": 0}, "annotations": sorted(notes, key=lambda a: a["id"])}
        assert text == json.dumps(want, separators=(",", ":"))


def test_any_order_has_one_seal(spark, monkeypatch):
    monkeypatch.setattr(s, "SEALED", 4)
    d = s.samples(spark, SF)
    seals = lambda x: sorted(tuple(r) for r in s.sealed(x).collect())
    turned = d.withColumn("s", F.col("s").withField("annotations", F.reverse("s.annotations"))).orderBy(F.desc("i")).repartition(5)
    assert seals(d) == seals(turned)
    moved = d.withColumn("s", F.when(F.col("s.id") == "dev-0003", F.col("s").withField("zoom", F.lit(1.000001))).otherwise(F.col("s")))
    assert [a == b for a, b in zip(seals(d), seals(moved), strict=True)] == [False, True, True]
    tiny = d.withColumn("s", F.col("s").withField("zoom", F.lit(1.0000001)))
    assert seals(d) == seals(tiny)


def test_numbers_and_quotes(spark):
    row = spark.createDataFrame([(1.5, -0.0000001, 1e-5, 123456789.25, 'a"b\\c', None, [3.0, 2.5])], "a double, b double, c double, d double, e string, f string, g array<double>")
    out = row.select(canonical(F.struct(*row.columns), row.schema).alias("j")).first()[0]
    assert out == '{"a":1.5,"b":0,"c":0.00001,"d":123456789.25,"e":"a\\"b\\\\c","f":null,"g":[3,2.5]}'
