"""Data sources, keyed state over restarts, automata: against plain Python, and what happens to work that is done twice or lost."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import automaton
from quillon.plans.confirmations import KEEP_MS
from quillon.sources.named_files import Attempts, ManifestReader, checked, registered
from quillon.streaming.confirmations import OPS, at_of, confirmed, confirmed_in_buckets
from quillon.streaming.runs import run_to_end


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def row(name, body):
    return {"name": name, "sha256": hashlib.sha256(body).hexdigest(), "body": body}


def test_a_lost_and_repeated_task_leaves_one_copy(tmp_path):
    a = Attempts(str(tmp_path))
    a.put(iter([row("x/a.txt", b"1"), row("b.txt", b"2")]), "7")  # done, but its message is lost
    first, empty = a.put(iter([row("x/a.txt", b"1"), row("b.txt", b"2")]), "7"), a.put(iter([]), "7")
    assert not (tmp_path / "batch=7").exists()
    a.commit([first, None, empty], "7")
    assert files(tmp_path) == ["batch=7/part-00000/b.txt", "batch=7/part-00000/x/a.txt"]
    # the whole batch once more, as after a driver that died past its commit
    a.commit([a.put(iter([row("c.txt", b"3")]), "7")], "7")
    assert files(tmp_path) == ["batch=7/part-00000/b.txt", "batch=7/part-00000/x/a.txt"]


def test_a_body_that_changed_is_not_written(tmp_path):
    a = Attempts(str(tmp_path))
    for bad in ({**row("a", b"1"), "body": b"2"}, row("../a", b"1"), row("/a", b"1"), row("", b"1")):
        with pytest.raises(ValueError):
            a.put(iter([row("ok", b"0"), bad]), "0")
    a.clear("_attempt-0-")
    assert files(tmp_path) == []


def test_writer_and_stream_writer(spark, tmp_path):
    registered(spark)
    rows = spark.range(20).select(F.format_string("f%s", "id").alias("name"), F.format_string("body %s", "id").cast("binary").alias("body"))
    rows = rows.select("name", F.sha2("body", 256).alias("sha256"), "body")
    for _ in range(2):
        rows.repartition(3).write.format("named_files").option("path", str(tmp_path / "w")).option("batch", "5").mode("append").save()
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "w/batch=5"))
    assert sorted(bytes(r["content"]) for r in back.collect()) == sorted(b"body %d" % i for i in range(20))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream.writeStream.format("named_files").option("path", str(tmp_path / "s")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len([f for f in files(tmp_path / "s") if f.startswith("batch=0/") and not f.endswith(".crc")]) == 20


def manifest(**changes):
    samples = [{"id": f"dev-0000{i}", "split": "dev", "framePath": f"frames-dev/dev-0000{i}.png", "frame": {"w": 4, "h": 3, "sha256": "s"}, "annotations": [{"id": f"dev-0000{i}-e0", "cls": "link", "box": {"x": 1, "y": 2, "w": 3, "h": 4}}]} for i in range(3)]
    samples[1].update(changes)
    return {"name": "n", "version": "1", "split": "dev", "samples": samples}


def test_rules_of_a_manifest():
    first = lambda m: next(iter(checked("m", "dev", m)))[1]
    assert [r[5] for r in checked("m", "dev", manifest())] == ["dev-00000", "dev-00001", "dev-00002"]
    assert first({**manifest(), "split": "train"}) == first(None) == first([]) == "DECLARES_OTHER_SPLIT"
    assert first(manifest(split="train")) == first(manifest(id="dev-1")) == first(manifest(id="train-00001")) == "FOREIGN_SAMPLE"
    assert first(manifest(id="dev-00000", framePath="frames-dev/dev-00000.png")) == "DUPLICATE_SAMPLE"
    assert first(manifest(framePath="frames-dev/dev-00000.png")) == "FOREIGN_FRAME"
    assert first(manifest(annotations=[{"id": "dev-00001-e0"}, {"id": "dev-00001-e0"}])) == first(manifest(annotations=[{"id": "dev-00002-e0"}])) == "FOREIGN_ANNOTATION"


def test_manifest_source(spark, tmp_path):
    registered(spark)
    with pytest.raises(ValueError, match="may be opened"):
        ManifestReader({"path": "/nowhere", "split": "test"})
    for name, m in (("a", manifest()), ("b", manifest(split="train"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest-dev.json").write_text(json.dumps(m))
        (tmp_path / name / "manifest-test.json").write_text("not to be opened")
    df = spark.read.format("split_manifest").option("split", "dev")
    got = df.option("onProblem", "report").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 2
    assert {(r["document"], r["problem"]) for r in got.collect()} == {("a", None), ("b", "FOREIGN_SAMPLE")}
    assert got.where("id = 'dev-00001'").select("annotations.x").first()[0] == [1.0]
    with pytest.raises(Exception, match="FOREIGN_SAMPLE"):
        df.option("onProblem", "fail").load(str(tmp_path)).collect()


def op(confirmation, i, ms, kind, **changes):
    r = {"selector": "#a", "role": "button", "name": "Pay", "origin": "https://a", "frame": 1, "node": 5, "purpose": "pay", "ttl_ms": None} | changes
    return (confirmation, i, None, ms, kind, *(r[k] for k in ("selector", "role", "name", "origin", "frame", "node", "purpose", "ttl_ms")))


def test_confirmations_over_restarts(spark, tmp_path):
    """Each part of the operations is a start of its own; state comes from the checkpoint."""
    parts = [
        [op(1, 0, 1000, "RECORD", ttl_ms=5000.0), op(1, 1, 1500, "STATE"), op(2, 2, 1000, "STATE"), op(3, 3, 1000, "RECORD", ttl_ms=100.0, purpose=" "), op(4, 4, 1000, "RECORD", ttl_ms=100.0), op(5, 14, 1000, "RECORD", ttl_ms=9000.0), op(6, 19, 1000, "RECORD", ttl_ms=0.0), op(7, 20, 1000, "RECORD", role="", ttl_ms=5.0)],
        [op(1, 5, 2000, "COVERS"), op(1, 6, 2000, "COVERS", origin=None), op(1, 7, 2000, "COVERS", frame=2), op(1, 8, 2001, "COVERS", name="Pay now"), op(1, 9, 2002, "MINT", origin="https://b"), op(1, 10, 2003, "MINT"), op(3, 11, 2000, "SPEND"), op(4, 12, 2000, "STATE"), op(5, 15, 2000, "SPEND")],
        [op(1, 13, 7000, "MINT"), op(1, 16, 7001, "STATE"), op(5, 17, 7000, "SPEND"), op(4, 18, 6000, "COVERS")],
    ]
    got = {}
    for part in parts:
        df = spark.createDataFrame(part, OPS).withColumn("at", at_of(F.col("ms")))
        df.write.mode("append").parquet(str(tmp_path / "in"))
        run_to_end(confirmed(spark.readStream.schema(OPS).parquet(str(tmp_path / "in")), KEEP_MS), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r["id"]: r["verdict"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {
        0: "RECORDED", 1: "LIVE", 2: "NOT_RECORDED", 3: "EMPTY_PURPOSE", 4: "RECORDED", 5: "COVERS", 6: "ORIGIN_NOT_SUPPLIED", 7: "DIFFERENT_FRAME", 8: "DIFFERENT_TARGET", 9: "DIFFERENT_ORIGIN", 10: "MINTED",
        11: "NOT_RECORDED", 12: "EXPIRED", 13: "ALREADY_SPENT", 14: "RECORDED", 15: "SPENT", 16: "SPENT", 17: "ALREADY_SPENT", 18: "EXPIRED", 19: "INVALID_TTL", 20: "INVALID_SUBJECT",
    }


def test_timers_clear_what_is_over(spark, tmp_path):
    for part in ([op(1, 0, 1000, "RECORD", ttl_ms=10.0), op(2, 1, 1000, "RECORD", ttl_ms=90_000.0)], [op(3, 2, 50_000, "STATE")], [op(3, 3, 60_000, "STATE"), op(2, 4, 60_000, "STATE")]):
        spark.createDataFrame(part, OPS).withColumn("at", at_of(F.col("ms"))).write.mode("append").parquet(str(tmp_path / "in"))
        run_to_end(confirmed(spark.readStream.schema(OPS).parquet(str(tmp_path / "in")), 1000), str(tmp_path / "out"), str(tmp_path / "ck"))
    state = spark.read.format("statestore").option("stateVarName", "recorded").load(str(tmp_path / "ck"))
    assert {r["key"]["confirmation"] for r in state.collect()} == {2}
    assert {r["id"]: r["verdict"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}[4] == "LIVE"


def test_confirmations_share_the_state_of_their_bucket(spark, tmp_path):
    """Many confirmations are one key of the state; what they hear is what each hears by itself, over starts and after the timers."""
    rnd, n = random.Random(2), 40
    kinds = ("RECORD", "STATE", "COVERS", "MINT", "SPEND")
    parts = [[op(rnd.randrange(n), 1000 * at + i, 20_000 * at + rnd.randrange(20_000), rnd.choice(kinds), ttl_ms=rnd.choice([500.0, 9000.0, 90_000.0]), frame=rnd.choice([1, 1, 2])) for i in range(120)] for at in range(3)]
    runs = {"each": lambda d: confirmed(d, 1000), "dealt": lambda d: confirmed_in_buckets(d, 1000, 2)}
    got = {}
    for name, run in runs.items():
        for part in parts:
            spark.createDataFrame(part, OPS).withColumn("at", at_of(F.col("ms"))).write.mode("append").parquet(str(tmp_path / name / "in"))
            run_to_end(run(spark.readStream.schema(OPS).parquet(str(tmp_path / name / "in"))), str(tmp_path / name / "out"), str(tmp_path / name / "ck"))
        got[name] = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name / "out")).select("id", "confirmation", "op", "verdict", "purpose").collect())
    assert got["dealt"] == got["each"] and len(got["each"]) == 360 and {"MINTED", "ALREADY_SPENT", "EXPIRED", "DIFFERENT_FRAME"} <= {r[3] for r in got["each"]}
    held = {name: spark.read.format("statestore").option("stateVarName", "recorded").load(str(tmp_path / name / "ck")) for name in ("each", "dealt")}
    assert {r["key"]["bucket"] for r in held["dealt"].collect()} <= {0, 1}
    # the timers left what is live: the same confirmations either way
    assert {r["list_element"]["confirmation"] for r in held["dealt"].collect()} == {r["key"]["confirmation"] for r in held["each"].collect()}


def test_held_values_in_texts(spark, monkeypatch):
    monkeypatch.setattr(automaton, "VALUES", 3)
    monkeypatch.setattr(automaton, "TEXTS", 5)
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("ab1O ") for _ in range(n))
    values = [(s, 100 * s + i, rnd.choice(["NAME", "PHONE"]), word(rnd.randint(1, 7))) for s in range(3) for i in range(10)]
    texts = [(rnd.randrange(4), i, rnd.choice([word(30), rnd.choice(values)[3], "", "  ", word(3)])) for i in range(120)]
    digits = lambda v: re.sub("[^0-9]", "", v.translate(str.maketrans("oOlIiSs", "0011155")))
    letters = lambda v: re.sub("[^a-z0-9]", "", v.lower())
    expected = {}
    for s, i, text in texts:
        hits = [(vid, cls) for vs, vid, cls, v in values if vs == s and text.strip() and (v == text or any(len(f(v)) >= 4 and f(v) in f(text) for f in (digits, letters)))]
        if hits:
            expected[i] = min(hits)
    got = automaton.held(spark.createDataFrame(values, "session long, vid long, cls string, value string"), spark.createDataFrame(texts, "session long, id long, text string"))
    assert {r["id"]: (r["vid"], r["cls"]) for r in got.collect()} == expected and len(expected) > 10
