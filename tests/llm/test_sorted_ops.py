"""Passages, hard negatives, sequenced changes, and what earlier operators gained, against brute force."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import base, changes, hard_negatives, line_dedup, mixing, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, marks string, bucket string, label string"


def make(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d") for i, t in texts], DOCS)


def removed(texts):
    """(bytes, removed, spans, digest) of documents in order."""
    seen, out = set(), []
    for t in texts:
        x, spans = (t or "").encode(), []
        for p in range(len(x) - 99):
            if x[p : p + 100] in seen:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + 100
                else:
                    spans.append([p, p + 100])
            seen.add(x[p : p + 100])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + x[at:a], b
        out.append((len(x), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + x[at:]).hexdigest()))
    return out


def passages(spark, texts):
    out = suffix_dedup.passage_dedup(make(spark, list(enumerate(texts))).repartition(3)).orderBy("doc_id").collect()
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out]


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1_500)
    monkeypatch.setattr(suffix_dedup, "SLAB", 1_500)


def corpus(rnd, letters, n):
    word = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    shared = [word(rnd.randint(90, 400)) for _ in range(6)]
    texts = [None, "", "short", "é" * 120]
    for _ in range(n):
        parts = [word(rnd.randint(0, 150))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(shared)
            a = rnd.randint(0, 60)
            parts += [p[a : len(p) - rnd.randint(0, 60)], word(rnd.randint(0, 90))]
        texts.append("".join(parts))
    return texts + [texts[6], texts[7] + "x", "ab" * 300, "ab" * 310, "a" * 1000, "\x00" * 250, "q" * 130 + "\x00" * 150]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é\n"])
def test_passages_by_suffix_order(spark, small_tasks, letters):
    texts = corpus(random.Random(3), letters, 40)
    assert passages(spark, texts) == removed(texts)


def test_passages_at_full_slabs(spark):
    texts = corpus(random.Random(4), "abcdefgh", 60)
    assert passages(spark, texts) == removed(texts)


def test_passage_of_100_bytes_and_not_of_99(spark):
    rnd = random.Random(8)
    p = "".join(rnd.choice("abcdefghijkl") for _ in range(100))
    texts = [p, "x" + p + "y", p[:99] + "z", "é" + p[1:], p + p]
    assert passages(spark, texts) == removed(texts)
    assert [x[1] for x in removed(texts)] == [0, 100, 0, 0, 200]


def test_a_gram_with_many_units_is_dealt_by_units(spark, monkeypatch, small_tasks):
    monkeypatch.setattr(suffix_dedup, "HEAVY", 2)
    rnd = random.Random(9)
    word = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    p = word(60)
    texts = [word(70) + p + word(70) for _ in range(30)]
    texts += [t[20:170] for t in texts[:10]]
    assert passages(spark, texts) == removed(texts)


def test_passages_rows_of_one_id_nulls_and_empty_tables(spark):
    text = "".join(random.Random(1).choices("abcdef", k=300))
    got = suffix_dedup.passage_dedup(make(spark, [(1, text), (1, text), (1, "other"), (None, text), (None, None)])).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == Counter({(1, 300, 0): 1, (1, 300, 300): 1, (1, 5, 0): 1, (None, 300, 300): 1, (None, 0, 0): 1})
    assert suffix_dedup.passage_dedup(make(spark, [])).count() == 0
    spans = suffix_dedup.passage_dedup(make(spark, [(1, text), (2, "x" + text)])).orderBy("doc_id").collect()[1]["spans"]
    assert spans == [1, 301]


def mined(rows):
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for a, al, av in rows:
        if a is None or a % 100:
            continue
        scores = [(sum(x * y for x, y in zip(av, v, strict=True)), i, label) for i, label, v in rows if i != a and len(v) == len(av)]
        for ps, p, _ in sorted((s for s in scores if s[2] == al), key=key)[:5]:
            band = [s for s in scores if s[2] != al and 30 * ps <= 100 * s[0] <= 90 * ps]
            out += [(a, p, n + 1, i, ps, s) for n, (s, i, _) in enumerate(sorted(band, key=key)[:10])]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, block string, dim string, q string"


@pytest.mark.parametrize("scale", [0.15, 30.0, 0.0])
def test_hard_negatives(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(5, 8)) * scale
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rnd.normal(size=8) * scale / 2], int(rnd.integers(3))) for i in range(900)]
    rows += [(1000, None, 1), (1100, rows[0][1], None), (1200, [1.0, None] + [0.0] * 6, 1), (1300, [float("nan")] * 8, 1), (1400, [float("inf")] + [0.0] * 7, 1), (1500, [0.5, 0.25], 1), (1501, [0.5, 0.25], 1)]
    rows += [(1502, [0.25, 0.25], 2), (None, rows[0][1], rows[0][2]), (1600, [], 1), (1601, [], 1), (1602, [], 2), *((2000 + i, rows[100][1], (rows[100][2] + 1) % 3) for i in range(20))]
    got = hard_negatives.hard_negatives(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)).collect()
    assert sorted(map(tuple, got), key=repr) == mined(rows)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0


def test_intervals_hold_the_score():
    rnd = np.random.default_rng(5)
    a, c = rnd.integers(-300, 300, (6, 16)), rnd.integers(-300, 300, (40, 16))
    s = hard_negatives.Sliced(a, c, np.ones((6, 40), bool))
    real, widths = a @ c.T, []
    while s.left:
        s.step()
        low, high = s.bounds()
        assert (low <= real).all() and (real <= high).all()
        widths.append((high - low).max())
    assert widths == sorted(widths, reverse=True) and widths[-1] == 0


CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double, bucket string, n string"


def replayed(rows):
    rows = set(rows)
    numbers = defaultdict(set)
    for r in rows:
        numbers[r[1]].add(r[2])
    rank = {c: {s: i + 1 for i, s in enumerate(sorted(v, key=lambda x: (x is None, x)))} for c, v in numbers.items()}
    batches, state, out, final, newest = defaultdict(list), {}, {}, {}, None
    for r in rows:
        h = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
        if r[4] is not None and h % 11:
            day = (r[4].date() - datetime.date(1970, 1, 1)).days + 2 * (h % 4)
            batches[min(8, 1 + (day - 19723) * 8 // 160)].append((day, r[0] if r[0] is not None else 2**63, r[1], rank[r[1]][r[2]], r[3] or "U", r[7], r[8]))

    def run(client, s, batch, missed):
        while s["next"] in s["held"]:
            _, change, _, _, op, city, balance = s["held"].pop(s["next"])
            s["next"] += 1
            if op in "ID":
                s["city"], s["balance"] = (city, balance) if op == "I" else (None, None)
            else:
                s["city"], s["balance"] = (city if city is not None else s["city"]), (balance if balance is not None else s["balance"])
            out[change] = [client, "applied", batch, missed, s["city"], None if s["balance"] is None else math.floor(100 * s["balance"] + 0.5), False]
            final[client], missed = (change, op), 0

    for b in range(1, 10):
        for client, s in state.items():
            while s["held"] and (b == 9 or (newest is not None and min(x[0] for x in s["held"].values()) + 5 <= newest)):
                missed = min(s["held"]) - s["next"]
                s["next"] += missed
                run(client, s, b, missed)
        for x in sorted(batches[b], key=lambda x: x[:2]):
            s = state.setdefault(x[2], {"next": 1, "held": {}, "city": None, "balance": None})
            if x[3] in s["held"] or x[3] < s["next"]:
                out[x[1]] = [x[2], "rejected", b, 0, None, None, False]
            else:
                s["held"][x[3]] = x
                run(x[2], s, b, 0)
        newest = max([x[0] for x in batches[b]] + ([] if newest is None else [newest]), default=None)
    for change, op in final.values():
        out[change][-1] = op != "D"
    return sorted(((k if k < 2**63 else None, *v) for k, v in out.items()), key=repr)


def test_sequenced_changes(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(700):
        client = rnd.choice([1, 1, 1, 2, 3, 4, None])
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i * 165 / 700 + rnd.choice([0, 0, 0, 9]), hours=rnd.randint(0, 23))
        if 60 < i < 120:
            client = 5
        seq = i if rnd.random() < 0.9 else rnd.choice([i - 7, None if client == 4 else i - 15])
        rows.append((i, client, seq, rnd.choice("IUUUUD") if i % 50 else None, at if i % 40 else None, "s", "g", rnd.choice([None, "A", "B", "C"]), rnd.choice([None, 1.005, -2.5, 7.25])))
    rows.append((None, 6, 1, "I", datetime.datetime(2024, 2, 1), "s", "g", "Z", 1.0))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + rows[:50]], CHANGES)
    got = [(r["change_id"], r["client_id"], r["status"], r["batch"], r["missed"], r["city"], r["cents"], r["current"]) for r in changes.apply_changes(df.repartition(3)).collect()]
    assert sorted(got, key=repr) == replayed(rows)
    assert {r[2] for r in got} == {"applied", "rejected"} and max(r[3] for r in got) == 9 and any(r[4] > 0 for r in got)


def test_no_changes(spark):
    assert changes.apply_changes(spark.createDataFrame([], CHANGES), batches=2).count() == 0


def test_numbers_over_partitions(spark):
    rows = [(c, s) for c in (1, 2, 3) for s in [*range(0, 400, 3), *range(0, 400, 3), None]]
    got = changes.numbered(spark.createDataFrame(rows, "client long, seq long").repartition(5)).distinct().collect()
    assert {(r["client"], r["seq"]): r["n"] for r in got} == {(c, s): 135 if s is None else s // 3 + 1 for c, s in rows}


def test_draws_do_not_hang_on_partitions(spark):
    texts = [(i % 40, "word " * (1 + i % 7)) for i in range(400)] + [(None, "a b c")] * 30 + [(7, "same text")] * 50
    docs = make(spark, texts).withColumn("source", F.concat(F.lit("s"), F.length("text") % 3))
    results = []
    for df in (docs.repartition(1), docs.repartition(7, "text"), docs.repartition(3).orderBy(F.desc("n_chars"))):
        results.append((Counter(map(tuple, mixing.mix(df).collect())), Counter(map(tuple, mixing.emit_copies(df).collect()))))
    assert results[0] == results[1] == results[2]
    mixed, emitted = results[0]
    assert sum(emitted.values()) == sum(r[5] * n for r, n in mixed.items()) and len({r[5] for r in mixed}) > 1


def lines_with_a_common_middle(n, rnd):
    word = lambda: "".join(rnd.choice("bcdfgh") for _ in range(5))
    return [" ".join(["The", "licence", "of", *(word() for _ in range(7)), "all", "of", "these", "words", *(word() for _ in range(6))]) for _ in range(n)]


def test_lines_with_a_common_stretch_make_pairs_in_proportion(spark):
    made = []
    for n in (500, 1000, 2000):
        texts = spark.createDataFrame([(i, line) for i, line in enumerate(lines_with_a_common_middle(n, random.Random(n)))], "lo long, line string")
        texts = texts.select("lo", F.xxhash64("line").alias("h"), F.lit(20).alias("n"), F.lit(1).cast("long").alias("leaf"), F.split("line", " ").alias("token"))
        rest = F.slice("token", F.lit(line_dedup.DEPTH + 1), F.size("token"))
        keyed = texts.select(F.struct("lo", "h").alias("me"), F.explode(line_dedup.stretches(rest, F.col("n"), F.col("leaf"))).alias("at")).select("me", "at.key", "at.i")
        lone = texts.select(F.col("h").alias("lh"))
        made.append(line_dedup.candidates(keyed, lone, texts).count())
    assert made[2] <= 2000 and made[2] <= 6 * max(made[0], 50)


def test_crowded_stretches_lose_no_template(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONE", 2)
    rnd = random.Random(12)
    lines = lines_with_a_common_middle(60, rnd)
    for line in lines[:30]:  # later ones that agree with an earlier one in 17 of 20 places
        w = line.split(" ")
        for i in rnd.sample([*range(3, 10), *range(14, 20)], 3):
            w[i] = "other"
        lines.append(" ".join(w))
    rnd.shuffle(lines)
    tokens = [x.split(" ") for x in lines]
    agree = lambda x, y: sum(a == b for a, b in zip(x, y, strict=True)) >= 0.75 * len(x)
    linked = {i for i in range(len(lines)) for j in range(i) if agree(tokens[i], tokens[j])}
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(make(spark, list(enumerate(lines)))).collect()}
    assert {i for i, n in got.items() if n} == linked


def test_the_gradient_is_that_of_the_plain_likelihood():
    rnd = random.Random(3)
    hits = [[[f for f in range(5) if rnd.random() < 0.4] or [0] for _ in range(rnd.randint(0, 4))] for _ in range(12)]
    toxic, plain = np.array([rnd.randint(0, 1) for _ in hits]), np.array([rnd.randint(0, 3) + (not h) for h in hits])

    def loss(w):
        total = 0.0
        for y, n, rows in zip(toxic, plain, hits, strict=True):
            miss = (1 - 1 / (1 + math.exp(-w[-1]))) ** n
            for row in rows:
                miss *= 1 - 1 / (1 + math.exp(-w[-1] - sum(w[f] for f in row)))
            total -= math.log(1 - miss) if y else math.log(miss)
        return total / len(hits) + toxicity.L2 * sum(x * x for x in w[:-1]) / 2

    w = np.array([rnd.uniform(-1, 1) for _ in range(5)] + [-0.7])
    g = toxicity.Bags(toxic, plain, hits).gradient(w)
    for k in range(6):
        e = np.eye(6)[k] * 1e-6
        assert abs((loss(w + e) - loss(w - e)) / 2e-6 - g[k]) < 1e-6


def test_an_id_that_comes_often_counts_once(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    docs = [(i, " ".join(word() for _ in range(12)) + (". you vile fool" if i % 2 else "")) for i in range(400)]
    flood = [(2, docs[2][1] + " harmlessword" * 3)] * 300
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    once = toxicity.fit(make(spark, docs[:2] + flood[:1] + docs[3:]), labels)
    often = toxicity.fit(make(spark, docs[:2] + flood + docs[3:]), labels)
    assert once.bias == often.bias and once.weights == often.weights
    few = toxicity.fit(make(spark, docs), labels, train_features=300)
    assert few.document("you vile fool")[0] > few.document("a b c")[0]


def test_toxicity_of_odd_rows(spark):
    docs = [(i, ("you vile fool. " if i % 2 else "a kind word. ") * (1 + i % 3)) for i in range(200)] + [(500, None), (501, ""), (None, "you vile fool"), (502, "a kind word " * 60_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None), (7, 5)], "doc_id long, toxic int")
    df = make(spark, docs).withColumn("toxic", F.lit("x")).withColumn("score", F.lit(1)).withColumn("label_id", F.lit(2))
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert len(got) == 204 and got[None] >= 0.5 > got[502] and got[500] == got[501] and all(0 <= x <= 1 for x in got.values())
    assert toxicity.passing(df, model).columns == df.columns


def test_a_sieve_loses_no_key(spark):
    keys, others = (spark.range(a, b).select(F.xxhash64("id").alias("k")) for a, b in ((0, 3000), (5000, 25000)))
    own, both = base.sieve(keys, "k"), keys.union(others)
    assert base.sifted(keys, F.col("k"), own).count() == 3000 and base.sifted(others, F.col("k"), own).count() < 1000
    assert base.sifted(both, F.col("k"), own).count() + base.sifted(both, F.col("k"), own, keep=False).count() == 23000
    assert "hashpartitioning(k" not in base.sifted(both, F.col("k"), own)._jdf.queryExecution().toString()
    none = base.sieve(keys.where("k is null"), "k")
    assert base.sifted(both, F.col("k"), none).count() == 0 and base.sifted(both, F.col("k"), none, keep=False).count() == 23000


def test_texts_of_lines_move_only_where_they_may_meet(spark, monkeypatch):
    """However many leaves and lost lines there are: nothing but what passes a sieve is dealt by its leaf or its document."""
    plans = {}
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0, raising=False)
    monkeypatch.setattr(line_dedup, "cut", lambda df, label="cut", *a: plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()) and base.cut(df, label, *a))
    rows = [(i, f"the old house of number{chr(97 + i % 20)}x was sold\nrow {chr(97 + i % 26)}{chr(97 + i // 26)} alone here") for i in range(60)] + [(60, "nothing like it"), (61, None)]
    out = line_dedup.line_dedup(make(spark, rows))
    assert re.search(r"Join LeftSemi, .*words", plans["leaf-lines"]) and "wide_leaf" not in plans["leaf-lines"]
    last = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in last and re.search(r"Join LeftAnti, .*words", last)
    assert {r["doc_id"]: r["n_dropped"] for r in out.collect()} == {i: int(0 < i < 60) for i in range(62)}


def test_a_long_line_is_parted_in_proportion(spark, monkeypatch):
    """The tokens after the first ones are made once a line, not once for each of its stretches."""
    plans = {}
    monkeypatch.setattr(line_dedup, "cut", lambda df, label="cut", *a: plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()) and base.cut(df, label, *a))
    line_dedup.line_dedup(make(spark, [(i, "a b c " + f"w{chr(97 + i)} " * 50) for i in range(4)]))
    made = next(x for x in plans["stretches"].splitlines() if "Generate" in x)
    assert "explode" in made and "token#" not in made
