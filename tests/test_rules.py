"""Known answers of the rules over records, boxes and states."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.actions import FOLLOWS, STATES, hit_agreement, holds_now, transition
from quillon.functions.geometry import Box, focal, geometry_cause, grid_hits, pieces, union_area
from quillon.functions.records import consent_cause, exact_record, finding_cause, must_redact, output_cause
from quillon.operators.scheduling import laid_out, planned


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


SOUND = '{"kind":"UNREAD_REGION","box":{"x":1,"y":2,"w":3,"h":4},"score":0.5,"regionId":"canvas:1","treatment":"REDACT_UNREAD"}'
READ = '{"kind":"READ_TEXT","box":{"x":1,"y":2,"w":3,"h":4},"length":3,"piiClass":"PHONE","ref":null}'


@pytest.mark.parametrize(
    ("json", "cause"),
    [
        (SOUND, "OK"), (READ, "OK"), ("null", "NOT_AN_OBJECT"), ("[]", "NOT_AN_OBJECT"), ("{", "NOT_AN_OBJECT"), ("{}", "MISSING_KIND"), ('{"kind":1}', "UNKNOWN_KIND"), ('{"kind":"read_text"}', "UNKNOWN_KIND"),
        (SOUND.replace("0.5", "1"), "OK"), (SOUND.replace("0.5", "-0.1"), "UNREAD_REGION_SCORE"), (SOUND.replace("0.5", "null"), "UNREAD_REGION_SCORE"), (SOUND.replace('"w":3', '"w":0'), "UNREAD_REGION_GEOMETRY"),
        (SOUND.replace('"h":4', '"h":4,"d":1'), "UNREAD_REGION_GEOMETRY"), (SOUND[:-1] + ',"z":1,"piiClass":null}', "UNREAD_REGION_EXTRA_FIELD:piiClass,z"), ('{"kind":"READ_TEXT"}', "READ_TEXT_MISSING_FIELD:box,length,piiClass,ref"),
        (READ.replace('"PHONE"', '"phone"'), "READ_TEXT_UNKNOWN_CLASS"), (READ.replace('"PHONE"', "null"), "OK"), (READ.replace('"ref":null', '"ref":true'), "READ_TEXT_REF"), (READ.replace('"length":3', '"length":3.5'), "READ_TEXT_LENGTH"),
    ],
)
def test_findings(spark, json, cause):
    assert one(spark, finding_cause(F.lit(json))) == cause


def test_redaction_need(spark):
    assert one(spark, must_redact(F.lit(SOUND)))
    assert one(spark, must_redact(F.lit(READ)))
    assert not one(spark, must_redact(F.lit(READ.replace('"PHONE"', "null"))))


def test_consent(spark):
    request = {k: F.lit(k) for k in ("consentId", "sessionId", "origin", "documentId", "target")}
    allow = '{"kind":"ALLOW_ONCE","consentId":"consentId","sessionId":"sessionId","origin":"origin","documentId":"documentId","target":"target"}'
    cases = {
        allow: "OK", allow.replace('"origin":"origin"', '"origin":"x"'): "ORIGIN_MISMATCH", allow.replace('"consentId":"consentId"', '"consentId":"x"').replace('"origin":"origin"', '"origin":"x"'): "NOT_THIS_CONSENT",
        allow[:-1] + ',"more":1}': "MALFORMED_CONSENT", '{"kind":"DENY","consentId":"consentId"}': "CONSENT_DENIED", '{"kind":"DENY","consentId":"y"}': "NOT_THIS_CONSENT", '{"kind":"DENY"}': "MALFORMED_CONSENT", "7": "MALFORMED_CONSENT", "": "MALFORMED_CONSENT",
    }
    for answer, cause in cases.items():
        assert one(spark, consent_cause(F.lit(answer), request)) == cause, answer


def test_geometry(spark):
    def cause(*v):
        return one(spark, geometry_cause(*[F.lit(float(x)) for x in v]))

    assert cause(1, 1, 1043, 600, 1565, 900, 0, 0) == "OK"
    assert cause(1, 1, 1000, 600, 1500, 700, 0, 0) == "CAPTURE_DIMENSION_MISMATCH"
    assert cause(0, 1, 1000, 600, 1500, 900, 0, 0) == "COORDINATE_TRANSFORM_AMBIGUOUS"
    assert cause(1, 1, 1000, 600, 1500, 900, float("nan"), 0) == "COORDINATE_TRANSFORM_AMBIGUOUS"


def test_areas_against_pixels(spark):
    rnd = random.Random(3)

    def struct(b):
        return F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in zip("xywh", b, strict=True)])

    def pixels(b):
        return {(x, y) for x in range(b[0], b[0] + b[2]) for y in range(b[1], b[1] + b[3])}

    for _ in range(12):
        boxes = [(rnd.randint(0, 12), rnd.randint(0, 12), rnd.randint(1, 9), rnd.randint(1, 9)) for _ in range(rnd.randint(1, 7))]
        assert one(spark, union_area(F.array(*map(struct, boxes)))) == len(set().union(*map(pixels, boxes)))
        a, b = boxes[0], boxes[-1]
        left = one(spark, pieces(Box.within(struct(a)), Box.within(struct(b))))
        parts = [pixels((r["x"], r["y"], r["w"], r["h"])) for r in left]
        assert sum(map(len, parts)) == len(set().union(*parts))
        assert set().union(*parts) == pixels(a) - pixels(b)
    assert one(spark, union_area(F.array().cast("array<struct<x:bigint,y:bigint,w:bigint,h:bigint>>"))) == 0
    box = Box(*map(F.lit, (0, 0, 10, 10)))
    assert one(spark, grid_hits(box, Box(*map(F.lit, (0, 0, 5, 10))), 5)) == 15
    assert one(spark, grid_hits(box, Box(*[F.lit(None).cast("int")] * 4), 9)) == 81


def test_focal_loss(spark):
    assert one(spark, focal(F.lit(0.0), F.lit(1.0))) == pytest.approx(0.25 * 0.25 * 0.6931471805599453)
    assert one(spark, focal(F.lit(40.0), F.lit(0.0))) == pytest.approx(30.0)


def test_states(spark):
    for before in STATES:
        for after in STATES:
            got = one(spark, transition(F.lit(before), F.lit(after)))
            assert got == ("AFTER_TERMINAL" if before in ("DONE", "REFUSED") else "OK" if after in FOLLOWS[before] or after == "REFUSED" else "NOT_A_TRANSITION")
    assert one(spark, transition(F.lit(None).cast("string"), F.lit("IDLE"))) == "START"


def test_agreement_and_postconditions(spark):
    assert [one(spark, hit_agreement(F.lit("a"), F.lit(t).cast("string"), F.lit(ms).cast("int"))) for t, ms in (("a", 5), ("b", 5), (None, 5), ("a", None), ("a", 2001))] == ["MATCH", "MISMATCH", "UNKNOWN", "UNKNOWN", "UNKNOWN"]

    def holds(kind, expected, enabled=True, name="n", seen=True, focused="#a"):
        return one(spark, holds_now(F.lit(kind), F.lit(expected), F.lit(enabled), F.lit(name), F.lit("#a"), F.lit(seen), F.lit(focused).cast("string")))

    assert holds("TARGET_ENABLED", "true") == "HOLDS"
    assert holds("TARGET_ENABLED", "false") == "DOES_NOT_HOLD"
    assert holds("TARGET_NAME", "m") == "DOES_NOT_HOLD"
    assert holds("FOCUS_ON_TARGET", "", focused=None) == "DOES_NOT_HOLD"
    assert holds("FOCUS_ON_TARGET", "", seen=False) == "UNKNOWN"


def test_outputs(spark):
    def cause(dims, data, h=1, w=2):
        return one(spark, output_cause(F.array(*map(F.lit, dims)) if dims is not None else F.lit(None).cast("array<int>"), F.array(*map(F.lit, data)), F.lit(h), F.lit(w)))

    assert cause([1, 1, 1, 2], [0.0, 1.0]) == "OK"
    assert cause([1, 1, 1, 2], [0.0, float("nan")]) == "NOT_A_PROBABILITY"
    assert cause([1, 1, 1, 2], [0.5]) == "OTHER_LENGTH"
    assert cause([1, 1, 2, 2], [0.5, 0.5]) == "OTHER_SIZE"
    assert cause([1, 3, 1, 2], [0.5, 0.5]) == "NOT_ONE_MAP"
    assert cause(None, [0.5, 0.5]) == "NO_DIMS"
    assert one(spark, exact_record(F.lit('{"x":1,"y":"2","text":"a"}'), ("x", "y"))) == ["box field text is not permitted", "box field y is not a finite number"]


def test_overflow():
    assert laid_out([60, 50, 40, 1], 100) == ([0, 2], [1, 3])
    assert laid_out([150, 1], 100) == ([0], [1])
    assert planned([60, 50, 40, 1], 4, 100, 5) == ([0, 1, 0, 1], 2)
    assert planned([90] * 6, 6, 100, 2) == ([0, 1, 2, None, None, None], 3)
    rnd = random.Random(1)
    for _ in range(50):
        sizes = [rnd.randint(1, 99) for _ in range(rnd.randint(0, 60))]
        sample, made = planned(sizes, 6, 100, 1000)
        assert None not in sample
        for k in range(made):
            own = [n for n, s in zip(sizes, sample, strict=True) if s == k]
            assert 0 < len(own) <= 6
            assert sum(own) <= 100 or len(own) == 1
