"""Known answers of the scalar functions, masks, containers and scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import pii
from quillon.functions.geometry import Box
from quillon.operators import canaries, pixels
from quillon.sources import files
from quillon.streaming import gates


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(("v", "want"), [("234567890124", True), ("234567890123", False), ("2345 6789 0124", False), ("", False), ("a", False)])
def test_verhoeff(spark, v, want):
    assert one(spark, pii.verhoeff_valid(F.col("v")), v=v) is want


def test_exactly_one_check_digit(spark):
    d = spark.range(10).select(pii.verhoeff_valid(F.concat(F.lit("23456789012"), F.col("id").cast("string"))).alias("ok"), "id").where("ok").collect()
    assert [r["id"] for r in d] == [4]


@pytest.mark.parametrize(("v", "want"), [("2345 6789 0124", "234567890124"), ("2345-6789-0124", "234567890124"), ("23456789012", None), ("134567890124", None)])
def test_aadhaar(spark, v, want):
    assert one(spark, pii.normalise_aadhaar(F.col("v")), v=v) == want


@pytest.mark.parametrize(
    ("v", "want"),
    [("+91 90000 00001", "9000000001"), ("0-9000-000-001", "9000000001"), ("5000000001", None), ("900000000", None), ("90000000012", None), ("", None), ("234567890124", None), ("9100000042", "9100000042"), ("91-0000-0042", "9100000042")],
)
def test_mobile(spark, v, want):
    assert one(spark, pii.normalise_mobile(F.col("v")), v=v) == want


@pytest.mark.parametrize(("v", "want"), [("2000-02-29", True), ("2023-02-30", False), ("1899-12-31", False), ("2999-01-01", False), (" 1990-01-05 ", True), ("1990-1-5", False)])
def test_birth_date(spark, v, want):
    assert one(spark, pii.is_birth_date(F.col("v"), "2024-06-30"), v=v) is want


def test_tokens(spark):
    for ref, want in (("<PII:PHONE:1>", ("PHONE", 1)), ("<PII:OTP:1>", None), ("<PII:PHONE:0>", None), ("<PII:PHONE:01>", None), ("x", None)):
        r = one(spark, pii.parse_token(F.col("v")), v=ref)
        assert (tuple(r) if r else None) == want


def test_secret_containment(spark):
    assert one(spark, pii.contains_secret(F.col("a"), F.col("b")), a="call 9OOOO ooool", b="900000 0001") is True
    assert one(spark, pii.contains_secret(F.col("a"), F.col("b")), a="abc", b="abc") is False


def test_iou(spark):
    def iou(a, b):
        return one(spark, Box(*map(F.lit, a)).iou(Box(*map(F.lit, b))))

    assert iou((0, 0, 10, 10), (0, 0, 10, 10)) == 1
    assert iou((0, 0, 10, 10), (10, 0, 10, 10)) == 0
    assert iou((0, 0, 100, 10), (20, 0, 100, 10)) == pytest.approx(80 / 120)


def test_masks():
    assert len(pixels.merged([(0, 0, 10, 10), (0, 0, 10, 3)])) == 2
    assert pixels.merged([(0, 0, 10, 10), (2, 0, 10, 10), (7, 0, 6, 10)]).tolist() == [[0, 0, 13, 10]]
    assert pixels.redaction_mask([(0, 0, 10, 10), (8, 0, 10, 10)], (-99, -99, 300, 300)).tolist() == [[-4, -4, 26, 18]]
    assert pixels.coverage((0, 0, 10, 10), [(0, 0, 5, 10), (4, 0, 4, 10)]) == 80
    assert pixels.coverage((0, 0, 100, 100), [(0, 0, 100, 100)], [(0, 0, 50, 100)]) == 5000
    assert pixels.bounds_of(np.array([(10, 5), (40, 10), (38, 22), (8, 17)])) == (8, 5, 32, 17)


def test_frames(spark):
    rng = np.random.default_rng(0)
    a = np.dstack([rng.integers(0, 255, (20, 30, 3), dtype=np.uint8), np.full((20, 30), 255, np.uint8)])
    png = pixels.encode_png(a)
    assert (pixels.decode_png(png) == a).all()
    filled = pixels.sanitized(a, [(2, 2, 10, 10)], None)
    assert (filled[2:12, 2:12, :3] == 0).all()
    assert pixels.difference(a, filled, [(2, 2, 10, 10)])["pixels"] == 0
    assert (pixels.sanitized(a, [(25, 0, 10, 10)], [])[..., :3] == 0).all()
    assert pixels.letterboxed(a, 64).shape == (3, 64, 64)
    assert (pixels.resampled(a[..., :3], 20, 30) == a[..., :3]).all()
    frames = spark.createDataFrame([(1, bytearray(png))], "id long, content binary")
    out = pixels.per_frame(frames, lambda b: [{"w": pixels.decode_png(b).shape[1]}], "id long, w long").collect()
    assert [tuple(r) for r in out] == [(1, 30)]
    assert pixels.decode_data_url("data:image/png;base64,AAAA") is None
    assert not pixels.inspect_webp(b"RIFF")["ok"]
    body = b"VP8L" + (5).to_bytes(4, "little") + b"\x2f" + ((9 - 1) | ((7 - 1) << 14)).to_bytes(4, "little") + b"\0"
    webp = b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body
    assert pixels.inspect_webp(webp) == {"ok": True, "width": 9, "height": 7, "codec": "VP8L"}


def test_text_boxes():
    prob = np.zeros((20, 20))
    prob[3:9, 4:12] = 0.9
    prob[15, 15] = 0.9
    (box,) = pixels.text_boxes(prob, 1, 1, 20, 20)
    d = 8 * 6 * 1.5 / (2 * 14)
    assert box[:2] == (4 - d, 3 - d)
    assert box[4] == pytest.approx(0.9)


def test_canaries(spark):
    assert "phone 9000000001" in canaries.views("cGhvbmUgOTAwMDAwMDAwMQ==%20x")
    rows = spark.createDataFrame([(1, "x +91 90000-00001 y"), (2, "05/01/1990"), (3, "asha.VERMA"), (4, "190000000012"), (5, None)], "id long, text string")
    got = canaries.scan(rows, [("PHONE", "9000000001"), ("DOB", "1990-01-05"), ("NAME", "Asha Verma")]).collect()
    assert {r["id"]: r["classes"] for r in got} == {1: ["PHONE"], 2: ["DOB"], 3: ["NAME"], 4: [], 5: []}


def test_multipart(spark):
    m = F.lit('{"a":1}')
    s = files.multipart(m)
    assert one(spark, files.parsed_multipart(s["body"], s["boundary"])) == '{"a":1}'
    assert one(spark, files.parsed_multipart(F.concat(s["body"], F.lit("x")), s["boundary"])) is None


def test_manifest_and_write_once(spark, tmp_path):
    import json

    p = tmp_path / "m.json"
    p.write_text(json.dumps({"name": "d", "version": "1", "split": "dev", "samples": [{"id": "s1", "split": "dev", "annotations": []}]}))
    assert [r["id"] for r in files.read_manifest(spark, str(p), "dev").collect()] == ["s1"]
    with pytest.raises(Exception, match="foreign sample"):
        files.read_manifest(spark, str(p), "test").collect()
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id long, v string")
    assert files.sealed(df).first() == files.sealed(df.orderBy("id")).first()
    files.write_once(df, str(tmp_path / "r"))
    with pytest.raises(Exception, match=r"(?i)exists"):
        files.write_once(df, str(tmp_path / "r"))


def test_streaming_twins(spark, tmp_path):
    """The stateful forms give what a batch would, over two micro-batches."""
    src, schema = tmp_path / "in", "doc long, id long, ms long, kind string, mutations long, h_old long, h_new long"
    first, second = [(1, 1, 0, "DYNAMIC", 0, 0, 0), (1, 2, 300, "DYNAMIC", 0, 0, 0)], [(1, 3, 700, "STRUCTURAL", 0, 0, 0), (1, 4, 2100, "VISUAL", 0, 1, 2)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = gates.change_gate(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert i < 2
    got = {r["id"]: (r["accepted"], r["hashed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False), 4: (True, True)}


def test_frame_inventory(spark):
    from quillon.sources import files

    samples = spark.createDataFrame([("a.png",), ("b.png",)], "frame string")
    frames = spark.createDataFrame([("b.png", bytearray(b"1")), ("c.png", bytearray(b"2"))], "name string, content binary")
    assert {(r["frame"], r["kind"]) for r in files.frame_inventory(samples, frames).collect()} == {("a.png", "MISSING"), ("b.png", "PRESENT"), ("c.png", "UNEXPECTED")}
