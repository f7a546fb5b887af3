"""Queries over frames and masks. Frames are made of embeddings (8 x 8 values); checked by pytest, so they give rows only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import canaries, pixels, redaction
from quillon.operators.rasters import whole_groups
from quillon.plans.boxes import BOXES
from quillon.registry import both, query, run_sql, table


def grey(v: np.ndarray, scale: int = 6) -> np.ndarray:
    """An opaque frame whose blocks have the brightness of a vector's values."""
    side = int(np.sqrt(len(v)))
    g = np.clip((v[: side * side].reshape(side, side) + 0.5) * 255, 0, 255).astype(np.uint8).repeat(scale, 0).repeat(scale, 1)
    return np.dstack([g, g, g, np.full_like(g, 255)])


@query("text_regions", "M-09 K-03")
def text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes of each vector read as a probability map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, v in zip(b.vec_id, b.embedding, strict=True):
                p = np.clip(np.asarray(v, float).reshape(8, 8).repeat(3, 0).repeat(3, 1) * 4 + 0.5, 0, 1)
                out += [(key, k, *map(float, box)) for k, box in enumerate(pixels.text_boxes(p, 1, 1, 24, 24))]
            yield pd.DataFrame(out, columns=["vec_id", "ord", "x", "y", "w", "h", "score"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, ord long, x double, y double, w double, h double, score double")


@query("frame_pipeline", "S-04 M-14 M-15 M-16 M-18 M-25 A-25 P-19")
def frame_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode, mask, verify, measure and turn every frame into model input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, v in zip(b.vec_id, b.embedding, strict=True):
                frame = grey(np.asarray(v, float))
                png = pixels.encode_png(frame)
                masked = pixels.sanitized(frame, [(6, 6, 20, 20)], [(10.0, 10.0, 6.0, 6.0)])
                bright = lambda f: [(12.0, 12.0, 4.0, 4.0)] if f[14, 14, 0] > 0 else []
                m, d = pixels.element_metrics(frame, (12, 12, 20, 20)), pixels.difference(frame, masked, [(6, 6, 20, 20)])
                out.append((key, bool((pixels.decode_png(png) == frame).all()), d["pixels"], redaction.reverified(masked, bright, [(6.0, 6.0, 20.0, 20.0)])[0], m["salience"], pixels.visibility(m["salience"], m["coverage"][1.5]), float(pixels.letterboxed(frame, 64).mean()), pixels.text_tensor(frame, 96, 32).shape[1]))
            yield pd.DataFrame(out, columns=["vec_id", "round_trip", "changed_outside", "verdict", "salience", "visibility", "mean_input", "text_rows"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, round_trip boolean, changed_outside long, verdict string, salience double, visibility string, mean_input double, text_rows long")


@query("redaction_masks", "M-10 K-05")
def redaction_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run_sql(spark, sf_dir, f"with {BOXES} select sample, x, y, w, h from pred where cls = 2")
    return whole_groups(d, "sample", [], redaction.masks_of, "sample long, ord long, x double, y double, w double, h double")


@query("redaction_scores", "A-22")
def redaction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run_sql(spark, sf_dir, f"with {BOXES} select sample, 0 side, cls, x, y, w, h from pred union all select sample, 1, cls, x, y, w, h from gt")
    return whole_groups(d, "sample", [], redaction.image_scores, "sample long, exposed long, over_mask double, largest_share double, glyphs long, passed boolean")


@query("page_layouts", "D-09 K-08")
def page_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run_sql(spark, sf_dir, f"with {BOXES} select sample, uid, w, h from gt")
    return whole_groups(d, "sample", ["uid"], redaction.page_layouts, "uid long, sample long, region int, x double, y double")


both("placement_order", "K-05 K-08", f"""with {BOXES} select sample, uid, cast(row_number() over (partition by sample order by y, x, w, h, uid) as bigint) by_position, cast(row_number() over (partition by sample order by w * h desc, uid) as bigint) by_area from gt""")


@query("canary_scan", "E-01 E-02 E-03")
def canary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted values in documents, plain or encoded; every seventh document gets one in an encoded form first."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" "), F.base64(F.lit("call +91 90000-00001").cast("binary")))).otherwise(F.col("text")).alias("text"))
    return canaries.scan(d, [("PHONE", "9000000001"), ("DOB", "1990-01-05"), ("NAME", "Asha Verma")])


@query("contact_sheet", "S-16")
def contact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One PNG per label of its first 48 vectors' frames: a report of bounded size, made per label."""

    def sheet(g: pd.DataFrame) -> pd.DataFrame:
        png = redaction.contact_sheet([grey(np.asarray(v, float)) for v in g.sort_values("vec_id").embedding.head(48)])
        return pd.DataFrame([{"label": int(g.label.iloc[0]), "png_bytes": len(png), "width": pixels.decode_png(png).shape[1]}])

    top = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", "label", "row_number() over (partition by label order by vec_id) rn").where("rn <= 48").drop("rn")
    return top.groupBy("label").applyInPandas(sheet, "label int, png_bytes long, width long")
