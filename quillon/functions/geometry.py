"""Boxes as column expressions: x, y, w, h of doubles or integers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.binding import bound


@dataclass(frozen=True)
class Box:
    """Four columns of one rectangle."""

    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(prefix + c) for c in "xywh"))

    @classmethod
    def within(cls, s: Column) -> Box:
        return cls(*(s[c] for c in "xywh"))

    @property
    def area(self) -> Column:
        return F.greatest(self.w, F.lit(0)) * F.greatest(self.h, F.lit(0))

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.w.alias("w"), self.h.alias("h"))

    def overlap(self, o: Box) -> Column:
        """Area in common, 0 if the boxes only touch."""
        dx = F.least(self.x + self.w, o.x + o.w) - F.greatest(self.x, o.x)
        dy = F.least(self.y + self.h, o.y + o.h) - F.greatest(self.y, o.y)
        return F.greatest(dx, F.lit(0)) * F.greatest(dy, F.lit(0))

    def iou(self, o: Box) -> Column:
        inter = self.overlap(o)
        union = self.w * self.h + o.w * o.h - inter
        return F.when((inter > 0) & (union > 0), inter.cast("double") / union).otherwise(F.lit(0.0))

    def clipped(self, to: Box) -> Box:
        x, y = F.greatest(self.x, to.x), F.greatest(self.y, to.y)
        return Box(x, y, F.least(self.x + self.w, to.x + to.w) - x, F.least(self.y + self.h, to.y + to.h) - y)

    def dilated(self, d: int = 4) -> Box:
        return Box(self.x - d, self.y - d, self.w + 2 * d, self.h + 2 * d)

    def scaled(self, f: Column | float) -> Box:
        return Box(self.x * f, self.y * f, self.w * f, self.h * f)

    def pixels(self, scale: Column, width: Column, height: Column) -> Box:
        """Outward-rounded pixel rectangle inside a frame."""
        x0, y0 = F.greatest(F.floor(self.x * scale), F.lit(0)), F.greatest(F.floor(self.y * scale), F.lit(0))
        x1, y1 = F.least(F.ceil((self.x + self.w) * scale), width), F.least(F.ceil((self.y + self.h) * scale), height)
        return Box(x0, y0, F.greatest(x1 - x0, F.lit(0)), F.greatest(y1 - y0, F.lit(0)))

    def containment(self, view: Box) -> Column:
        inside = (self.x >= view.x) & (self.y >= view.y) & (self.x + self.w <= view.x + view.w) & (self.y + self.h <= view.y + view.h)
        return F.when(self.overlap(view) <= 0, "OUTSIDE").when(inside, "INSIDE").otherwise("CLIPPED")


def letterbox(width: Column, height: Column, side: int) -> tuple[Column, Column, Column]:
    """(scale, pad x, pad y) that fits a frame into a square."""
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    return scale, (F.lit(side) - width * scale) / 2, (F.lit(side) - height * scale) / 2


def luminance(rgb: Column) -> Column:
    def channel(shift: int) -> Column:
        v = F.shiftright(rgb, shift).bitwiseAND(F.lit(255)) / 255.0
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return F.lit(0.2126) * channel(16) + F.lit(0.7152) * channel(8) + F.lit(0.0722) * channel(0)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


#: Share by which the scales of the two axes may differ: rounding of device pixels.
ASPECT_TOLERANCE = 0.01


def geometry_cause(dpr: Column, zoom: Column, w: Column, h: Column, capture_w: Column, capture_h: Column, scroll_x: Column, scroll_y: Column) -> Column:
    """OK, or why a capture and its viewport allow no transform."""
    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    sound = finite(scroll_x.cast("double")) & finite(scroll_y.cast("double"))
    for c in (dpr, zoom, w, h, capture_w, capture_h):
        sound &= finite(c) & (c > 0)
    sx, sy = w / capture_w, F.when(capture_h > 0, h / capture_h)
    return F.when(~sound, "COORDINATE_TRANSFORM_AMBIGUOUS").when(F.abs(sx - sy) / F.greatest(sx, sy) > ASPECT_TOLERANCE, "CAPTURE_DIMENSION_MISMATCH").otherwise("OK")


def grid_hits(region: Box, occluder: Box, n: int) -> Column:
    """Points of an n x n grid at the centres of the region's parts that an occluder (null: none) leaves free."""
    def hidden(start: Column, size: Column, lo: Column, extent: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: start + (k + 0.5) * size / n)
        return F.size(F.filter(at, lambda p: (p >= lo) & (p < lo + extent)))

    cols, rows = hidden(region.x, region.w, occluder.x, occluder.w), hidden(region.y, region.h, occluder.y, occluder.h)
    return F.lit(n * n) - F.when(occluder.x.isNull(), 0).otherwise(cols * rows)


def pieces(box: Box, hole: Box) -> Column:
    """array<struct<x, y, w, h>>: what is left of a box without a hole, up to four rectangles."""
    x0, y0 = F.greatest(hole.x, box.x), F.greatest(hole.y, box.y)
    x1, y1 = F.least(hole.x + hole.w, box.x + box.w), F.least(hole.y + hole.h, box.y + box.h)
    parts = [
        Box(box.x, box.y, box.w, y0 - box.y), Box(box.x, y1, box.w, box.y + box.h - y1),
        Box(box.x, y0, x0 - box.x, y1 - y0), Box(x1, y0, box.x + box.w - x1, y1 - y0),
    ]
    left = F.filter(F.array(*[p.struct() for p in parts]), lambda s: (s["w"] > 0) & (s["h"] > 0))
    return F.when((x0 >= x1) | (y0 >= y1), F.array(box.struct())).otherwise(left)


def union_area(boxes: Column) -> Column:
    """Area of the union of an array of boxes, by strips between neighbours of their vertical edges."""
    def strips(shape: Column) -> Column:
        boxes, edges = shape["boxes"], shape["edges"]

        def strip(a: Column, b: Column) -> Column:
            spans = F.array_sort(F.transform(F.filter(boxes, lambda s: (s["x"] <= a) & (s["x"] + s["w"] >= b)), lambda s: F.struct(s["y"].cast("long").alias("lo"), (s["y"] + s["h"]).cast("long").alias("hi"))))
            start = F.struct(F.lit(-(1 << 40)).cast("long").alias("reach"), F.lit(0).cast("long").alias("sum"))
            total = F.aggregate(spans, start, lambda acc, s: F.struct(F.greatest(acc["reach"], s["hi"]).alias("reach"), (acc["sum"] + F.greatest(s["hi"] - F.greatest(s["lo"], acc["reach"]), F.lit(0).cast("long"))).alias("sum")), lambda acc: acc["sum"])
            return F.coalesce((b - a) * total, F.lit(0)).cast("long")

        return F.zip_with(edges, F.slice(edges, F.lit(2), F.size(edges)), strip)

    edges = F.array_sort(F.array_distinct(F.concat(F.transform(boxes, lambda b: b["x"]), F.transform(boxes, lambda b: b["x"] + b["w"]))))
    shape = F.struct(boxes.alias("boxes"), edges.alias("edges"))
    return F.when(boxes.isNotNull(), F.aggregate(bound(shape, strips), F.lit(0).cast("long"), lambda acc, x: acc + x))


def focal(z: Column, t: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal loss of a logit against a target of 0 or 1."""
    p = 1 / (1 + F.exp(-z))
    p_t = p * t + (1 - p) * (1 - t)
    ce = F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
    return (alpha * t + (1 - alpha) * (1 - t)) * F.pow(1 - p_t, F.lit(gamma)) * ce
