"""Column functions on boxes. A box is a struct of x1, y1, x2, y2 in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    """Area two boxes share."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union is empty."""
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def cover(a: Column, b: Column) -> Column:
    """Share of ``a`` that ``b`` covers; the area of ``a`` counts as one at least."""
    return intersection(a, b) / F.greatest(area(a), F.lit(1.0))


def centred(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Corner, width and height in pixels as normalised centre and size: cx, cy, w, h."""
    return F.struct(((x + w / 2) / width).alias("cx"), ((y + h / 2) / height).alias("cy"), (w / width).alias("w"), (h / height).alias("h"))


def corners(c: Column, width: Column, height: Column) -> Column:
    """Normalised centre and size as a box in pixels."""
    return box((c["cx"] - c["w"] / 2) * width, (c["cy"] - c["h"] / 2) * height, (c["cx"] + c["w"] / 2) * width, (c["cy"] + c["h"] / 2) * height)


def bad_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, slack: float = 1e-6) -> Column:
    """Why a corner-and-size box is rejected, or null: the first reason that applies."""
    return (
        F.when(x.isNull() | y.isNull() | w.isNull() | h.isNull(), "INCOMPLETE")
        .when((w <= 0) | (h <= 0), "EMPTY")
        .when((x < -slack) | (y < -slack), "NEGATIVE")
        .when((x + w > width + slack) | (y + h > height + slack), "OUT_OF_BOUNDS")
    )


def letterboxed(size: Column, width: Column, height: Column, target: int) -> Column:
    """``size`` in pixels after the image is scaled to fit a square of ``target``."""
    return size * (F.lit(target) / F.greatest(width, height))


def crop(b: Column, width: Column, height: Column, factor: float = 2.5, least: float = 160.0) -> Column:
    """A square around a box, moved to lie within the image, in whole pixels (half to even)."""
    side = F.least(F.greatest(F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"]) * factor, F.lit(least)), width, height)
    left = F.least(F.greatest((b["x1"] + b["x2"]) / 2 - side / 2, F.lit(0.0)), width - side)
    top = F.least(F.greatest((b["y1"] + b["y2"]) / 2 - side / 2, F.lit(0.0)), height - side)
    return box(F.bround(left), F.bround(top), F.bround(left + side), F.bround(top + side))


def quartile(value: Column, edges: Column) -> Column:
    """Q1 to Q4 by three edges; a value on an edge belongs below it."""
    return F.when(value <= edges[0], "Q1").when(value <= edges[1], "Q2").when(value <= edges[2], "Q3").otherwise("Q4")
