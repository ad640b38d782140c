"""Boxes: struct<x0, y0, x1, y1>, origin top left, y downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def mid_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def v_overlap(a: Column, b: Column) -> Column:
    """Shared height as a fraction of the lower box; 0 if that has none."""
    shared = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    shorter = F.least(height(a), height(b))
    return F.when(shorter <= 0, 0.0).otherwise(F.try_divide(F.greatest(F.lit(0.0), shared), shorter))


def h_gap(a: Column, b: Column) -> Column:
    """Signed gap from a's right to b's left edge, in heights of the taller box; infinite if that has none."""
    h = F.greatest(height(a), height(b))
    return F.when(h <= 0, float("inf")).otherwise(F.try_divide(b["x0"] - a["x1"], h))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union has no area."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    both = area(a) + area(b) - w * h
    return F.when(both <= 0, 0.0).otherwise(F.try_divide(w * h, both))


def inside_page(b: Column, width: Column, height_: Column) -> Column:
    return (b["x0"] >= 0) & (b["y0"] >= 0) & (b["x1"] <= width) & (b["y1"] <= height_) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])
