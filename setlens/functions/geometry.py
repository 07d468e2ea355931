"""Box arithmetic as column expressions. Boxes are x1, y1, x2, y2 unless width and height are named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from setlens.functions.vectors import slope


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; the union is 1e-12 at least."""
    shared = overlap(a, b)
    return shared / F.greatest(area(a) + area(b) - shared, F.lit(1e-12))


def letterbox(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, side: int) -> Column:
    """A pixel box in the coordinates of a square of the given side that holds the whole image, clamped to [0, 1]."""
    scale = F.least(side / width, side / height)
    rw, rh = (F.least(F.lit(float(side)), F.bround(v * scale, 0)) for v in (width, height))
    left, top = (F.bround((side - v) / 2.0, 0) for v in (rw, rh))
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.struct(
        clamp((x * rw / width + left) / side).alias("x1"), clamp((y * rh / height + top) / side).alias("y1"),
        clamp(((x + w) * rw / width + left) / side).alias("x2"), clamp(((y + h) * rh / height + top) / side).alias("y2"),
    )


def head_cost(hx: Column, hy: Column, p: Column) -> Column:
    """Squared offset of a head centre from the person's top centre in units of its size; null outside the box."""
    w, h = (F.greatest(v, F.lit(1e-6)) for v in (p["x2"] - p["x1"], p["y2"] - p["y1"]))
    inside = hx.between(p["x1"], p["x2"]) & hy.between(p["y1"], p["y2"])
    return F.when(inside, slope(hx - (p["x1"] + p["x2"]) / 2, w) + slope(hy - p["y1"], h))


def keep_boxes(boxes: Column, threshold: float) -> Column:
    """Slots kept by greedy suppression. boxes: array of struct(priority, slot, x1, y1, x2, y2).

    Highest priority first, smaller slot on ties; a box is dropped if its overlap with a kept one is above the threshold.
    """
    ordered = F.array_sort(boxes, lambda a, b: F.when(a["priority"] != b["priority"], F.signum(b["priority"] - a["priority"]).cast("int")).otherwise((a["slot"] - b["slot"]).cast("int")))
    valid = F.filter(ordered, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    none = F.filter(valid, lambda b: F.lit(False))
    kept = F.aggregate(valid, none, lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) > threshold), acc).otherwise(F.array_append(acc, b)))
    return F.array_sort(F.transform(kept, lambda b: b["slot"]))


def greedy_pairs(pairs: Column) -> Column:
    """One-to-one pairs by ascending cost. pairs: array of struct(cost, head, person); ties by head, then person."""
    none = F.filter(pairs, lambda p: F.lit(False))
    free = lambda acc, p: ~F.exists(acc, lambda k: (k["head"] == p["head"]) | (k["person"] == p["person"]))
    return F.aggregate(F.array_sort(pairs), none, lambda acc, p: F.when(free(acc, p), F.array_append(acc, p)).otherwise(acc))
