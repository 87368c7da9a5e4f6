"""Box geometry as column expressions. A box is a struct, or a mapping, of x1, y1, x2, y2 in DOUBLE pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> dict[str, Column]:
    """The columns <prefix>x1 … <prefix>y2 as a box."""
    return {s: F.col(prefix + s) for s in SIDES}


def zero_if(test: Column, value: Column) -> Column:
    return F.when(test, F.lit(0.0)).otherwise(value)


def area(b) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def intersection(a, b) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a, b) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return zero_if(union <= 0, intersection(a, b) / F.when(union > 0, union))


def iomin(a, b) -> Column:
    small = F.least(area(a), area(b))
    return zero_if(small <= 0, intersection(a, b) / F.when(small > 0, small))


def contained(inner, outer, share: float = 0.9) -> Column:
    """Whether ``share`` of the inner box lies within the outer one; a box without area never does."""
    own = area(inner)
    return zero_if(own <= 0, intersection(inner, outer) / F.when(own > 0, own)) >= share


def projection(a, b, horizontal: bool) -> Column:
    """Overlap over hull of the two boxes along one axis; 0 where they don't overlap."""
    lo, hi = ("x1", "x2") if horizontal else ("y1", "y2")
    over = F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo])
    hull = F.greatest(a[hi], b[hi]) - F.least(a[lo], b[lo])
    return zero_if((over <= 0) | (hull <= 0), over / F.when(hull > 0, hull))


def aligned(a: Column, b: Column, tolerance: float = 5.0) -> Column:
    return F.abs(a - b) <= tolerance


def alignment(a, b) -> Column:
    return F.when(aligned(a["x1"], b["x1"]), "left").when(aligned(a["x2"], b["x2"]), "right").otherwise("center")


def unclipped(b, ratio: float) -> dict[str, Column]:
    """The box scaled about its centre."""
    out = {}
    for lo, hi in (("x1", "x2"), ("y1", "y2")):
        size = F.greatest(b[hi] - b[lo], F.lit(0.0))
        middle, half = b[lo] + size / 2, size * ratio / 2
        out |= {lo: middle - half, hi: middle + half}
    return out


def clamped(b, width: Column, height: Column) -> dict[str, Column]:
    edge = {"x1": width, "x2": width, "y1": height, "y2": height}
    return {s: F.least(F.greatest(b[s], F.lit(0.0)), edge[s].cast("double")) for s in SIDES}


def crop_rect(b, width: Column, height: Column, padding: float = 0.0) -> dict[str, Column]:
    """Left, top, width and height of the pixels to cut out: whole, within the page, at least one each."""
    out = {}
    for lo, hi, edge, start, size in (("x1", "x2", width, "crop_x", "crop_w"), ("y1", "y2", height, "crop_y", "crop_h")):
        pad = F.greatest(b[hi] - b[lo], F.lit(1.0)) * padding
        first = F.floor(F.greatest(b[lo] - pad, F.lit(0.0)))
        last = F.ceil(F.least(b[hi] + pad, edge.cast("double")))
        out |= {start: first.cast("int"), size: F.greatest(last - first, F.lit(1)).cast("int")}
    return out
