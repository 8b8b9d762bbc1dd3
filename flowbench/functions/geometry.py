"""Column expressions on boxes. A box is the columns x, y, w, h: top-left corner, width and height in pixels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


@dataclass(frozen=True)
class Box:
    """Four columns of one box."""

    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}").cast("double") for c in "xywh"))


def bbox_center(b: Box) -> tuple[Column, Column]:
    return b.x + b.w / 2, b.y + b.h / 2


def bbox_diag(b: Box) -> Column:
    return F.hypot(b.w, b.h)


def bbox_area(b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(b.w, zero) * F.greatest(b.h, zero)


def pair_delta(a: Box, b: Box) -> dict[str, Column]:
    """Steps from the centre of a to that of b, and their lengths."""
    (ax, ay), (bx, by) = bbox_center(a), bbox_center(b)
    dx, dy = bx - ax, by - ay
    return {"dx": dx, "dy": dy, "euclidean": F.hypot(dx, dy), "manhattan": F.abs(dx) + F.abs(dy)}


def overlap(lo_a: Column, size_a: Column, lo_b: Column, size_b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(lo_a + size_a, lo_b + size_b) - F.greatest(lo_a, lo_b))


def overlap_ratio(lo_a: Column, size_a: Column, lo_b: Column, size_b: Column) -> Column:
    """Shared length of two intervals over the shorter one."""
    return overlap(lo_a, size_a, lo_b, size_b) / F.greatest(F.least(size_a, size_b), F.lit(EPS))


def bbox_iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    shared = overlap(a.x, a.w, b.x, b.w) * overlap(a.y, a.h, b.y, b.h)
    union = a.w * a.h + b.w * b.h - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def safe_log_ratio(a: Column, b: Column) -> Column:
    return F.log((a + EPS) / (b + EPS))


def xyxy_to_xywh(x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    """Corners, rounded half to even, as corner and size; sizes are at least 0."""
    r0, s0, r1, s1 = (F.rint(c.cast("double")) for c in (x0, y0, x1, y1))
    zero = F.lit(0.0)
    made = {"x": r0, "y": s0, "w": F.greatest(zero, r1 - r0), "h": F.greatest(zero, s1 - s0)}
    return {k: v.cast("long") for k, v in made.items()}
