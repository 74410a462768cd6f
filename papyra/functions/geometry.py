"""Rectangles (x, y, w, h) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_1d(a: Column, a_end: Column, b: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a, b))


def columns(p: str) -> tuple[Column, Column, Column, Column]:
    """x, y, w, h with a prefix such as 'l.'."""
    return tuple(F.col(f"{p}{c}") for c in "xywh")


def overlap_area(p: str, q: str) -> Column:
    ax, ay, aw, ah = columns(p)
    bx, by, bw, bh = columns(q)
    return overlap_1d(ax, ax + aw, bx, bx + bw) * overlap_1d(ay, ay + ah, by, by + bh)


def iou_or_part(p: str, q: str) -> Column:
    """The larger of intersection over union and 0.85 of intersection over the smaller area."""
    both, a, b = overlap_area(p, q), F.col(f"{p}w") * F.col(f"{p}h"), F.col(f"{q}w") * F.col(f"{q}h")
    return F.greatest(both / F.greatest(F.lit(1), a + b - both), 0.85 * both / F.greatest(F.lit(1), F.least(a, b)))


def centre_in(p: str, q: str, margin: int = 0) -> Column:
    """The centre of p lies in q, bounds included."""
    ax, ay, aw, ah = columns(p)
    bx, by, bw, bh = columns(q)
    cx, cy = ax + aw / 2, ay + ah / 2
    return cx.between(bx - margin, bx + bw + margin) & cy.between(by - margin, by + bh + margin)


def contained(p: str, q: str, margin: int = 5) -> Column:
    ax, ay, aw, ah = columns(p)
    bx, by, bw, bh = columns(q)
    return (ax >= bx - margin) & (ay >= by - margin) & (ax + aw <= bx + bw + margin) & (ay + ah <= by + bh + margin)


def orientation(w: Column, h: Column, ratio: float = 1.5) -> Column:
    return F.when(h > ratio * w, "vertical").when(w > ratio * h, "horizontal").otherwise("square")


def scaled(v: Column, size: Column, top: int = 999) -> Column:
    """A pixel position on a scale of 0 to top, by integer division."""
    return F.least(F.lit(top), F.greatest(F.lit(0), F.expr("1") * F.floor(v * (top + 1) / size))).cast("int")
