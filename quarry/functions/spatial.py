"""Shapes over point columns, as boolean Columns.

A point is a struct of doubles x and y. Shapes are closed: their borders belong to them. Squares are products, so that
every engine rounds them alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import EngineError


def point(x: Column | str, y: Column | str) -> Column:
    """A point from two numeric columns."""
    as_double = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.struct(as_double(x).alias("x"), as_double(y).alias("y"))


def squared_distance(p: Column, x: float, y: float) -> Column:
    dx, dy = p["x"] - F.lit(x), p["y"] - F.lit(y)
    return dx * dx + dy * dy


def in_rectangle(p: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    if x0 > x1 or y0 > y1:
        raise EngineError("a rectangle's least corner must not lie beyond its greatest")
    return p["x"].between(x0, x1) & p["y"].between(y0, y1)


def in_circle(p: Column, x: float, y: float, radius: float) -> Column:
    """The exact test, with the box around the circle as conjuncts that reach the scan."""
    if radius < 0:
        raise EngineError("a circle's radius must not be negative")
    return _box(p, x, y, radius) & (squared_distance(p, x, y) <= F.lit(radius * radius))


def _box(p: Column, x: float, y: float, radius: float) -> Column:
    """The box around a circle; it never cuts off what rounding lets into the circle."""
    reach = [math.nextafter(r + 1e-9 * (abs(c) + radius) + 1e-160, math.inf) for c, r in ((x, radius), (y, radius))]
    return p["x"].between(x - reach[0], x + reach[0]) & p["y"].between(y - reach[1], y + reach[1])


def nearest(p: Column, x: float, y: float, k: int, whole: DataFrame) -> Column:
    """Whether a row is among the k nearest of the whole table, all ties at the k-th distance included.

    The k-th distance is found at once, over the unfiltered table's points alone (top-k for each task, then k rows from
    each). With it known, the predicate is a circle's, whose box reaches the scan: row groups of a table that is
    clustered by the point are skipped. It is an ordinary boolean that AND, OR and NOT combine as row sets.
    """
    if k <= 0:
        raise EngineError("k must be positive")
    distance = squared_distance(p, x, y)
    top = whole.select(distance.alias("d")).where("d IS NOT NULL").orderBy("d").limit(k)
    farthest = top.agg(F.max("d")).first()[0]
    if farthest is None or not math.isfinite(farthest):
        return distance <= F.lit(farthest).cast("double")
    return _box(p, x, y, math.sqrt(farthest)) & (distance <= F.lit(farthest))


def z_order(p: Column, low: tuple[float, float], high: tuple[float, float], bits: int = 16) -> Column:
    """A point's Z-order key within a box: the interleaved bits of both scaled coordinates."""

    def spread(c: Column, a: float, b: float) -> Column:
        scaled = (c - F.lit(a)) / F.lit((b - a) or 1.0) * F.lit(float((1 << bits) - 1))
        v = F.coalesce(scaled, F.lit(0.0)).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(p["x"], low[0], high[0]).bitwiseOR(F.shiftleft(spread(p["y"], low[1], high[1]), 1))
