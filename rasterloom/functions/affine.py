"""Affine transforms as column expressions: x = a*col + b*row + c, y = d*col + e*row + f."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("a", "b", "c", "d", "e", "f")


def coefficients(transform: Sequence[float] | None) -> tuple[float, ...]:
    """The six coefficients of a six- or nine-number transform."""
    if transform is None:
        raise ValueError("no affine transform was given")
    if len(transform) not in (6, 9):
        raise ValueError(f"an affine transform has 6 or 9 numbers, not {len(transform)}")
    return tuple(float(v) for v in transform[:6])


def affine(transform: Sequence[float] | Column) -> Column:
    """A struct<a,b,c,d,e,f> column."""
    if isinstance(transform, Column):
        return transform
    return F.struct(*(F.lit(v).alias(n) for n, v in zip(NAMES, coefficients(transform), strict=True)))


def forward(x: Column, y: Column, t: Column) -> tuple[Column, Column]:
    return t["a"] * x + t["b"] * y + t["c"], t["d"] * x + t["e"] * y + t["f"]


def inverse(x: Column, y: Column, t: Column) -> tuple[Column, Column]:
    """The point that ``forward`` takes to (x, y)."""
    det = t["a"] * t["e"] - t["b"] * t["d"]
    u, v = x - t["c"], y - t["f"]
    return (t["e"] * u - t["b"] * v) / det, (t["a"] * v - t["d"] * u) / det


def move_rings(rings: Column, t: Column, back: bool = False, precision: int | None = None) -> Column:
    """Every vertex of array<array<struct<x,y>>> moved; rounded half to even when ``precision`` is given."""
    move = inverse if back else forward

    def point(p: Column) -> Column:
        x, y = move(p["x"], p["y"], t)
        if precision is not None:
            x, y = F.bround(x, precision), F.bround(y, precision)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda ring: F.transform(ring, point))
