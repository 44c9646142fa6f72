"""Cropping to a bounding box."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.affine import coefficients


@dataclass(frozen=True)
class Window:
    """Pixels ``col .. col + width``, ``row .. row + height`` and the transform of the cropped raster."""

    col: int
    row: int
    width: int
    height: int
    transform: tuple[float, ...]


def parse_bbox(bbox: Sequence[float] | str | None) -> tuple[float, ...] | None:
    """minx, miny, maxx, maxy from a list or from text such as ``"1,2,3,4"``."""
    if bbox is None or bbox == "None":
        return None
    values = bbox.strip("[]() ").replace(",", " ").split() if isinstance(bbox, str) else bbox
    if len(values) != 4:
        raise ValueError("a bounding box has four numbers")
    return tuple(float(v) for v in values)


def window_of(bbox: Sequence[float], transform: Sequence[float], width: int, height: int) -> Window:
    """The window of a box: every figure cut towards zero, the origin exactly the box's corner, not snapped.

    A box that reaches outside the raster is refused.
    """
    minx, miny, maxx, maxy = bbox
    a, b, c, d, e, f = coefficients(transform)
    det = a * e - b * d
    col = lambda x, y: (e * (x - c) - b * (y - f)) / det
    row = lambda x, y: (a * (y - f) - d * (x - c)) / det
    cols = [col(x, y) for x in (minx, maxx) for y in (miny, maxy)]
    rows = [row(x, y) for x in (minx, maxx) for y in (miny, maxy)]
    left, top = min(cols), min(rows)
    out = Window(int(left), int(top), int(max(cols) - left), int(max(rows) - top), (a, b, minx, d, e, maxy))
    if left < 0 or top < 0 or out.col + out.width > width or out.row + out.height > height:
        raise ValueError(f"the box {tuple(bbox)} reaches outside the raster")
    return out


def crop(pixels: DataFrame, w: Window) -> DataFrame:
    """The window's pixels, counted from its corner; plain comparisons, so a Parquet scan can skip row groups."""
    inside = (F.col("y") >= w.row) & (F.col("y") < w.row + w.height) & (F.col("x") >= w.col) & (F.col("x") < w.col + w.width)
    return pixels.where(inside).withColumns({"y": F.col("y") - w.row, "x": F.col("x") - w.col})
