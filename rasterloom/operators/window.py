"""The weights of a patch's pixels: a separable Hann window, flat towards the image's borders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hann(k: Column, size: int) -> Column:
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2.0) * F.lit(float(np.pi)) * k / F.lit(float(size)))


def _profile(kind: str, k: Column, s: int) -> Column:
    if kind == "lo":
        return F.when(k < s, F.lit(1.0)).otherwise(hann(k, 2 * s))
    if kind == "hi":
        return F.when(k < s, hann(k, 2 * s)).otherwise(F.lit(1.0))
    return hann(k, 2 * s)


def weight(i: Column, j: Column, n1: Column, n2: Column, py: Column, px: Column, s: int, edge_mode: str = "reference") -> Column:
    """Weight of pixel (py, px) in patch (i, j).

    In ``reference`` mode a patch of the last column counts as right border whatever its row, and of
    the last row as bottom border unless it is also first in the last column; one-patch sides
    therefore leave a line of zero weight.  ``fixed`` makes a side flat towards every border it has.
    """
    lo, mid, hi = (lambda k, kind=kind: _profile(kind, k, s) for kind in ("lo", "mid", "hi"))
    if edge_mode == "fixed":
        one = F.lit(1.0)
        fx = F.when((j == 0) & (j >= n2 - 2), one).when(j == 0, lo(px)).when(j >= n2 - 2, hi(px)).otherwise(mid(px))
        fy = F.when((i == 0) & (i >= n1 - 2), one).when(i == 0, lo(py)).when(i >= n1 - 2, hi(py)).otherwise(mid(py))
        return fy * fx
    if edge_mode != "reference":
        raise ValueError(f"no edge mode {edge_mode!r}")
    last = j >= n2 - 2
    fx = F.when(last, hi(px)).when(j == 0, lo(px)).otherwise(mid(px))
    top_first = F.when(i == 0, lo(py)).when(i >= n1 - 2, hi(py)).otherwise(mid(py))
    bottom_first = F.when(i >= n1 - 2, hi(py)).when(i == 0, lo(py)).otherwise(mid(py))
    return F.when(last, top_first).otherwise(bottom_first) * fx


def weights(i: int, j: int, n1: int, n2: int, s: int, edge_mode: str = "reference") -> np.ndarray:
    """The same as an array of one patch."""
    k = np.arange(2 * s)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * k / (2 * s))
    side = {"lo": np.where(k < s, 1.0, w), "mid": w, "hi": np.where(k < s, w, 1.0), "one": np.ones(2 * s)}
    right, bottom = j >= n2 - 2, i >= n1 - 2
    if edge_mode == "fixed":
        pick = lambda first, last: "one" if first and last else "lo" if first else "hi" if last else "mid"
        fx, fy = pick(j == 0, right), pick(i == 0, bottom)
    else:
        fx = "hi" if right else "lo" if j == 0 else "mid"
        order = [("lo", i == 0), ("hi", bottom)] if right else [("hi", bottom), ("lo", i == 0)]
        fy = next((kind for kind, holds in order if holds), "mid")
    return np.outer(side[fy], side[fx])
