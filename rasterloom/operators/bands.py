"""Band selection and stacking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def requested_bands(bands: Sequence[int] | str | None) -> list[int]:
    """A band list from a list or from text such as ``"1,2,3"``; empty stands for all bands."""
    if bands is None:
        return []
    if isinstance(bands, str):
        bands = [b for b in bands.strip("[] ").split(",") if b.strip()]
    if not isinstance(bands, Sequence):
        raise ValueError("bands must be a list")
    return [int(b) for b in bands]


def reorder(bands: Column, requested: Sequence[int]) -> Column:
    """The wide form's array with the requested bands (from 1) in that order, repeats included."""
    return F.array(*(F.element_at(bands, int(b)) for b in requested)) if requested else bands


def reorder_long(pixels: DataFrame, requested: Sequence[int]) -> DataFrame:
    """The same for long pixels (band, ...): a band's row appears once for each place it is asked for."""
    if not requested:
        return pixels
    places = {b: [k + 1 for k, r in enumerate(requested) if r == b] for b in set(requested)}
    at = F.create_map(*(x for b, p in sorted(places.items()) for x in (F.lit(b), F.array(*map(F.lit, p)))))
    return pixels.where(F.col("band").isin(*places)).withColumn("band", F.explode(at[F.col("band")]))


def stack(rasters: Sequence[DataFrame]) -> DataFrame:
    """Single-band pixel tables (raster_id, y, x, v) as one table with a band ordinal."""
    out = None
    for k, pixels in enumerate(rasters):
        one = pixels.withColumn("band", F.lit(k + 1))
        out = one if out is None else out.unionByName(one)
    return out


def widen(pixels: DataFrame, count: int, keys: Sequence[str] = ("raster_id", "y", "x")) -> DataFrame:
    """Long pixels to the wide form: bands ARRAY<DOUBLE> of ``count`` values, 0 where a pixel is missing."""
    each = [F.coalesce(F.max(F.when(F.col("band") == b, F.col("v"))), F.lit(0.0)) for b in range(1, count + 1)]
    return pixels.groupBy(*keys).agg(F.array(*each).alias("bands"))
