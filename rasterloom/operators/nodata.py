"""Nodata values, valid masks and masked output."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKED = 255


def resolve(declared: Column, is_float: Column) -> Column:
    """The declared value, else NaN for floats, else 0."""
    return F.coalesce(declared, F.when(is_float, F.lit(float("nan"))).otherwise(F.lit(0.0)))


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def _valid(v: Column, declared: float | None, is_float: bool, nan_masks: bool) -> Column:
    if declared is None:
        return finite(v) if is_float else v != F.lit(0.0)
    if math.isnan(declared):
        # by numpy's rule nothing equals NaN, so nothing is masked
        return ~F.isnan(v) if nan_masks else v.isNotNull()
    return F.isnan(v) | (v != F.lit(float(declared)))


def valid(bands: Column, declared: float | None = None, is_float: bool = False, nan_masks: bool = False) -> Column:
    """Whether every band of a wide pixel is valid."""
    return F.forall(bands, lambda v: _valid(v, declared, is_float, nan_masks))


def valid_mask(pixels: DataFrame, declared: float | None = None, is_float: bool = False, nan_masks: bool = False) -> DataFrame:
    """The same for long pixels, combined before any shuffle."""
    return pixels.groupBy("raster_id", "y", "x").agg(F.bool_and(_valid(F.col("v"), declared, is_float, nan_masks)).alias("valid"))


def mask_nodata(cls: Column, is_valid: Column) -> Column:
    return F.when(is_valid, cls).otherwise(F.lit(MASKED)).cast("short")
