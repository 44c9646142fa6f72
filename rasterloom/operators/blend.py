"""Overlap-add, normalization and per-pixel classification (A1-A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_blend(preds: DataFrame, classes: int, keys: tuple[str, ...] = ("raster_id", "y", "x")) -> DataFrame:
    """Weighted sums of (probs, w) rows per pixel, combined before the shuffle: s0..s(k-1), sw."""
    sums = [F.sum(F.col("probs")[k] * F.col("w")).alias(f"s{k}") for k in range(classes)]
    return preds.groupBy(*keys).agg(*sums, F.sum("w").alias("sw"))


def normalize(blended: DataFrame, classes: int) -> DataFrame:
    """probs = sums / sw, or 0 where no weight arrived."""
    each = [F.when(F.col("sw") != 0, F.col(f"s{k}") / F.col("sw")).otherwise(F.lit(0.0)) for k in range(classes)]
    return blended.withColumn("probs", F.array(*each)).drop(*(f"s{k}" for k in range(classes)))


def argmax(probs: Column) -> Column:
    """The first of the largest."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("short")


def over_threshold(p: Column, threshold: float) -> Column:
    return (p > F.lit(threshold)).cast("short")


def classify(probs: Column, classes: int, threshold: float = 0.3) -> Column:
    return over_threshold(probs[0], threshold) if classes == 1 else argmax(probs)
