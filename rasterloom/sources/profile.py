"""The profile of a class mask (K2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_profile(meta: Column) -> Column:
    """``meta`` as a one-band uint8 profile: GTiff for VRT, BigTIFF, LZW; a new struct, the old one stays."""
    driver = F.when(meta["driver"] == "VRT", F.lit("GTiff")).otherwise(meta["driver"])
    return F.struct(driver.alias("driver"), F.lit(1).alias("count"), F.lit("uint8").alias("dtype"), meta["width"].alias("width"), meta["height"].alias("height"), F.lit("YES").alias("bigtiff"), F.lit("lzw").alias("compress"))
