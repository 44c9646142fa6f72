"""Image manifests: headerless CSV of tif, gpkg, split, aoi_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("tif", "gpkg", "split", "aoi_id")


def parse_manifest(lines: DataFrame, folder: str) -> DataFrame:
    """The manifest's columns of (line_no, line): empty fields null, missing ones added, relative paths below ``folder``."""
    parts = F.split("line", ",", -1)

    def field(k: int):
        v = F.trim(F.get(parts, F.lit(k)))
        v = F.when(F.length(v) > 0, v)
        if k < 2:
            v = F.when(v.rlike("^/|^[A-Za-z][A-Za-z0-9+.-]*://"), v).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), v))
        return v

    return lines.select("line_no", *(field(k).alias(n) for k, n in enumerate(COLUMNS)))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest sorted by split, lines of a split in their order.

    TypeError for semicolons, ValueError for lines of different lengths; both are found by one narrow aggregate.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")).where(F.length(F.trim("line")) > 0)
    parts = F.split("line", ",", -1)
    shape = lines.agg(F.max(F.contains(parts[0], F.lit(";"))).alias("semicolons"), F.min(F.size(parts)).alias("least"), F.max(F.size(parts)).alias("most")).first()
    if shape["semicolons"]:
        raise TypeError(f"{path} is separated by semicolons, not commas")
    if shape["least"] != shape["most"]:
        raise ValueError(f"lines of {path} have {shape['least']} to {shape['most']} fields")
    folder = path.rpartition("/")[0] or "."
    return parse_manifest(lines, folder).orderBy("split", "line_no").drop("line_no")
