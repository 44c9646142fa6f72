"""Which polygons meet which images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.affine import affine, move_rings
from rasterloom.functions.geometry import area, area_inside, bounds, let


def _buckets(low: Column, high: Column, size: Column) -> Column:
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def bbox_overlap(polygons: DataFrame, images: DataFrame, bucket: float | None = None) -> DataFrame:
    """Pairs of polygon rows and image rows whose boxes meet, touching included.

    Both sides have minx, miny, maxx, maxy; the images' come out as image_minx and so on.  Each side is
    exploded into the buckets of a grid and equi-joined there, each pair kept only in the first bucket that
    both share.  Polygons lie on the grid whose buckets are as wide as they are, a power of two times
    ``bucket`` (map units; the images' mean side without it), so that none of them meets more than
    four buckets; images are exploded once for each such width that polygons have.  Boxes with a null meet nothing.
    """
    names = ("minx", "miny", "maxx", "maxy")
    for n in names:
        images = images.withColumnRenamed(n, f"image_{n}")
    meet = (F.col("minx") <= F.col("image_maxx")) & (F.col("maxx") >= F.col("image_minx")) & (F.col("miny") <= F.col("image_maxy")) & (F.col("maxy") >= F.col("image_miny"))
    if bucket is None:
        side = images.agg(F.avg(F.greatest(F.col("image_maxx") - F.col("image_minx"), F.col("image_maxy") - F.col("image_miny")))).first()[0]
        bucket = float(side) if side else 1.0
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    level = F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(bucket)) / bucket)), F.lit(0)).cast("int")
    left = polygons.where(extent.isNotNull()).withColumn("_level", level)
    levels = sorted(r[0] for r in left.select("_level").distinct().collect())  # at most a thousand, as doubles go
    right = images.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    width = F.lit(bucket) * F.pow(F.lit(2.0), F.col("_level"))

    def placed(df: DataFrame, prefix: str) -> DataFrame:
        for axis in "xy":
            df = df.withColumn(f"_b{axis}", F.explode(_buckets(F.col(f"{prefix}min{axis}"), F.col(f"{prefix}max{axis}"), width)))
        return df

    first = lambda axis: F.floor(F.greatest(f"min{axis}", f"image_min{axis}") / width).cast("long")
    met = placed(left, "").join(placed(right, "image_"), ["_level", "_bx", "_by"])
    return met.where(meet & (F.col("_bx") == first("x")) & (F.col("_by") == first("y"))).drop("_level", "_bx", "_by")


def overlapping_subset(polygons: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Polygons whose own box meets ``box``; plain comparisons, no join."""
    if box is None:
        raise ValueError("either an image or a bounding box is needed")
    minx, miny, maxx, maxy = box
    b = bounds(F.col("rings"))
    return polygons.where((b["minx"] <= maxx) & (b["maxx"] >= minx) & (b["miny"] <= maxy) & (b["maxy"] >= miny))


def image_box(transform, width: int, height: int) -> tuple[float, float, float, float]:
    a, b, c, d, e, f = transform[:6]
    xs = [a * x + b * y + c for x in (0, width) for y in (0, height)]
    ys = [d * x + e * y + f for x in (0, width) for y in (0, height)]
    return min(xs), min(ys), max(xs), max(ys)


def to_pixels(polygons: DataFrame, transform, width: int, height: int, image: str, precision: int | None = None) -> DataFrame:
    """The image's polygons in its pixel coordinates, with ``image_fname``."""
    near = overlapping_subset(polygons, image_box(transform, width, height))
    return near.withColumn("rings", move_rings(F.col("rings"), affine(transform), back=True, precision=precision)).withColumn("image_fname", F.lit(image))


def overlap_ratio(rings: Column, width: Column, height: Column) -> Column:
    """The share of a polygon's area inside the image; null for an area of 0.

    Only polygons whose box crosses the image's border are clipped.
    """

    def share(whole: Column, b: Column) -> Column:
        inside = (b["minx"] >= 0) & (b["miny"] >= 0) & (b["maxx"] <= width) & (b["maxy"] <= height)
        outside = (b["maxx"] <= 0) | (b["maxy"] <= 0) | (b["minx"] >= width) | (b["miny"] >= height)
        return F.when(inside, F.lit(1.0)).when(outside, F.lit(0.0)).otherwise(area_inside(rings, width, height) / whole)

    return let(area(rings), lambda whole: F.when(whole > 0, let(bounds(rings), lambda b: share(whole, b))))
