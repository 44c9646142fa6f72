"""Padding, cells and overlapping patches.

A cube row is (raster_id, height, width, y, x, bands).  Cells are s x s pixels; patch (i, j) is
the cells (i..i+1, j..j+1) and exists for 0 <= i <= n1 - 2, 0 <= j <= n2 - 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.nodata import finite


def cells(size: Column | str, s: int) -> Column:
    """How many cells a side of that many pixels has."""
    size = F.col(size) if isinstance(size, str) else size
    return F.ceil(size / s).cast("int")


def pad_grid(cube: DataFrame, s: int, count: int) -> DataFrame:
    """The cube with zero pixels for all that is missing up to a multiple of ``s`` below and to the right."""
    rasters = cube.select("raster_id", "height", "width").distinct()
    rows = rasters.withColumn("y", F.explode(F.sequence(F.lit(0), cells("height", s) * s - 1)))
    full = rows.withColumn("x", F.explode(F.sequence(F.lit(0), cells("width", s) * s - 1)))
    filled = full.join(cube.drop("height", "width"), ["raster_id", "y", "x"], "left")
    return filled.withColumn("bands", F.coalesce("bands", F.array_repeat(F.lit(0.0), count)))


def tile_grid(cube: DataFrame, s: int) -> DataFrame:
    """Each pixel's cell and its place there."""
    return cube.withColumns({"cell_row": F.expr(f"y div {s}").cast("int"), "cell_col": F.expr(f"x div {s}").cast("int"), "cy": F.col("y") % s, "cx": F.col("x") % s})


def _owners(cell: Column, n: Column) -> Column:
    return F.filter(F.array(cell - 1, cell), lambda a: (a >= 0) & (a <= n - 2))


def overlap_patches(padded: DataFrame, s: int) -> DataFrame:
    """Each pixel once for every patch that it lies in (four at most): patch_row, patch_col, py, px."""
    tiled = tile_grid(padded, s)
    rows = tiled.withColumn("patch_row", F.explode(_owners(F.col("cell_row"), cells("height", s))))
    both = rows.withColumn("patch_col", F.explode(_owners(F.col("cell_col"), cells("width", s))))
    place = {"py": F.col("y") - F.col("patch_row") * s, "px": F.col("x") - F.col("patch_col") * s}
    return both.withColumns(place).drop("cell_row", "cell_col", "cy", "cx")


def patches_with_data(patches: DataFrame, nodata: float | None) -> DataFrame:
    """(raster_id, patch_row, patch_col, has_data): false where a patch holds nothing but nodata, padding included.

    Without a nodata value, or with NaN, a patch without any finite value is empty.
    """
    some = finite if nodata is None or nodata != nodata else (lambda v: v != F.lit(float(nodata)))
    return patches.groupBy("raster_id", "patch_row", "patch_col").agg(F.bool_or(F.exists("bands", some)).alias("has_data"))
