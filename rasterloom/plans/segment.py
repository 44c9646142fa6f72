"""Overlapped patch inference: the relational plan (R) and the macro-tile plan (T).

Plan R keeps every prediction in a DataFrame row and can be told in SQL; its shuffle is as wide as
the predictions.  Plan T ships input cells instead, each to the macro-tiles that need it as halo,
and predicts, blends and classifies a macro-tile in one numpy call: predictions never shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import blend, grid, nodata, window
from rasterloom.operators.infer import LinearSoftmax, Model, predict_patches


def weighted_predictions(cube: DataFrame, model: Model, s: int, count: int, skip: float | None | str = "none", edge_mode: str = "reference") -> DataFrame:
    """Plan R up to the blend: (raster_id, height, width, y, x, probs, w) for every pixel of every patch.

    ``skip`` is the nodata value for which empty patches are left out, "none" for no test.
    """
    patches = grid.overlap_patches(grid.pad_grid(cube, s, count), s)
    if skip != "none":
        full = grid.patches_with_data(patches, skip).where("has_data").drop("has_data")
        patches = patches.join(full, ["raster_id", "patch_row", "patch_col"], "left_semi")
    if isinstance(model, LinearSoftmax):
        preds = model.columns(patches)
    else:
        sizes = patches.select("raster_id", "height", "width").distinct()
        found = predict_patches(patches, model, s, count).join(sizes, "raster_id")
        preds = found.withColumns({"y": F.col("patch_row") * s + F.col("py"), "x": F.col("patch_col") * s + F.col("px")})
    w = window.weight(F.col("patch_row"), F.col("patch_col"), grid.cells("height", s), grid.cells("width", s), F.col("py"), F.col("px"), s, edge_mode)
    return preds.select("raster_id", "height", "width", "y", "x", "probs", w.alias("w"))


def segment_relational(cube: DataFrame, model: Model, s: int, count: int, threshold: float = 0.3, valid: Column | None = None, skip: float | None | str = "none", edge_mode: str = "reference") -> DataFrame:
    """(raster_id, y, x, cls, probs, sw) by plan R; ``valid`` is an expression over ``bands``."""
    preds = weighted_predictions(cube, model, s, count, skip, edge_mode)
    inside = preds.where((F.col("y") < F.col("height")) & (F.col("x") < F.col("width")))
    blended = blend.normalize(blend.overlap_blend(inside, model.classes), model.classes)
    # the cube's own pixels decide what comes out: no weight means class 0
    keep = cube.select("raster_id", "y", "x", (F.lit(True) if valid is None else valid).alias("valid"))
    zeros = F.array_repeat(F.lit(0.0), model.classes)
    joined = keep.join(blended, ["raster_id", "y", "x"], "left").withColumns({"probs": F.coalesce("probs", zeros), "sw": F.coalesce("sw", F.lit(0.0))})
    return joined.select("raster_id", "y", "x", nodata.mask_nodata(blend.classify(F.col("probs"), model.classes, threshold), F.col("valid")).alias("cls"), "probs", "sw")


def cells_of(cube: DataFrame, s: int, count: int) -> DataFrame:
    """(raster_id, height, width, cell_row, cell_col, data): each cell's pixels as float64 bytes (band, y, x), missing ones 0."""
    tiled = grid.tile_grid(cube, s)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        data = np.zeros((count, s * s))
        at = table.column("cy").to_numpy().astype(np.int64) * s + table.column("cx").to_numpy()
        data[:, at] = np.array(table.column("bands").combine_chunks().values).reshape(-1, count).T
        return pa.Table.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), pa.array([data.tobytes()], pa.binary())], names=[*keys, "data"])

    keys = ["raster_id", "height", "width", "cell_row", "cell_col"]
    schema = ", ".join(f"{k} {tiled.schema[k].dataType.simpleString()}" for k in keys) + ", data binary"
    return tiled.select(*keys, F.col("cy").cast("int").alias("cy"), F.col("cx").cast("int").alias("cx"), "bands").groupBy(*keys).applyInArrow(pack, schema)


def _empty(patch: np.ndarray, skip: float | None | str) -> bool:
    if skip == "none":
        return False
    if skip is None or skip != skip:
        return not np.isfinite(patch).any()
    return bool((patch == skip).all())


def segment_tiles(tiles: DataFrame, model: Model, s: int, count: int, macro: int = 8, threshold: float = 0.3, skip: float | None | str = "none", edge_mode: str = "reference", batch: int = 16) -> DataFrame:
    """Class tiles (raster_id, cell_row, cell_col, h, w, data uint8) by plan T, from ``cells_of`` rows.

    A macro-tile is macro x macro cells and gets one more cell on each side; the model runs
    about ((macro + 1) / macro)^2 times per patch.  Cells that a sparse raster lacks are zero.
    """
    rows = grid.cells("height", s)
    cols = grid.cells("width", s)

    def owners(cell: str, n: Column) -> Column:
        low = F.floor((F.col(cell) - 1) / macro).cast("int")
        high = F.floor((F.col(cell) + 1) / macro).cast("int")
        return F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.floor((n - 1) / macro).cast("int")))

    spread = tiles.withColumn("macro_row", F.explode(owners("cell_row", rows))).withColumn("macro_col", F.explode(owners("cell_col", cols)))
    keys = ["raster_id", "height", "width", "macro_row", "macro_col"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        raster, height, width, mi, mj = (k.as_py() for k in key)
        n1, n2 = -(-height // s), -(-width // s)
        i0, j0 = mi * macro, mj * macro
        i1, j1 = min(i0 + macro, n1), min(j0 + macro, n2)
        top, left = max(i0 - 1, 0), max(j0 - 1, 0)
        scene = np.zeros((count, (min(i1 + 1, n1) - top) * s, (min(j1 + 1, n2) - left) * s))
        for r, c, data in zip(table.column("cell_row").to_pylist(), table.column("cell_col").to_pylist(), table.column("data").to_pylist(), strict=True):
            scene[:, (r - top) * s : (r - top + 1) * s, (c - left) * s : (c - left + 1) * s] = np.frombuffer(data).reshape(count, s, s)
        total = np.zeros((model.classes, *scene.shape[1:]))
        weight = np.zeros(scene.shape[1:])
        where = [(i, j) for i in range(top, min(i1, n1 - 1)) for j in range(left, min(j1, n2 - 1))]
        cut = lambda i, j: (slice((i - top) * s, (i - top + 2) * s), slice((j - left) * s, (j - left + 2) * s))
        where = [p for p in where if not _empty(scene[(slice(None), *cut(*p))], skip)]
        for at in range(0, len(where), batch):
            some = where[at : at + batch]
            found = model.predict(np.stack([scene[(slice(None), *cut(*p))] for p in some]))
            for (i, j), p in zip(some, found, strict=True):
                w = window.weights(i, j, n1, n2, s, edge_mode)
                total[(slice(None), *cut(i, j))] += p * w
                weight[cut(i, j)] += w
        probs = np.divide(total, weight, out=np.zeros_like(total), where=weight != 0)
        cls = (probs[0] > threshold) if model.classes == 1 else probs.argmax(axis=0)
        out = []
        for i in range(i0, i1):
            for j in range(j0, j1):
                h, w = min(s, height - i * s), min(s, width - j * s)
                out.append((i, j, h, w, cls[(i - top) * s : (i - top) * s + h, (j - left) * s : (j - left) * s + w].astype(np.uint8).tobytes()))
        r, c, h, w, data = zip(*out, strict=True)
        return pa.Table.from_arrays([pa.array([raster] * len(r), key[0].type), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(data, pa.binary())], names=["raster_id", "cell_row", "cell_col", "h", "w", "data"])

    kind = tiles.schema["raster_id"].dataType.simpleString()
    return spread.groupBy(*keys).applyInArrow(run, f"raster_id {kind}, cell_row int, cell_col int, h int, w int, data binary")


def tile_pixels(tiles: DataFrame, s: int) -> DataFrame:
    """Class tiles as pixel rows (raster_id, y, x, cls)."""

    def run(batches):
        for part in batches:
            cells = list(zip(*(part.column(n).to_pylist() for n in ("raster_id", "cell_row", "cell_col", "h", "w", "data")), strict=True))
            if not cells:
                continue
            ids, ys, xs, values = [], [], [], []
            for raster, r, c, h, w, data in cells:
                y, x = np.divmod(np.arange(h * w), w)
                ids += [raster] * (h * w)
                ys.append(y + r * s)
                xs.append(x + c * s)
                values.append(np.frombuffer(data, np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field("raster_id").type), pa.array(np.concatenate(ys), pa.int32()), pa.array(np.concatenate(xs), pa.int32()), pa.array(np.concatenate(values).astype(np.int16))], names=["raster_id", "y", "x", "cls"])

    kind = tiles.schema["raster_id"].dataType.simpleString()
    return tiles.mapInArrow(run, f"raster_id {kind}, y int, x int, cls short")


def mask_invalid(mask: DataFrame, cube: DataFrame, valid: Column) -> DataFrame:
    """``mask`` with 255 where the cube's pixel isn't valid; only invalid pixels take part in the join."""
    bad = cube.where(~valid).select("raster_id", "y", "x").withColumn("bad", F.lit(True))
    joined = mask.join(bad, ["raster_id", "y", "x"], "left")
    return joined.select("raster_id", "y", "x", nodata.mask_nodata(F.col("cls"), F.col("bad").isNull()).alias("cls"))
