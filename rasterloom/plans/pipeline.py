"""From an image to its mask, polygons and labels, in one chain of DataFrames."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.config import Settings
from rasterloom.functions.affine import affine, move_rings
from rasterloom.operators import annotate, nodata, vectorize
from rasterloom.operators.bands import requested_bands
from rasterloom.operators.crop import crop, parse_bbox, window_of
from rasterloom.operators.infer import Augmented, Constant, Model, file_model
from rasterloom.plans.segment import cells_of, mask_invalid, segment_tiles, tile_pixels
from rasterloom.sources import geojson, stac, zarrcube
from rasterloom.sources.files import model_file, work_folder
from rasterloom.sources.geotiff import cube_of, read_geotiff, write_mask
from rasterloom.sources.tiff import open_tiff


#: Bytes of arrays that one task of inference may hold.
TASK_BYTES = 768 << 20


def macro_cells(s: int, bands: int, classes: int) -> int:
    """Cells along a macro-tile's side: as many as TASK_BYTES allow, one at least and 4096 pixels at most.

    A pixel of the macro-tile and of the cell around it takes its bands, sums, weights and probabilities in doubles, and its bands once more as bytes.
    """
    side = int((TASK_BYTES / (8 * (2 * bands + 2 * classes + 2))) ** 0.5) // s - 2
    return max(1, min(4096 // s, side))


@dataclass(frozen=True)
class Scene:
    """A raster ready for segmentation: its cube and what its profile says."""

    name: str
    cube: DataFrame
    count: int
    width: int
    height: int
    transform: tuple[float, ...]
    crs: str | None
    nodata: float | None
    is_float: bool


def _geotiff(spark: SparkSession, path: str, bands: Sequence[int], bbox) -> Scene:
    t = open_tiff(path)
    count = len(bands) or t.count
    cube = cube_of(read_geotiff(spark, path, bands, bbox), t.block, count)
    return Scene(os.path.basename(path), cube, count, t.width, t.height, t.transform or (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), t.crs, t.nodata, "f" in t.dtype)


def _zarr(spark: SparkSession, path: str, bands: Sequence[int]) -> Scene:
    shape = zarrcube._layout(Path(path))
    meta = zarrcube.read_metadata(str(Path(path).with_suffix(".json"))) or {}
    sizes, block = shape["shape"][-2:], shape["chunks"][-2:]
    have = shape["shape"][0] if len(shape["shape"]) == 3 else 1
    wanted = list(bands) or list(range(1, have + 1))
    tiles = zarrcube.read_zarr(spark, path).withColumnsRenamed({"chunk_row": "cell_row", "chunk_col": "cell_col"}).withColumns({"height": F.lit(sizes[0]), "width": F.lit(sizes[1])})
    places = F.create_map(*(x for b in dict.fromkeys(wanted) for x in (F.lit(b), F.array(*(F.lit(k + 1) for k, w in enumerate(wanted) if w == b)))))
    tiles = tiles.where(F.col("band").isin(wanted)).withColumn("band", F.explode(places[F.col("band")]))
    value = meta.get("nodata")
    return Scene(os.path.basename(path), cube_of(tiles, tuple(block), len(wanted)), len(wanted), sizes[1], sizes[0], meta.get("transform") or (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), meta.get("crs"), None if value is None else float(value), "f" in shape["dtype"])


def _stac(spark: SparkSession, path: str, names: Sequence[str], bbox) -> Scene:
    found = stac.checked_bands(stac.assets(stac.items(spark, path)), names).orderBy("band").collect()
    folder = os.path.dirname(path)
    hrefs = [r["href"] if "://" in r["href"] else os.path.join(folder, r["href"]) for r in found]
    scenes = [_geotiff(spark, h, [1], bbox) for h in hrefs]
    first = scenes[0]
    if any(s.transform != first.transform or (s.width, s.height) != (first.width, first.height) for s in scenes):
        raise ValueError("the bands of the item don't lie on one grid")
    cube = None
    for k, s in enumerate(scenes):
        one = s.cube.select("y", "x", F.col("bands")[0].alias(f"b{k}"))
        cube = one if cube is None else cube.join(one, ["y", "x"])
    name = os.path.basename(path)
    cube = cube.select(F.lit(name).alias("raster_id"), F.lit(first.height).alias("height"), F.lit(first.width).alias("width"), "y", "x", F.array(*(f"b{k}" for k in range(len(scenes)))).alias("bands"))
    return Scene(name, cube, len(scenes), first.width, first.height, first.transform, first.crs, first.nodata, first.is_float)


def open_scene(spark: SparkSession, image: str, bands: Sequence[int] | Sequence[str] = (), bbox=None) -> Scene:
    """A STAC item (``.json``), a Zarr array (``.zarr``) or a GeoTIFF, cropped to ``bbox`` if given."""
    box = parse_bbox(bbox)
    if image.endswith(".json"):
        scene = _stac(spark, image, [str(b) for b in bands], box)
    elif image.rstrip("/").endswith(".zarr"):
        scene = _zarr(spark, image.rstrip("/"), requested_bands(bands))
    else:
        scene = _geotiff(spark, image, requested_bands(bands), box)
    if box is None:
        return scene
    w = window_of(box, scene.transform, scene.width, scene.height)
    cube = crop(scene.cube, w).withColumns({"height": F.lit(w.height), "width": F.lit(w.width)})
    return Scene(scene.name, cube, scene.count, w.width, w.height, w.transform, scene.crs, scene.nodata, scene.is_float)


class SceneSegmenter:
    """A model with its settings; called with an image it writes the mask and what was asked for beside it."""

    def __init__(self, spark: SparkSession, model: Model | str | None = None, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.folder = work_folder(self.settings.work_dir)
        model = model if model is not None else self.settings.model
        if model is None:
            raise ValueError("no model was given")
        o = self.settings
        self.model: Model = file_model(model_file(model, self.folder), o.classes, o.device, o.gpu_id).shipped(spark) if isinstance(model, str) else model
        if self.settings.tta != "identity":
            self.model = Augmented(self.model, self.settings.tta)

    def mask_tiles(self, scene: Scene, edge_mode: str = "reference") -> DataFrame:
        """Class tiles by macro-tiles, 255 where a band is nodata."""
        o, s = self.settings, self.settings.patch_size // 2
        value = scene.nodata if scene.nodata is not None else (None if scene.is_float else 0.0)
        tiles = segment_tiles(cells_of(scene.cube, s, scene.count), self.model, s, scene.count, macro=macro_cells(s, scene.count, o.classes), threshold=self.settings.threshold, skip=value, edge_mode=edge_mode)
        return self._masked(tiles, scene, s)

    def _masked(self, tiles: DataFrame, scene: Scene, s: int) -> DataFrame:
        import numpy as np
        import pyarrow as pa

        is_valid = nodata.valid(F.col("bands"), scene.nodata, scene.is_float)
        bad = scene.cube.where(~is_valid).groupBy(F.expr(f"y div {s}").cast("int").alias("cell_row"), F.expr(f"x div {s}").cast("int").alias("cell_col")).agg(F.collect_list((F.col("y") % s * s + F.col("x") % s).cast("int")).alias("bad"))
        joined = tiles.join(bad, ["cell_row", "cell_col"], "left").select("raster_id", "cell_row", "cell_col", "h", "w", "data", "bad")

        def run(batches):
            for part in batches:
                out = []
                for h, w, data, places in zip(*(part.column(n).to_pylist() for n in ("h", "w", "data", "bad")), strict=True):
                    a = np.frombuffer(data, np.uint8).reshape(h, w).copy()
                    if places:
                        y, x = np.divmod(np.array(places), s)
                        a[y, x] = nodata.MASKED
                    out.append(a.tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(out, pa.binary())], names=part.schema.names[:6])

        return joined.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in joined.dtypes if n != "bad"))

    def __call__(self, image: str, bands: Sequence = (), bbox=None) -> str:
        """The mask's file name; polygons, YOLO rows and the COCO document are written if the settings say so."""
        o = self.settings
        scene = open_scene(self.spark, image, bands or o.band_names or o.bands, bbox if bbox is not None else o.bbox)
        s, uid = o.patch_size // 2, uuid.uuid4().hex[:6]
        base = scene.name.removesuffix(".tif").removesuffix(".zarr")
        name = lambda kind, ext: str(self.folder / f"{base}_{kind}_{uid}.{ext}")
        tiles = self.mask_tiles(scene).cache()
        try:
            write_mask(tiles, name("mask", "tif"), s, scene.width, scene.height, scene.transform, scene.crs)
            if o.vec:
                self._vectors(tile_pixels(tiles, s), scene, name)
        finally:
            tiles.unpersist()
        return os.path.basename(name("mask", "tif"))

    def _vectors(self, mask: DataFrame, scene: Scene, name) -> None:
        o = self.settings
        labelled = vectorize.mask_components(vectorize.mask_runs(mask))
        kept = vectorize.large_enough(vectorize.component_stats(labelled), scene.transform)
        pixels = vectorize.numbered(vectorize.mask_polygons(labelled, kept)).cache()
        try:
            moved = pixels.withColumn("rings", move_rings(F.col("rings"), affine(scene.transform)))
            geojson.write_geojson(annotate.geojson_features(moved.orderBy("feature_id")), name("polygons", "geojson"), scene.crs)
            if o.yolo:
                rows = annotate.yolo_rows(pixels, scene.width, scene.height)
                lines = [" ".join(str(v) for v in r) for r in rows.toLocalIterator()]
                if lines:
                    Path(name("yolo", "csv")).write_text("\n".join(lines) + "\n")
            if o.coco:
                rows = annotate.with_category(pixels, "value")
                image = self.spark.createDataFrame([(1, scene.name, scene.width, scene.height)], "image_id int, file_name string, width int, height int")
                doc = annotate.coco_document(annotate.annotations(rows), annotate.categories(rows), annotate.images(image))
                annotate.write_document(doc, name("coco", "json"))
        finally:
            pixels.unpersist()


__all__ = ["Constant", "Scene", "SceneSegmenter", "mask_invalid", "open_scene"]
