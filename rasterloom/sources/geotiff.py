"""GeoTIFF as a Spark data source: ``spark.read.format("geotiff")`` and class-tile writing."""

from __future__ import annotations

import glob
import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from rasterloom.functions.paths import checked_asset
from rasterloom.operators.bands import requested_bands
from rasterloom.operators.crop import parse_bbox, window_of
from rasterloom.sources.tiff import Tiff, open_tiff, opener, write_tiff

SCHEMA = "raster_id string, height int, width int, band int, cell_row int, cell_col int, h int, w int, dtype string, data binary"


@dataclass
class Blocks(InputPartition):
    """Some block rows of a file."""

    first: int
    last: int
    file: int = 0


class GeoTiffReader(DataSourceReader):
    """One row per requested band and block; bands and blocks that nobody asked for aren't read.

    A path with ``*`` names many files, told apart by ``raster_id``.

    Options: ``bands`` ("3,1,3"), ``bbox`` (map units), ``rows`` (block rows per task).  Comparisons
    with cell_row and cell_col are taken over when Spark hands filters to Python sources.
    """

    def __init__(self, options: dict):
        path = options.get("path")
        if "*" in path:  # many files: one reader for each
            found = sorted(glob.glob(path.removeprefix("file://")))
            if not found:
                raise ValueError(f"no file matches {path}")
            self.files = [GeoTiffReader(options | {"path": p}) for p in found]
            return
        self.files = [self]
        self.tiff: Tiff = open_tiff(path)
        self.bands = requested_bands(options.get("bands")) or list(range(1, self.tiff.count + 1))
        if bad := [b for b in self.bands if not 1 <= b <= self.tiff.count]:
            raise ValueError(f"{path} has no bands {bad}")
        rows, cols = self.tiff.grid
        self.low, self.high = [0, 0], [rows - 1, cols - 1]
        self.step = int(options.get("rows", 4))
        box = parse_bbox(options.get("bbox"))
        if box is not None:
            if self.tiff.transform is None:
                raise ValueError(f"{path} has no georeference for a bounding box")
            w = window_of(box, self.tiff.transform, self.tiff.width, self.tiff.height)
            bh, bw = self.tiff.block
            self.low = [w.row // bh, w.col // bw]
            self.high = [max(w.row + w.height - 1, 0) // bh, max(w.col + w.width - 1, 0) // bw]

    def pushFilters(self, filters):
        filters = list(filters)
        for f in self.files:
            f._narrow(filters)
        yield from filters  # rows are few enough to be tested again

    def _narrow(self, filters) -> None:
        for f in filters:
            axis = {("cell_row",): 0, ("cell_col",): 1}.get(getattr(f, "attribute", None))
            if axis is not None and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    self.low[axis] = max(self.low[axis], int(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    self.high[axis] = min(self.high[axis], int(f.value) - isinstance(f, LessThan))

    def partitions(self):
        found = [Blocks(r, min(r + f.step - 1, f.high[0]), k) for k, f in enumerate(self.files) for r in range(f.low[0], f.high[0] + 1, f.step)]
        return found or [Blocks(0, -1)]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        return self.files[partition.file]._read(partition)

    def _read(self, partition: Blocks) -> Iterator[tuple]:
        t, read = self.tiff, opener(self.tiff.path)
        name = os.path.basename(t.path)
        for r in range(partition.first, partition.last + 1):
            for c in range(self.low[1], self.high[1] + 1):
                for k, band in enumerate(self.bands):
                    data = t.read_block(band, r, c, read)
                    yield name, t.height, t.width, k + 1, r, c, *data.shape, data.dtype.str, data.tobytes()


class ClassTileWriter(DataSourceWriter):
    """Class tiles (cell_row, cell_col, h, w, data) into one file: fragments by the tasks, put together at commit."""

    def __init__(self, options: dict, fields: list[str], overwrite: bool):
        self.path, self.options, self.fields = options["path"].removeprefix("file://"), options, fields
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")
        self.folder = self.path + ".parts"
        shutil.rmtree(self.folder, ignore_errors=True)

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        name = f"{self.folder}/{task.partitionId()}-{task.taskAttemptId()}.npz"
        found = {f"{r['cell_row']}_{r['cell_col']}": np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"]) for r in rows}
        np.savez_compressed(name, **found)
        return Fragment(name)

    def commit(self, messages) -> None:
        o = self.options
        tile, factor = int(o.get("tile", 256)), int(o["cell"])
        if tile % factor:
            raise ValueError("a tile's side must be a multiple of a cell's")
        where = {}
        for m in messages:
            if m is not None:
                with np.load(m.name) as z:
                    for key in z.files:
                        r, c = map(int, key.split("_"))
                        where.setdefault((r * factor // tile, c * factor // tile), []).append((m.name, key, r, c))

        def tiles():
            for (tr, tc), some in sorted(where.items()):
                full = np.zeros((tile, tile), np.uint8)
                for name, key, r, c in some:
                    with np.load(name) as z:
                        a = z[key]
                    y, x = r * factor - tr * tile, c * factor - tc * tile
                    full[y : y + a.shape[0], x : x + a.shape[1]] = a
                yield tr, tc, full

        transform = tuple(map(float, o["transform"].split(","))) if o.get("transform") else None
        write_tiff(self.path, tiles(), int(o["width"]), int(o["height"]), "u1", tile, transform, o.get("crs"), float(o.get("nodata", 255)))
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


@dataclass
class Fragment(WriterCommitMessage):
    name: str


class GeoTiffSource(DataSource):
    """``format("geotiff")``."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GeoTiffReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ClassTileWriter(dict(self.options), schema.fieldNames(), overwrite)


def read_geotiff(spark: SparkSession, path: str, bands=None, bbox=None) -> DataFrame:
    """Tiles of a GeoTIFF path or URL, or of all files that a path with ``*`` matches."""
    spark.dataSource.register(GeoTiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters, and isn't read otherwise
    options = {"bands": ",".join(map(str, requested_bands(bands)))}
    if bbox is not None:
        options["bbox"] = ",".join(map(str, parse_bbox(bbox)))
    return spark.read.format("geotiff").options(**options).load(path if "*" in path else checked_asset(path))


def write_scenes(pixels: DataFrame, folder: str, rows: int, width: int, tile: int = 16) -> DataFrame:
    """(path) of one-band GeoTIFF files below ``folder``, ``k-bN.tif`` with ``rows`` raster rows each, from (y, x, band, v) pixels.

    A task holds one scene's band.  A file is written under a name of its task attempt's and then
    renamed, so a lost executor leaves no half of one.
    """
    import pandas as pd

    root = folder.removeprefix("file://")

    def run(key: tuple, px: pd.DataFrame) -> pd.DataFrame:
        from pyspark import TaskContext

        scene, band = key
        height = int(px["y"].max()) % rows + 1
        full = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile))
        full[px["y"] % rows, px["x"]] = px["v"]
        os.makedirs(root, exist_ok=True)
        path = f"{root}/{scene}-b{band}.tif"
        part = f"{path}.{TaskContext.get().taskAttemptId()}"
        write_tiff(part, ((r, c, full[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]) for r in range(full.shape[0] // tile) for c in range(full.shape[1] // tile)), width, height, "f8", tile)
        os.replace(part, path)
        return pd.DataFrame({"path": [path]})

    return pixels.withColumn("scene", F.expr(f"y div {rows}").cast("int")).groupBy("scene", "band").applyInPandas(run, "path string")


def pixels_of(tiles: DataFrame, block: tuple[int, int]) -> DataFrame:
    """Tiles as long pixels (raster_id, height, width, y, x, band, v)."""
    import pyarrow as pa

    def run(batches):
        for part in batches:
            for raster, height, width, band, r, c, h, w, dtype, data in zip(*(part.column(n).to_pylist() for n in ("raster_id", "height", "width", "band", "cell_row", "cell_col", "h", "w", "dtype", "data")), strict=True):
                y, x = np.divmod(np.arange(h * w), w)
                n = h * w
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raster] * n), pa.array(np.full(n, height, np.int32)), pa.array(np.full(n, width, np.int32)), pa.array((y + r * block[0]).astype(np.int32)), pa.array((x + c * block[1]).astype(np.int32)), pa.array(np.full(n, band, np.int32)), pa.array(np.frombuffer(data, dtype).astype(float))],
                    names=["raster_id", "height", "width", "y", "x", "band", "v"],
                )

    return tiles.mapInArrow(run, "raster_id string, height int, width int, y int, x int, band int, v double")


def cube_of(tiles: DataFrame, block: tuple[int, int], count: int) -> DataFrame:
    """Tiles as cube rows (raster_id, height, width, y, x, bands)."""
    long = pixels_of(tiles, block)
    each = [F.coalesce(F.max(F.when(F.col("band") == b, F.col("v"))), F.lit(0.0)) for b in range(1, count + 1)]
    return long.groupBy("raster_id", "height", "width", "y", "x").agg(F.array(*each).alias("bands"))


def write_mask(tiles: DataFrame, path: str, cell: int, width: int, height: int, transform=None, crs: str | None = None, tile: int | None = None) -> None:
    """Class tiles as a one-band uint8 GeoTIFF with nodata 255."""
    tiles.sparkSession.dataSource.register(GeoTiffSource)
    options = {"cell": str(cell), "width": str(width), "height": str(height), "tile": str(tile or max(1, 256 // cell) * cell)}
    if transform:
        options["transform"] = ",".join(repr(float(v)) for v in transform)
    if crs:
        options["crs"] = crs
    tiles.select("cell_row", "cell_col", "h", "w", "data").write.format("geotiff").options(**options).mode("append").save(path)
