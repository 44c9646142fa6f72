"""GeoJSON and label tables."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.geometry import RINGS, to_wkt
from rasterloom.operators.annotate import geojson_features

log = logging.getLogger(__name__)
_POINTS = "array<array<array<double>>>"


def _rings(coordinates):
    return F.transform(coordinates, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def parse_features(features: DataFrame, properties: str) -> DataFrame:
    """Polygon rows of one-feature texts (``json``) with the named properties; other geometries have null rings."""
    shape = f"struct<type:string,properties:struct<{', '.join(':'.join(p.split(None, 1)) for p in properties.split(','))}>,geometry:struct<type:string,coordinates:{_POINTS}>>"
    parsed = features.select(F.from_json("json", shape).alias("f"))
    polygon = F.when(F.col("f.geometry.type") == "Polygon", _rings(F.col("f.geometry.coordinates")))
    return parsed.select("f.properties.*", polygon.alias("rings"))


def read_geojson(spark: SparkSession, path: str, properties: str = "value double") -> DataFrame:
    """Polygons of a FeatureCollection file: the properties, rings and crs.  An unreadable file gives no rows."""
    fields = ", ".join(":".join(p.split(None, 1)) for p in properties.split(","))
    empty = f"{properties}, rings {RINGS}, crs string"
    if "://" not in path and not Path(path).exists():
        log.warning("%s can't be read; no features", path)
        return spark.createDataFrame([], empty)
    shape = f"struct<crs:struct<properties:struct<name:string>>,features:array<struct<properties:struct<{fields}>,geometry:struct<type:string,coordinates:{_POINTS}>>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("d"))
    rows = text.select(F.col("d.crs.properties.name").alias("crs"), F.explode("d.features").alias("f"))
    polygon = F.when(F.col("f.geometry.type") == "Polygon", _rings(F.col("f.geometry.coordinates")))
    return rows.select("f.properties.*", polygon.alias("rings"), "crs")


def read_labels(spark: SparkSession, source: str | DataFrame, properties: str = "value double") -> DataFrame:
    """A label table from a GeoJSON file (``*json``), a CSV file, or as it is."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str | Path):
        raise ValueError(f"{type(source).__name__} can't be read as a label table")
    if str(source).endswith("json"):
        return read_geojson(spark, str(source), properties)
    return spark.read.csv(str(source), header=True, inferSchema=True)


def label_union(tables: Sequence[DataFrame]) -> DataFrame:
    """All tables in one; columns that one of them lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_pixel_frame(frame: DataFrame, path: str, crs: str | None = None) -> None:
    """A pixel-coordinate label table: GeoJSON for ``*json``, else CSV with the rings as WKT (K6).

    All columns but ``rings`` are properties.  The CSV is a folder of part files, each with a header.
    """
    names = [c for c in frame.columns if c != "rings"]
    if path.endswith("json"):
        write_geojson(geojson_features(frame, names), path, crs)
    else:
        frame.select(*names, to_wkt(F.col("rings")).alias("geometry")).write.csv(path, header=True, mode="overwrite")


def write_geojson(features: DataFrame, path: str, crs: str | None = None) -> None:
    """A FeatureCollection in one file on the driver, feature by feature as they come."""
    head = '{"type": "FeatureCollection", ' + (f'"crs": {{"type": "name", "properties": {{"name": "{crs}"}}}}, ' if crs else "") + '"features": ['
    with open(path, "w") as out:
        out.write(head)
        for k, row in enumerate(features.toLocalIterator()):
            out.write((",\n" if k else "\n") + row[0])
        out.write("\n]}\n")
