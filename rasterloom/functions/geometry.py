"""Polygons as array<array<struct<x,y>>> columns, ring 0 being the exterior."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ring_area(ring: Column) -> Column:
    """Unsigned shoelace area; a ring may or may not repeat its first vertex."""
    return let(ring, _ring_area)


def _ring_area(ring: Column) -> Column:
    n = F.size(ring)
    nxt = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(n > 0, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(F.lit(0.0))


def area(rings: Column) -> Column:
    """Area of the exterior less that of the holes; null for null rings."""
    return F.when(rings.isNotNull(), let(rings, _area))


def _area(rings: Column) -> Column:
    holes = F.aggregate(F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), ring_area), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(rings) > 0, ring_area(F.get(rings, F.lit(0))) - holes).otherwise(F.lit(0.0))


def bounds(rings: Column) -> Column:
    """struct<minx,miny,maxx,maxy> of the exterior; nulls for no vertex."""
    xs = F.transform(F.get(rings, F.lit(0)), lambda p: p["x"])
    ys = F.transform(F.get(rings, F.lit(0)), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def bbox_to_coco(b: Column) -> Column:
    """[minx, miny, width, height]."""
    return F.array(b["minx"], b["miny"], b["maxx"] - b["minx"], b["maxy"] - b["miny"])


def polygon_to_coco(rings: Column) -> Column:
    """The exterior's vertices as one flat list, closing vertex included."""
    return F.flatten(F.transform(F.get(rings, F.lit(0)), lambda p: F.array(p["x"], p["y"])))


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Rings of an axis-parallel rectangle."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(minx, miny), corner(maxx, miny), corner(maxx, maxy), corner(minx, maxy), corner(minx, miny)))


def parse_wkt(wkt: Column) -> Column:
    """Rings of ``POLYGON ((x y, ...), ...)``, or one ring with one vertex of ``POINT (x y)``; null for anything else."""
    body = F.regexp_extract(wkt, r"(?i)^\s*(?:POLYGON|POINT)\s*Z?\s*\((.*)\)\s*$", 1)
    ring_texts = F.split(F.regexp_replace(F.regexp_replace(body, r"^\s*\(|\)\s*$", ""), r"\)\s*,\s*\(", ";"), ";")

    def vertex(text: Column) -> Column:
        parts = F.split(F.trim(text), r"\s+")
        return F.struct(F.get(parts, F.lit(0)).cast("double").alias("x"), F.get(parts, F.lit(1)).cast("double").alias("y"))

    rings = F.transform(ring_texts, lambda r: F.transform(F.split(r, r"\s*,\s*"), vertex))
    return F.when(wkt.rlike(r"(?i)^\s*(POLYGON|POINT)\s*Z?\s*\(.*\)\s*$"), rings)


def to_wkt(rings: Column) -> Column:
    """``POLYGON ((x y, ...), ...)`` with numbers as Spark prints doubles."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))


def _half_plane(ring: Column, inside, cross) -> Column:
    """One step of polygon clipping: the part of a closed ring for which ``inside`` holds."""
    return let(ring, lambda r: _half_plane_of(r, inside, cross))


def _half_plane_of(ring: Column, inside, cross) -> Column:
    n = F.size(ring)
    before = F.concat(F.slice(ring, n, 1), F.slice(ring, 1, F.greatest(n - 1, F.lit(0))))
    kept = F.zip_with(
        before,
        ring,
        lambda p, q: F.when(inside(q), F.when(inside(p), F.array(q)).otherwise(F.array(cross(p, q), q))).when(inside(p), F.array(cross(p, q))).otherwise(F.slice(F.array(q), 1, 0)),
    )
    return F.when(n > 0, F.flatten(kept)).otherwise(ring)


def clip_ring(ring: Column, width: Column, height: Column) -> Column:
    """A ring clipped to the image rectangle, edge after edge (exact area also for concave rings)."""

    def at_x(v: Column):
        return lambda p, q: F.struct(v.cast("double").alias("x"), (p["y"] + (q["y"] - p["y"]) * (v - p["x"]) / (q["x"] - p["x"])).alias("y"))

    def at_y(v: Column):
        return lambda p, q: F.struct((p["x"] + (q["x"] - p["x"]) * (v - p["y"]) / (q["y"] - p["y"])).alias("x"), v.cast("double").alias("y"))

    zero = F.lit(0.0)
    ring = _half_plane(ring, lambda p: p["x"] >= zero, at_x(zero))
    ring = _half_plane(ring, lambda p: p["x"] <= width, at_x(width))
    ring = _half_plane(ring, lambda p: p["y"] >= zero, at_y(zero))
    return _half_plane(ring, lambda p: p["y"] <= height, at_y(height))


def area_inside(rings: Column, width: Column, height: Column) -> Column:
    """Area of a polygon, holes taken off, inside the image rectangle."""
    return area(F.transform(rings, lambda r: clip_ring(r, width, height)))
