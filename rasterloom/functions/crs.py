"""Coordinate reference systems by EPSG code, and reprojection in closed form.

Geographic WGS 84 (4326), Web Mercator (3857), and UTM on WGS 84 (32601-32660 north, 32701-32760
south) are column expressions; UTM by Krueger's series, exact to well below a millimetre.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _FLAT = 6378137.0, 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4)
_NAMED = {"WGS84": 4326, "CRS84": 4326, "OGC:CRS84": 4326}


def check_crs(crs: int | str | None) -> int | None:
    """The EPSG code of a code, ``EPSG:n``, an OGC URN or a WKT with an EPSG authority; None stays None.

    ValueError for text that names no code, TypeError for anything else.
    """
    if crs is None or isinstance(crs, int) and not isinstance(crs, bool):
        return crs
    if not isinstance(crs, str):
        raise TypeError(f"{type(crs).__name__} isn't a coordinate reference system")
    text = crs.strip()
    if text.upper() in _NAMED or text.upper().endswith(":CRS84"):
        return 4326
    short = re.fullmatch(r"(?i)(?:EPSG:|urn:ogc:def:crs:EPSG:[^:]*:)?(\d+)", text)
    if short:
        return int(short[1])
    # the outermost authority of a WKT is its last one
    found = re.findall(r'(?i)(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]', text)
    if not found:
        raise ValueError(f"no EPSG code in {crs!r}")
    return int(found[-1])


def _zone(code: int) -> tuple[float, float] | None:
    """Central meridian (radians) and false northing of a UTM code."""
    north, south = 32601 <= code <= 32660, 32701 <= code <= 32760
    if not north and not south:
        return None
    return math.radians((code % 100) * 6 - 183), 10_000_000.0 if south else 0.0


def _to_degrees(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    if code == 4326:
        return x, y
    if code == 3857:
        return F.degrees(x / _A), F.degrees(2 * F.atan(F.exp(y / _A)) - math.pi / 2)
    zone = _zone(code)
    if zone is None:
        raise ValueError(f"EPSG:{code} can't be reprojected here")
    xi, eta = (y - zone[1]) / (0.9996 * _RECT), (x - 500_000.0) / (0.9996 * _RECT)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.lit(zone[0]) + F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def _from_degrees(lon: Column, lat: Column, code: int) -> tuple[Column, Column]:
    if code == 4326:
        return lon, lat
    if code == 3857:
        return F.radians(lon) * _A, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * _A
    zone = _zone(code)
    if zone is None:
        raise ValueError(f"EPSG:{code} can't be reprojected here")
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon) - zone[0]
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000.0 + 0.9996 * _RECT * east, zone[1] + 0.9996 * _RECT * north


def reproject(x: Column, y: Column, source: int | str, target: int | str) -> tuple[Column, Column]:
    """(x, y) of one system in another; the same system gives the same columns."""
    a, b = check_crs(source), check_crs(target)
    if a == b:
        return x, y
    return _from_degrees(*_to_degrees(x, y, a), b)


def reproject_bounds(box: tuple[Column, Column, Column, Column], source: int | str, target: int | str, steps: int = 21) -> tuple[Column, Column, Column, Column]:
    """minx, miny, maxx, maxy of a box in another system: the envelope of ``steps`` points along each of its sides.

    A null in the box gives nulls.
    """
    if check_crs(source) == check_crs(target):
        return box
    minx, miny, maxx, maxy = box
    xs, ys = [], []
    for k in range(steps):
        along_x, along_y = minx + (maxx - minx) * (k / (steps - 1)), miny + (maxy - miny) * (k / (steps - 1))
        for x, y in ((along_x, miny), (along_x, maxy), (minx, along_y), (maxx, along_y)):
            u, v = reproject(x, y, source, target)
            xs.append(u)
            ys.append(v)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)
