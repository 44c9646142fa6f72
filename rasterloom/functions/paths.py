"""Names, paths and URLs of assets."""

from __future__ import annotations

import re
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIFF = r"(?i)\.(tiff|tif)$"


def is_tiff_path(path: Column) -> Column:
    return path.rlike(_TIFF)


def is_tiff_url(url: Column) -> Column:
    """Judged by the last part of the URL's path, so queries and fragments don't matter."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return path.rlike(_TIFF)


def output_name(asset: Column, kind: str, uid: str, extension: str) -> Column:
    """``<base>_<kind>_<uid>.<extension>``, where base is the file name less ``.tif`` or ``.zarr``."""
    base = F.regexp_replace(F.regexp_extract(asset, r"([^/]*)/*$", 1), r"\.(tif|zarr)$", "")
    return F.concat(base, F.lit(f"_{kind}_{uid}.{extension}"))


def checked_asset(asset: str | Path) -> str:
    """A readable asset's path or URL; ValueError says whether URL, file or type is at fault."""
    if not isinstance(asset, str | Path):
        raise ValueError(f"Invalid image_asset type: {type(asset).__name__}")
    text = str(asset)
    if urlparse(text).scheme in ("http", "https"):
        if not re.search(_TIFF, Path(urlparse(text).path).name):
            raise ValueError(f"Invalid image_asset URL: {text}")
    elif not (re.search(_TIFF, text) and Path(text).is_file()):
        raise ValueError(f"Invalid image_asset file: {text}")
    return text
