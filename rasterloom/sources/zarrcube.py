"""Zarr arrays (versions 2 and 3) of (band, y, x) with their metadata side file."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"


def parse_transform(text: Column) -> Column:
    """struct<a..f> of the first six numbers of lines like ``| a, b, c|``; null with fewer."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(1)), lambda v: v.cast("double"))
    return F.when(F.size(numbers) >= 6, F.struct(*(F.get(numbers, F.lit(k)).alias(n) for k, n in enumerate("abcdef"))))


def read_metadata(path: str) -> dict | None:
    """The side file's profile, ``BIGTIFF`` and ``compress`` filled up; None when it is missing or no JSON."""
    try:
        meta = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None
    import re

    text = meta.get("transform")
    numbers = [float(x) for x in re.findall(_NUMBER, text)] if isinstance(text, str) else list(text or [])
    return {"BIGTIFF": "Unknown", "compress": "Unknown"} | meta | {"transform": tuple(numbers[:6]) if len(numbers) >= 6 else None}


def _fill(meta: dict):
    return {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf, None: 0}.get(meta.get("fill_value"), meta.get("fill_value"))


_BLOSC = {0: None, 1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}


def _inflate(codec: str, data: bytes, size: int) -> bytes:
    if codec == "zlib":
        return zlib.decompress(data)
    return pa.Codec(codec).decompress(data, size, asbytes=True)


def unblosc(raw: bytes) -> bytes:
    """The bytes of a Blosc (version 1) buffer: LZ4, Snappy, zlib or Zstandard blocks, with or without byte shuffle."""
    flags, item = raw[2], raw[3]
    total, block = struct.unpack_from("<II", raw, 4)
    if flags & 2:  # a plain copy
        return raw[16 : 16 + total]
    codec = _BLOSC.get(flags >> 5)
    if codec is None or flags & 4:
        raise ValueError("BloscLZ and bit-shuffled Blosc buffers can't be read")
    out = []
    for k, at in enumerate(struct.unpack_from(f"<{-(-total // block)}I", raw, 16)):
        size = min(block, total - k * block)
        # full blocks may be split into as many streams as an item has bytes
        streams = item if not flags & 16 and size == block and size % item == 0 else 1
        parts = []
        for _ in range(streams):
            n = struct.unpack_from("<i", raw, at)[0]
            data, at = raw[at + 4 : at + 4 + n], at + 4 + n
            parts.append(data if n == size // streams else _inflate(codec, data, size // streams))
        plain = b"".join(parts)
        if flags & 1 and item > 1:
            whole = size // item * item
            plain = np.frombuffer(plain[:whole], np.uint8).reshape(item, -1).T.tobytes() + plain[whole:]
        out.append(plain)
    return b"".join(out)


def _decoder(codec: str | None) -> Callable[[bytes, int], bytes]:
    known = {None: lambda raw, n: raw, "zlib": lambda raw, n: zlib.decompress(raw), "gzip": lambda raw, n: zlib.decompress(raw, 31), "zstd": lambda raw, n: pa.Codec("zstd").decompress(raw, n, asbytes=True), "lz4": lambda raw, n: pa.Codec("lz4_raw").decompress(raw[4:], n, asbytes=True), "blosc": lambda raw, n: unblosc(raw)}
    if codec not in known:
        raise ValueError(f"chunks packed by {codec} can't be read")
    return known[codec]


def _layout(root: Path) -> dict:
    """shape, chunks, dtype, fill value, codec, and the prefix and separator of chunk names, of a version 2 or 3 array."""
    if (root / "zarr.json").exists():
        meta = json.loads((root / "zarr.json").read_text())
        codecs = [c["name"] for c in meta["codecs"]]
        order = next((c.get("configuration", {}).get("endian", "little") for c in meta["codecs"] if c["name"] == "bytes"), "little")
        packed = [c for c in codecs if c != "bytes"]
        if meta.get("node_type") != "array" or meta["chunk_grid"]["name"] != "regular" or len(packed) > 1:
            raise ValueError(f"{root} isn't a Zarr array with regular chunks and one compressor at most")
        names = meta.get("chunk_key_encoding", {"name": "default"})
        default = names["name"] == "default"
        separator = names.get("configuration", {}).get("separator", "/" if default else ".")
        kind = np.dtype(meta["data_type"]).newbyteorder("<" if order == "little" else ">").str
        return {"shape": meta["shape"], "chunks": meta["chunk_grid"]["configuration"]["chunk_shape"], "dtype": kind, "fill_value": meta.get("fill_value"), "codec": packed[0] if packed else None, "prefix": f"c{separator}" if default else "", "separator": separator}
    meta = json.loads((root / ".zarray").read_text())
    if meta.get("zarr_format") != 2 or meta.get("filters") or meta.get("order", "C") != "C":
        raise ValueError(f"{root} isn't a Zarr array in C order without filters")
    return meta | {"codec": (meta.get("compressor") or {}).get("id"), "prefix": "", "separator": meta.get("dimension_separator", ".")}


def read_zarr(spark: SparkSession, path: str) -> DataFrame:
    """(raster_id, band, chunk_row, chunk_col, h, w, dtype, data) of an array; a task reads chunks by themselves.

    Versions 2 and 3; plain, zlib, gzip, Zstandard, LZ4 and Blosc chunks; a chunk without a file holds the
    fill value.  Anything else is refused.
    """
    root = Path(path)
    meta = _layout(root)
    codec = meta["codec"]
    _decoder(codec)
    shape, size = list(meta["shape"]), list(meta["chunks"])
    if len(shape) == 2:
        shape, size = [1, *shape], [1, *size]
    bands, height, width = shape
    flat, prefix, separator = len(meta["shape"]) == 2, meta["prefix"], meta["separator"]
    bytes_of_chunk = int(np.prod(size)) * np.dtype(meta["dtype"]).itemsize
    grid = [(b, r, c) for b in range(-(-bands // size[0])) for r in range(-(-height // size[1])) for c in range(-(-width // size[2]))]
    names = ["band", "chunk_row", "chunk_col", "h", "w", "dtype", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for b, r, c in zip(*(x.to_pylist() for x in part.columns), strict=True):
                key = prefix + separator.join(map(str, (r, c) if flat else (b, r, c)))
                try:
                    raw = (root / key).read_bytes()
                    chunk = np.frombuffer(_decoder(codec)(raw, bytes_of_chunk), meta["dtype"]).reshape(size)
                except FileNotFoundError:
                    chunk = np.full(size, _fill(meta), meta["dtype"])
                h, w = min(size[1], height - r * size[1]), min(size[2], width - c * size[2])
                rows = [(b * size[0] + k + 1, r, c, h, w, np.dtype(meta["dtype"]).str, np.ascontiguousarray(chunk[k, :h, :w]).tobytes()) for k in range(min(size[0], bands - b * size[0]))]
                kinds = [pa.int32()] * 5 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    tasks = max(1, min(len(grid), 4 * spark.sparkContext.defaultParallelism))
    todo = spark.createDataFrame(grid, "band int, r int, c int").repartition(tasks)
    out = todo.mapInArrow(run, "band int, chunk_row int, chunk_col int, h int, w int, dtype string, data binary")
    return out.withColumn("raster_id", F.lit(root.name))
