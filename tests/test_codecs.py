"""Zarr codecs and versions, boxes of many sizes, and the size of macro-tiles."""

import json
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.operators.overlap import bbox_overlap
from rasterloom.plans.pipeline import TASK_BYTES, macro_cells
from rasterloom.sources import zarrcube


def blosc(data: bytes, item: int, block: int, codec: str, shuffle: bool, split: bool) -> bytes:
    """A Blosc buffer, made by hand."""
    number = {"lz4_raw": 1, "snappy": 2, "zlib": 3, "zstd": 4}[codec]
    squeeze = zlib.compress if codec == "zlib" else lambda x: pa.Codec(codec).compress(x, asbytes=True)
    starts, body = [], b""
    count = -(-len(data) // block)
    for k in range(count):
        part = data[k * block : (k + 1) * block]
        starts.append(16 + 4 * count + len(body))
        if shuffle:
            whole = len(part) // item * item
            part = np.frombuffer(part[:whole], np.uint8).reshape(-1, item).T.tobytes() + part[whole:]
        n = item if split and len(part) == block else 1
        for s in range(n):
            stream = part[s * len(part) // n : (s + 1) * len(part) // n]
            packed = squeeze(stream)
            packed = packed if len(packed) < len(stream) else stream
            body += struct.pack("<i", len(packed)) + packed
    flags = number << 5 | shuffle | (0 if split else 16)
    return struct.pack("<BBBBIII", 2, 1, flags, item, len(data), block, 16 + 4 * count + len(body)) + struct.pack(f"<{count}I", *starts) + body


@pytest.mark.parametrize("codec", ["lz4_raw", "snappy", "zlib", "zstd"])
@pytest.mark.parametrize("shuffle", [True, False])
@pytest.mark.parametrize("split", [True, False])
def test_blosc(codec, shuffle, split):
    data = np.random.default_rng(1).integers(0, 40, 1001).astype("<i4").tobytes() + b"xy"
    assert zarrcube.unblosc(blosc(data, 4, 1024, codec, shuffle, split)) == data
    assert zarrcube.unblosc(struct.pack("<BBBBIII", 2, 1, 2, 4, 3, 3, 19) + b"abc") == b"abc"
    with pytest.raises(ValueError):
        zarrcube.unblosc(struct.pack("<BBBBIII", 2, 1, 4 | 1 << 5, 4, 8, 8, 24) + bytes(8))


@pytest.mark.parametrize("kind", ["v2 blosc", "v2 zstd", "v2 plain", "v3 gzip", "v3 zstd", "v3 blosc"])
def test_arrays(spark, tmp_path, kind):
    version, codec = kind.split()
    root = tmp_path / "a.zarr"
    x = np.arange(2 * 10 * 7, dtype="<f4").reshape(2, 10, 7)
    pack = {"blosc": lambda b: blosc(b, 4, 64, "lz4_raw", True, True), "zstd": lambda b: pa.Codec("zstd").compress(b, asbytes=True), "plain": lambda b: b, "gzip": lambda b: zlib.compressobj(6, zlib.DEFLATED, 31).compress(b) + b""}[codec]
    if codec == "gzip":
        import gzip

        pack = gzip.compress
    root.mkdir()
    if version == "v2":
        (root / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 10, 7], "chunks": [1, 4, 4], "dtype": "<f4", "compressor": None if codec == "plain" else {"id": codec}, "fill_value": -1, "order": "C", "filters": None}))
    else:
        (root / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": [2, 10, 7], "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1, 4, 4]}}, "chunk_key_encoding": {"name": "default"}, "fill_value": -1, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": codec}]}))
    for b in range(2):
        for r in range(3):
            for c in range(2):
                if (b, r, c) == (1, 2, 0):
                    continue
                full = np.full((1, 4, 4), -1, "<f4")
                some = x[b, r * 4 : r * 4 + 4, c * 4 : c * 4 + 4]
                full[0, : some.shape[0], : some.shape[1]] = some
                at = root / (f"{b}.{r}.{c}" if version == "v2" else f"c/{b}/{r}/{c}")
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_bytes(pack(full.tobytes()))
    got = np.zeros((2, 10, 7), "<f4")
    for t in zarrcube.read_zarr(spark, str(root)).collect():
        got[t["band"] - 1, t["chunk_row"] * 4 : t["chunk_row"] * 4 + t["h"], t["chunk_col"] * 4 : t["chunk_col"] * 4 + t["w"]] = np.frombuffer(t["data"], t["dtype"]).reshape(t["h"], t["w"])
    want = x.copy()
    want[1, 8:, :4] = -1
    assert np.array_equal(got, want)


def test_unknown_codecs_are_refused(spark, tmp_path):
    (tmp_path / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [4, 4], "chunks": [4, 4], "dtype": "<f4", "compressor": {"id": "bz2"}, "fill_value": 0, "order": "C", "filters": None}))
    with pytest.raises(ValueError):
        zarrcube.read_zarr(spark, str(tmp_path))


@pytest.mark.parametrize("bucket", [None, 3.0])
def test_boxes_of_many_sizes(spark, bucket):
    rng = random.Random(2)

    def some(n, sizes):
        out = []
        for k in range(n):
            x, y, s = rng.uniform(-100, 100), rng.uniform(-100, 100), rng.choice(sizes)
            out.append((k, x, y, x + rng.uniform(0, s), y + rng.uniform(0, s)))
        return out

    polygons, images = some(150, [0, 1, 10, 500, 20_000]) + [(900, None, 0.0, 1.0, 1.0), (901, 5.0, 5.0, 5.0, 5.0)], [(k, 20.0 * (k % 10) - 100, 20.0 * (k // 10) - 100, 20.0 * (k % 10) - 80, 20.0 * (k // 10) - 80) for k in range(100)]
    a = spark.createDataFrame(polygons, "a long, minx double, miny double, maxx double, maxy double")
    b = spark.createDataFrame(images, "b long, minx double, miny double, maxx double, maxy double")
    met = bbox_overlap(a, b, bucket)
    got = sorted((r["a"], r["b"]) for r in met.select("a", "b").collect())
    assert got == sorted((p[0], i[0]) for p in polygons if p[1] is not None for i in images if p[1] <= i[3] and p[3] >= i[1] and p[2] <= i[4] and p[4] >= i[2])
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    assert bbox_overlap(a, b.limit(0), bucket).count() == 0 and bbox_overlap(a.limit(0), b, bucket).count() == 0


def test_macro_tiles_fit_their_bytes():
    for s, bands, classes in ((512, 3, 5), (128, 4, 1), (512, 12, 30), (8, 2, 3)):
        side = (macro_cells(s, bands, classes) + 2) * s
        assert macro_cells(s, bands, classes) == 1 or side**2 * 8 * (2 * bands + 2 * classes + 2) <= TASK_BYTES
    assert macro_cells(512, 3, 5) >= 2
