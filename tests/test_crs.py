"""CRS codes and reprojection, device choice, numbering and the pixel-frame sink."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.functions.crs import check_crs, reproject, reproject_bounds
from rasterloom.functions.geometry import box
from rasterloom.operators.infer import OnnxModel, TorchModel, chosen_device, file_model, gpu_stats
from rasterloom.operators.number import numbered_rows
from rasterloom.sources.geojson import read_geojson, write_pixel_frame


def test_codes():
    assert check_crs(None) is None and check_crs(4326) == 4326 and check_crs("EPSG:32616") == 32616
    assert check_crs("urn:ogc:def:crs:EPSG::3857") == 3857 and check_crs("urn:ogc:def:crs:OGC:1.3:CRS84") == 4326
    assert check_crs('PROJCS["x",GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32611"]]') == 32611
    with pytest.raises(ValueError):
        check_crs("somewhere")
    with pytest.raises(TypeError):
        check_crs(1.5)


def one(spark, x, y, a, b):
    df = spark.createDataFrame([(x, y)], "x double, y double")
    return tuple(df.select(*reproject(F.col("x"), F.col("y"), a, b)).first())


@pytest.mark.parametrize("code", [3857, 32601, 32616, 32660, 32733])
def test_there_and_back(spark, code):
    rng = random.Random(code)
    middle = 0.0 if code == 3857 else (code % 100) * 6 - 183
    south = code > 32700
    rows = [(middle + rng.uniform(-3, 3), rng.uniform(-70, -1) if south else rng.uniform(1, 80)) for _ in range(50)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    x, y = reproject(F.col("lon"), F.col("lat"), 4326, code)
    there = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = reproject(F.col("x"), F.col("y"), code, "EPSG:4326")
    for r in there.select("lon", "lat", "x", lon.alias("u"), lat.alias("v")).collect():
        if r["lon"] is None:
            assert r["x"] is None
        else:
            assert abs(r["lon"] - r["u"]) < 1e-9 and abs(r["lat"] - r["v"]) < 1e-9


def test_utm_on_the_central_meridian(spark):
    """There the northing is 0.9996 times the length of the meridian, here summed up in small steps."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    n, top = 20_000, math.radians(47.5)
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin((k + 0.5) * top / n) ** 2) ** 1.5 for k in range(n)) * top / n
    x, y = one(spark, -87.0, 47.5, 4326, 32616)
    assert abs(x - 500_000) < 1e-6 and abs(y - 0.9996 * arc) < 1e-3
    assert abs(one(spark, -87.0, -47.5, 4326, 32716)[1] - (10_000_000 - 0.9996 * arc)) < 1e-3


def test_bounds(spark):
    df = spark.createDataFrame([(-88.0, 40.0, -86.0, 42.0), (None, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    cols = tuple(F.col(c) for c in "abcd")
    assert reproject_bounds(cols, 4326, "EPSG:4326") == cols
    r = df.select(*(c.alias(n) for c, n in zip(reproject_bounds(cols, 4326, 32616), "wxyz", strict=True))).collect()
    lower = one(spark, -87.0, 40.0, 4326, 32616)[1]
    assert abs(r[0]["x"] - lower) < 1e-6  # the southern side bends down to its middle
    assert r[0]["w"] < 500_000 < r[0]["y"]
    with pytest.raises(ValueError):
        reproject(F.col("a"), F.col("b"), 4326, 2154)


def test_devices(spark, tmp_path):
    devices = [(0, 100.0, 1000.0, 5.0), (1, 900.0, 1000.0, 80.0), (2, 900.0, 1000.0, 10.0), (3, 800.0, 1000.0, 0.0)]
    assert chosen_device("cpu", 0, devices) == "cpu" and chosen_device("gpu", 0, devices) == "cuda:2"
    assert chosen_device("gpu", 3, devices) == "cuda:3" and chosen_device("gpu", 0, devices[:2]) == "cpu"
    assert chosen_device("gpu", 0, []) == "cpu"
    stats = gpu_stats(spark.createDataFrame(devices, "gpu int, memory_free double, memory_total double, load double"))
    assert [r["memory_used"] for r in stats.orderBy("gpu").collect()] == [900.0, 100.0, 100.0, 200.0]
    assert isinstance(file_model("a/b.PT", 3), TorchModel) and isinstance(file_model("a/b.onnx", 3), OnnxModel)
    (tmp_path / "net.onnx").write_bytes(b"some bytes")
    sent = file_model(str(tmp_path / "net.onnx"), 2).shipped(spark)

    def size(batches):
        for part in batches:
            import os

            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([os.path.getsize(sent.local_path())] * part.num_rows)], names=["n"])

    assert {r["n"] for r in spark.range(4).mapInArrow(size, "n long").collect()} == {10}


def test_torch_model(tmp_path):
    torch = pytest.importorskip("torch")
    net = torch.nn.Conv2d(2, 3, 1)
    torch.jit.script(net).save(str(tmp_path / "net.pt"))
    import numpy as np

    assert file_model(str(tmp_path / "net.pt"), 3).predict(np.zeros((1, 2, 4, 4))).shape == (1, 3, 4, 4)


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1000), k) for k in range(500)] + [(None, -1)]
    got = numbered_rows(spark.createDataFrame(rows, "v long, k long").repartition(7), "v", "id", start=5).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(5, 506)) and got[0]["v"] is None
    assert [r["v"] for r in got[1:]] == sorted(v for v, _ in rows[:-1])
    assert numbered_rows(spark.createDataFrame([], "v long"), "v", "id").count() == 0


def test_pixel_frame_sink(spark, tmp_path):
    frame = spark.range(3).select("id", F.lit("a.tif").alias("image_fname"), box(F.col("id"), F.lit(0), F.col("id") + 2, F.lit(1)).alias("rings"))
    write_pixel_frame(frame, str(tmp_path / "px.geojson"))
    assert read_geojson(spark, str(tmp_path / "px.geojson"), "id bigint, image_fname string").count() == 3
    assert json.loads((tmp_path / "px.geojson").read_text())["type"] == "FeatureCollection"
    write_pixel_frame(frame, str(tmp_path / "px.csv"))
    back = spark.read.csv(str(tmp_path / "px.csv"), header=True).orderBy("id").collect()
    assert len(back) == 3 and back[1]["geometry"].startswith("POLYGON ((1.0 0.0") and back[1]["image_fname"] == "a.tif"
