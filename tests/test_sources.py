"""Codecs, sources, settings and the whole pipeline on small files."""

import json
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import cli
from rasterloom.config import Settings, augmentation, from_command_line, from_yaml, truth
from rasterloom.functions import paths
from rasterloom.operators.bands import requested_bands
from rasterloom.operators.crop import parse_bbox, window_of
from rasterloom.operators.infer import Constant, LinearSoftmax
from rasterloom.plans.pipeline import SceneSegmenter, open_scene
from rasterloom.sources import files, geojson, geotiff, manifest, stac, tiff, zarrcube
from rasterloom.streaming import inbox

T = (0.5, 0.0, 1000.0, 0.0, -0.5, 2000.0)


def plain_tiff(path, cube, order="<", planar=1, compression=1, rows_per_strip=5, predictor=1):
    """A classic striped TIFF of (band, y, x), written tag by tag."""
    kind = cube.dtype.newbyteorder(order)
    c, h, w = cube.shape
    strips = []
    for part in ([cube] if planar == 1 else [cube[k : k + 1] for k in range(c)]):
        for y in range(0, h, rows_per_strip):
            block = np.moveaxis(part[:, y : y + rows_per_strip], 0, 2)
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
            raw = np.ascontiguousarray(block.astype(kind)).tobytes()
            strips.append({1: lambda b: b, 8: zlib.compress, 5: lzw, 32773: packbits}[compression](raw))
    fmt = {"u": 1, "i": 2, "f": 3}[kind.kind]
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [kind.itemsize * 8] * c), 259: (3, [compression]), 262: (3, [1]), 277: (3, [c]), 278: (4, [rows_per_strip]), 284: (3, [planar]), 317: (3, [predictor]), 339: (3, [fmt] * c), 33550: (12, [0.5, 0.5, 0.0]), 33922: (12, [0, 0, 0, 1000.0, 2000.0, 0]), 34735: (3, [1, 1, 0, 1, 3072, 0, 1, 32616]), 42113: (2, b"7\0")}
    at = 8
    places = []
    for s in strips:
        places.append(at)
        at += len(s)
    tags[273], tags[279] = (4, places), (4, [len(s) for s in strips])
    code = {3: "H", 4: "I", 12: "d"}
    body, extra, base = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, (t, v) in sorted(tags.items()):
        data = v if t == 2 else struct.pack(f"{order}{len(v)}{code[t]}", *v)
        n = len(v)
        body += struct.pack(f"{order}HHI", tag, t, n) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", base + len(extra)))
        extra += b"" if len(data) <= 4 else data
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    path.write_bytes(head + b"".join(strips) + struct.pack(order + "H", len(tags)) + body + struct.pack(order + "I", 0) + extra)


def lzw(data):
    """An encoder to hold the decoder against."""
    bits, out = 9, []
    table = {bytes([i]): i for i in range(256)}
    stream = [(256, 9)]
    w = b""
    for ch in data:
        wc = w + bytes([ch])
        if wc in table:
            w = wc
            continue
        stream.append((table[w], bits))
        table[wc] = len(table) + 2
        if len(table) + 2 == 4094:
            stream.append((256, bits))
            table, bits = {bytes([i]): i for i in range(256)}, 9
        else:
            n = len(table) + 2
            bits = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        w = bytes([ch])
    if w:
        stream.append((table[w], bits))
    n = len(table) + 3
    stream.append((257, 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12))
    text = "".join(format(v, f"0{b}b") for v, b in stream)
    text += "0" * (-len(text) % 8)
    out = bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))
    return out


def packbits(data):
    return b"".join(bytes([len(data[k : k + 100]) - 1]) + data[k : k + 100] for k in range(0, len(data), 100))


def scene(t):
    rows, cols = t.grid
    return np.stack([np.vstack([np.hstack([t.read_block(b, r, c) for c in range(cols)]) for r in range(rows)]) for b in range(1, t.count + 1)])


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("planar", [1, 2])
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("dtype", ["u1", "i2", "f4"])
def test_tiff_reading(tmp_path, order, planar, compression, dtype):
    cube = (np.random.default_rng(1).integers(0, 90, (3, 23, 17)) // 7).astype(dtype)
    plain_tiff(tmp_path / "a.tif", cube, order, planar, compression, predictor=2 if dtype == "i2" else 1)
    t = tiff.open_tiff(str(tmp_path / "a.tif"))
    assert (scene(t) == cube).all()
    assert t.transform == T and t.crs == "EPSG:32616" and t.nodata == 7.0


def test_lzw_over_a_full_table():
    data = np.random.default_rng(0).integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    assert tiff._lzw(lzw(data)) == data


def test_tiff_writing_and_refusals(tmp_path):
    a = np.random.default_rng(0).integers(0, 5, (70, 45)).astype("u1")
    blocks = [(r, c, a[r * 32 : r * 32 + 32, c * 32 : c * 32 + 32]) for r in range(3) for c in range(2) if (r, c) != (1, 1)]
    tiff.write_tiff(str(tmp_path / "b.tif"), iter(blocks), 45, 70, tile=32, transform=T, crs="EPSG:26911", nodata=255)
    t = tiff.open_tiff(str(tmp_path / "b.tif"))
    want = a.copy()
    want[32:64, 32:] = 0
    assert (scene(t)[0] == want).all() and t.transform == T and t.crs == "EPSG:26911" and t.nodata == 255
    (tmp_path / "c.tif").write_bytes(b"not a tiff at all")
    with pytest.raises(ValueError):
        tiff.open_tiff(str(tmp_path / "c.tif"))
    with pytest.raises(ValueError):
        tiff._unpack(b"", 7, 1)


def test_geotiff_source(spark, tmp_path):
    cube = np.random.default_rng(2).integers(1, 9, (3, 40, 30)).astype("u1")
    plain_tiff(tmp_path / "a.tif", cube, rows_per_strip=8)
    tiles = geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), [3, 1])
    got = {(r["y"], r["x"]): r["bands"] for r in geotiff.cube_of(tiles, (8, 30), 2).collect()}
    assert len(got) == 1200 and all(v == [cube[2, y, x], cube[0, y, x]] for (y, x), v in got.items())
    assert tiles.where("cell_row = 2").count() == 2 and tiles.where("cell_row > 3").count() == 2
    assert {r["cell_row"] for r in geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), None, (1001, 1991, 1009, 1995)).collect()} == {1, 2}
    with pytest.raises(Exception, match="no bands"):
        geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), [4]).count()


def test_pipeline_on_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    cube = rng.integers(1, 200, (2, 50, 60)).astype("u1")
    cube[:, 20:40, 10:30] = 7  # nodata by the file's tag
    plain_tiff(tmp_path / "img.tif", cube)
    model = LinearSoftmax(((0.02, -0.02), (-0.02, 0.02)), (0.0, 0.1), centred=True)
    s = SceneSegmenter(spark, model, Settings(work_dir=str(tmp_path), patch_size=16, vec=True, yolo=True, coco=True))
    name = s(str(tmp_path / "img.tif"))
    assert name.startswith("img_mask_") and name.endswith(".tif")
    t = tiff.open_tiff(str(tmp_path / name))
    mask = scene(t)[0]
    from test_segment import brute

    want = brute(cube.astype(float), model, 8, skip=7.0)
    want[(cube == 7).any(axis=0)] = 255
    assert (mask == want).all() and t.transform == T and t.crs == "EPSG:32616" and t.nodata == 255
    uid = name[len("img_mask_") : -4]
    back = geojson.read_geojson(spark, str(tmp_path / f"img_polygons_{uid}.geojson"))
    doc = json.loads((tmp_path / f"img_coco_{uid}.json").read_text())
    assert back.count() == len(doc["annotations"]) > 0 and 255.0 in {r["value"] for r in back.collect()}
    assert doc["images"] == [{"id": 1, "file_name": "img.tif", "width": 60, "height": 50}]
    assert len((tmp_path / f"img_yolo_{uid}.csv").read_text().splitlines()) == len(doc["annotations"])
    part = open_scene(spark, str(tmp_path / "img.tif"), "2", "1005.2,1980.1,1020.9,1995.4")
    assert (part.width, part.height, part.count) == (31, 30, 1) and part.transform[2] == 1005.2 and part.transform[5] == 1995.4
    assert part.cube.where("y = 0 and x = 0").first()["bands"] == [cube[1, 9, 10]]


def test_zarr_and_stac_scenes(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(2, 20, 18)).astype("<f4")
    root = tmp_path / "cube.zarr"
    root.mkdir()
    (root / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 20, 18], "chunks": [1, 8, 8], "dtype": "<f4", "compressor": {"id": "zlib", "level": 1}, "fill_value": 3, "order": "C", "filters": None}))
    for b in range(2):
        for r in range(3):
            for c in range(3):
                full = np.zeros((1, 8, 8), "<f4")
                part = a[b, r * 8 : r * 8 + 8, c * 8 : c * 8 + 8]
                full[0, : part.shape[0], : part.shape[1]] = part
                if (b, r, c) != (1, 2, 2):
                    (root / f"{b}.{r}.{c}").write_bytes(zlib.compress(full.tobytes()))
    (tmp_path / "cube.json").write_text(json.dumps({"transform": "| 0.5, 0.0, 1000.0|\n| 0.0,-0.5, 2000.0|\n| 0.0, 0.0, 1.0|", "crs": "EPSG:4326"}))
    s = open_scene(spark, str(root), [2, 1])
    got = {(r["y"], r["x"]): r["bands"] for r in s.cube.collect()}
    want = a.copy()
    want[1, 16:, 16:] = 3
    assert s.transform == T and len(got) == 360 and all(np.allclose(v, [want[1, y, x], want[0, y, x]]) for (y, x), v in got.items())
    assert zarrcube.read_metadata(str(tmp_path / "none.json")) is None
    assert zarrcube.read_metadata(str(tmp_path / "cube.json"))["BIGTIFF"] == "Unknown"
    masked = SceneSegmenter(spark, Constant(1, 2), Settings(work_dir=str(tmp_path), patch_size=8))(str(root))
    assert scene(tiff.open_tiff(str(tmp_path / masked))).shape == (1, 20, 18)

    bands = np.random.default_rng(4).integers(1, 9, (2, 12, 12)).astype("u1")
    for k, n in enumerate(("r", "b")):
        plain_tiff(tmp_path / f"{n}.tif", bands[k : k + 1])
    item = {"id": "i", "assets": {"R": {"href": "r.tif", "eo:bands": [{"common_name": "Red"}]}, "B": {"href": "b.tif", "eo:bands": [{"common_name": "blue"}]}, "X": {"href": "x.tif", "eo:bands": [{"common_name": "red"}, {"common_name": "blue"}]}, "thumb": {"href": "t.png"}}}
    (tmp_path / "item.json").write_text(json.dumps(item, indent=1))
    s = open_scene(spark, str(tmp_path / "item.json"), ["blue", "red"])
    got = {(r["y"], r["x"]): r["bands"] for r in s.cube.collect()}
    assert all(v == [bands[1, y, x], bands[0, y, x]] for (y, x), v in got.items()) and s.name == "item.json"
    found = stac.assets(stac.items(spark, str(tmp_path / "item.json")))
    for names, error in ((["violet"], ValueError), ([], ValueError), (["nir"], KeyError)):
        with pytest.raises(error):
            stac.checked_bands(found, names)


def test_manifests(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("a.tif,a.gpkg,val\n/abs/b.tif,,trn\nhttp://x/c.tif,c.gpkg,trn\n")
    got = [tuple(r) for r in manifest.read_manifest(spark, str(p)).collect()]
    assert got == [("/abs/b.tif", None, "trn", None), ("http://x/c.tif", f"{tmp_path}/c.gpkg", "trn", None), (f"{tmp_path}/a.tif", f"{tmp_path}/a.gpkg", "val", None)]
    p.write_text("a.tif;b\n")
    with pytest.raises(TypeError):
        manifest.read_manifest(spark, str(p))
    p.write_text("a.tif,b\nc.tif\n")
    with pytest.raises(ValueError):
        manifest.read_manifest(spark, str(p))


def test_label_tables(spark, tmp_path):
    assert geojson.read_geojson(spark, str(tmp_path / "none.geojson")).count() == 0
    (tmp_path / "l.csv").write_text("a,b\n1,x\n")
    assert geojson.read_labels(spark, str(tmp_path / "l.csv")).first()["b"] == "x"
    assert geojson.read_labels(spark, spark.range(2)).count() == 2
    with pytest.raises(ValueError):
        geojson.read_labels(spark, 5)


def test_assets_and_files(tmp_path, monkeypatch):
    (tmp_path / "a.TIF").write_bytes(b"")
    assert paths.checked_asset(tmp_path / "a.TIF") and paths.checked_asset("https://h/a.tif?x=1")
    for asset, word in (("https://h/a.png", "URL"), (str(tmp_path / "b.tif"), "file"), (5, "type")):
        with pytest.raises(ValueError, match=f"Invalid image_asset {word}"):
            paths.checked_asset(asset)
    inner = tmp_path / "x.txt"
    inner.write_text("hello")
    archive = tmp_path / "t.tar.gz"
    with tarfile.open(archive, "w:gz") as tar:
        tar.add(inner, "deep/../../x2.txt")
    out = tmp_path / "out"
    out.mkdir()
    assert files.extract_tar(archive, out) == ["x2.txt"] and (out / "x2.txt").read_text() == "hello" and not archive.exists()
    archive.write_bytes(b"broken")
    assert files.extract_tar(archive, out) == [] and archive.exists()
    assert files.model_file(str(inner), tmp_path) == str(inner)
    with pytest.raises(ValueError, match="Invalid model path"):
        files.model_file("nowhere.pt", tmp_path)
    assert not files.download("http://127.0.0.1:9/none", tmp_path / "n")


def test_settings(tmp_path):
    p = tmp_path / "s.yaml"
    p.write_text("arguments:\n  image: a.tif\n  bbox: None\n  bands_requested: '1,2,3'\n  vec: True\n  transformers: 'False'\n  patch_size: 512\n  prediction_thr: 0.4\n  work_dir: None\n")
    s = from_yaml(str(p))
    assert (s.image, s.bbox, s.bands, s.vec, s.tta, s.patch_size, s.threshold, s.work_dir) == ("a.tif", None, [1, 2, 3], True, "identity", 512, 0.4, None)
    assert from_command_line(["-a", str(p)]) == s
    s = from_command_line(["-i", "x.tif", "-br", "red,blue", "-bb", "1,2,3,4", "-y", "False", "-c", "-tr", "True", "-tf", "True", "-tt", "True"])
    assert s.band_names == ["red", "blue"] and s.bbox == (1, 2, 3, 4) and not s.yolo and s.coco and s.tta == "d4"
    with pytest.raises(SystemExit):
        from_command_line([])
    assert augmentation(True, False, False) == "identity" and augmentation(True, ["False"], "True") == "rotate" and not truth("no")
    assert requested_bands("[3, 1]") == [3, 1] and parse_bbox("None") is None
    for bad in (lambda: requested_bands(4), lambda: parse_bbox("1,2"), lambda: window_of((0, 0, 5, 5), T, 4, 4), lambda: Settings(patch_size=7)):
        with pytest.raises(ValueError):
            bad()


def test_command_line_needs_a_model(spark, tmp_path):
    with pytest.raises(ValueError):
        cli.main(["-i", str(tmp_path / "a.tif"), "-wd", str(tmp_path)])


def test_inbox(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    for n in ("a.tif", "b.TIFF", "c.txt"):
        (box / n).write_bytes(b"x")
    for _ in range(2):
        q = inbox.start(spark, str(box), lambda p: p.rsplit("/", 1)[1] + ".mask", str(tmp_path / "ck"), str(tmp_path / "res"))
        q.awaitTermination()
    assert sorted(r["mask"] for r in spark.read.parquet(str(tmp_path / "res")).collect()) == ["a.tif.mask", "b.TIFF.mask"]
    assert inbox.counts_by_window(inbox.arrivals(spark, str(box))).isStreaming
    assert F is not None
