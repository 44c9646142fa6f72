"""Runs, components, rings and geometry."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.functions.affine import affine, coefficients, move_rings
from rasterloom.operators import annotate, overlap, vectorize
from rasterloom.operators.infer import Constant
from rasterloom.operators.number import numbered_rows
from rasterloom.plans.segment import cells_of, segment_tiles, tile_pixels
from rasterloom.queries import QUERIES
from test_oracles import SF
from test_segment import cube_rows


def mask_rows(spark, m):
    return spark.createDataFrame([("m", y, x, int(m[y, x])) for y in range(m.shape[0]) for x in range(m.shape[1])], "raster_id string, y int, x int, cls short")


def flood(m):
    """Component of each foreground pixel, named by its first pixel."""
    label = {}
    for y, x in zip(*np.nonzero(m), strict=True):
        if (y, x) in label:
            continue
        stack = [(y, x)]
        while stack:
            p = stack.pop()
            if p in label:
                continue
            label[p] = (y, x)
            for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
                if 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and m[q] == m[p] and q not in label:
                    stack.append(q)
    return label


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_flood_fill(spark, seed):
    m = np.random.default_rng(seed).integers(0, 3, (23, 17))
    m[seed, :] = 255
    label = flood(m)
    runs = vectorize.mask_runs(mask_rows(spark, m)).cache()
    for strip in (4096, 5, 1):
        found = {}
        for r in vectorize.mask_components(runs, strip).collect():
            for x in range(r["x0"], r["x1"] + 1):
                found[(r["y"], x)] = (r["component"] >> 32, r["component"] & 0xFFFFFFFF)
        assert found == label
    areas = {(r["component"] >> 32, r["component"] & 0xFFFFFFFF): r["pixels"] for r in vectorize.component_stats(vectorize.mask_components(runs)).collect()}
    assert areas == {k: list(label.values()).count(k) for k in set(label.values())}
    assert vectorize.mask_runs(mask_rows(spark, m), include_nodata=False).where("cls = 255").isEmpty()


@pytest.mark.parametrize("seed", range(30))
def test_rings_are_simple_and_have_the_pixels_area(seed):
    m = np.random.default_rng(seed).integers(0, 2, (9, 9)) if seed else np.array([[1, 1, 1], [1, 0, 1], [1, 1, 0]])
    parts = {}
    for (y, x), name in flood(m).items():
        parts.setdefault(name, []).append((int(y), int(x), int(x)))
    for pixels in parts.values():
        merged = {}
        for y, x, _ in sorted(pixels):
            row = merged.setdefault(y, [])
            if row and row[-1][1] == x - 1:
                row[-1][1] = x
            else:
                row.append([x, x])
        rings = vectorize.trace([(y, a, b) for y, row in merged.items() for a, b in row])
        areas = [shoelace(r) for r in rings]
        assert areas[0] > 0 and all(a < 0 for a in areas[1:])
        assert sum(areas) == len(pixels)
        for ring in rings:
            assert ring[0] == ring[-1] and len(set(ring[:-1])) == len(ring) - 1


def test_components_read_their_runs_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("short")
    def seen(cls):
        read.add(1)
        return cls

    m = np.random.default_rng(4).integers(1, 4, (20, 9))
    runs = vectorize.mask_runs(mask_rows(spark, m))
    n = runs.count()
    assert vectorize.mask_components(runs.withColumn("cls", seen("cls")), strip=5).count() == n and read.value == n


def test_runs_in_many_batches_are_traced_like_one(spark):
    m = np.random.default_rng(5).integers(0, 3, (40, 12))
    m[:, 0] = m[20, :] = 1  # a component longer than several batches
    labelled = vectorize.mask_components(vectorize.mask_runs(mask_rows(spark, m)))
    runs = {}
    for r in sorted(labelled.collect(), key=lambda r: r["run_id"]):
        runs.setdefault(r["component"], []).append((r["y"], r["x0"], r["x1"]))
    want = {k: (float(m[some[0][:2]]), vectorize.trace(some)) for k, some in runs.items()}
    assert len(runs[0]) > 40 and sum(len(x) == 1 for x in runs.values()) > 9
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = vectorize.mask_polygons(labelled).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(want) and {r["component"]: (r["value"], [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]) for r in got} == want


def test_polygons_of_many_components(spark):
    m = np.random.default_rng(9).integers(0, 4, (30, 30))
    labelled = vectorize.mask_components(vectorize.mask_runs(mask_rows(spark, m)))
    stats = vectorize.component_stats(labelled)
    kept = vectorize.large_enough(stats, (2.0, 0, 5, 0, -2.0, 7), 12)
    got = vectorize.mask_polygons(labelled, kept, (2.0, 0, 5, 0, -2.0, 7)).select("component", G.area(F.col("rings")).alias("a")).collect()
    want = {r["component"]: r["pixels"] * 4.0 for r in stats.collect() if r["pixels"] * 4 >= 12}
    assert {r["component"]: r["a"] for r in got} == want and want


def test_simplify():
    line = [(0.0, 0.0), (1.0, 0.1), (2.0, 0.0), (2.0, 2.0), (1.0, 2.05), (0.0, 2.0), (0.0, 0.0)]
    assert vectorize.simplify_ring(line, 0.5) == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    assert vectorize.simplify_ring(line[:4], 5.0) == line[:4]


def test_simplify_polygons_with_holes(spark):
    m = np.zeros((14, 14), int)
    m[:12, :12] = 1
    m[2:5, 2:5] = 0  # a hole of four corners
    m[7:11, 7:9] = m[9:11, 9:11] = 0  # and one of six
    m[13, 13] = 2
    polygons = vectorize.mask_polygons(vectorize.mask_components(vectorize.mask_runs(mask_rows(spark, m))))
    given = {r["component"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in polygons.collect()}
    assert [len(ring) for ring in given[0]] == [5, 5, 7]
    for tolerance in (0.5, 3.0):
        got = {r["component"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in vectorize.simplify(polygons, tolerance).collect()}
        assert got == {k: [vectorize.simplify_ring(ring, tolerance) for ring in rings] for k, rings in given.items()}
    none = spark.createDataFrame([(None,), ([],)], f"rings {vectorize.RINGS}")
    assert [r["rings"] for r in vectorize.simplify(none).collect()] == [None, []]


def test_sample_scene_record(spark):
    """413 x 426 pixels of one class with patches of 512: the first column has no weight."""
    x = np.ones((1, 426, 413))
    tiles = segment_tiles(cells_of(cube_rows(spark, x), 256, 1), Constant(4), 256, 1)
    labelled = vectorize.mask_components(vectorize.mask_runs(tile_pixels(tiles, 256)))
    polygons = vectorize.numbered(vectorize.mask_polygons(labelled))
    note = annotate.annotations(annotate.with_category(polygons, "value")).first()
    assert note["area"] == 175512.0 and list(note["bbox"]) == [1.0, 0.0, 412.0, 426.0] and note["category_id"] == 1
    yolo = annotate.yolo_rows(polygons, 413, 426).first()
    assert yolo["x"] == pytest.approx(0.5012106537530266) and yolo["w"] == pytest.approx(0.9975786924939467)


def test_affine_lists():
    assert coefficients([1, 2, 3, 4, 5, 6, 0, 0, 1]) == coefficients([1, 2, 3, 4, 5, 6])
    with pytest.raises(ValueError):
        coefficients(None)
    with pytest.raises(ValueError):
        coefficients([1, 2])


def test_moved_wkt_rounds_half_to_even(spark):
    rng = np.random.default_rng(6)
    points = np.round(rng.uniform(0, 650, (150, 5, 2)), 2)
    points[:40] = np.round(points[:40])  # halves after the move by half a unit
    wkt = ["POLYGON ((" + ", ".join(f"{x} {y}" for x, y in (*p, p[0])) + "))" for p in points]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(wkt)], "k int, w string")
    moved = df.select("k", move_rings(G.parse_wkt(F.col("w")), affine((0.5, 0.0, 733601.0, 0.0, -0.5, 3725139.0)), precision=0).alias("r"))
    for r in moved.collect():
        p = points[r["k"]]
        want = np.round(np.stack([0.5 * p[:, 0] + 733601, -0.5 * p[:, 1] + 3725139], axis=1))
        assert [[v["x"], v["y"]] for v in r["r"][0]] == [*want.tolist(), want[0].tolist()]


def test_geometry_columns(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 10 0, 10 10, 5 5, 0 10, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",), ("POINT (3 4)",), ("LINESTRING (0 0, 1 1)",), (None,), ("polygon((-4 -4, 4 -4, 4 4, -4 4, -4 -4))",)], "w string")
    r = df.select("w", G.parse_wkt(F.col("w")).alias("rings")).select("*", G.area(F.col("rings")).alias("a"), G.bounds(F.col("rings")).alias("b"), G.area_inside(F.col("rings"), F.lit(5.0), F.lit(4.0)).alias("i")).collect()
    assert [x["a"] for x in r] == [74.0, 0.0, None, None, 64.0]
    assert tuple(r[0]["b"]) == (0.0, 0.0, 10.0, 10.0) and tuple(r[1]["b"]) == (3.0, 4.0, 3.0, 4.0)
    assert r[0]["i"] == pytest.approx(19.0) and r[4]["i"] == pytest.approx(16.0)
    back = df.limit(1).select(G.to_wkt(G.parse_wkt(F.col("w"))).alias("w")).select(G.area(G.parse_wkt(F.col("w"))).alias("a")).first()
    assert back["a"] == 74.0


def test_overlap_with_and_without_buckets(spark):
    rng = np.random.default_rng(2)
    def boxes(n, key):
        p, q = rng.uniform(-50, 50, (n, 2)), rng.uniform(0, 30, (n, 2))
        return spark.createDataFrame([(k, *map(float, p[k]), *map(float, p[k] + q[k])) for k in range(n)], f"{key} int, minx double, miny double, maxx double, maxy double")
    a, b = boxes(60, "a"), boxes(40, "b")
    pairs = lambda bucket: sorted((r["a"], r["b"]) for r in overlap.bbox_overlap(a, b, bucket).select("a", "b").collect())
    assert pairs(None) == pairs(7.0) == pairs(100.0) and pairs(None)
    with pytest.raises(ValueError):
        overlap.overlapping_subset(a, None)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["annotation_ids", "coco_annotations", "coco_scores"])
def test_rows_of_a_category_stay_spread(spark, monkeypatch, name):
    """No shuffle by category name before the numbering, which would send half of the rows to one task."""
    given = []
    monkeypatch.setattr(annotate, "numbered_rows", lambda df, *rest: given.append(df) or numbered_rows(df, *rest))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES[name](spark, SF)
        plan = given[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_many_categories_are_joined_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "cab"[k % 3]) for k in range(1, 40)] + [(40, None)], "feature_id long, status string")
    few = annotate.with_category(rows, "status").collect()
    monkeypatch.setattr(annotate, "MOST_NAMES", 2)
    assert sorted(annotate.with_category(rows, "status").collect(), key=str) == sorted(few, key=str)
    assert {(r["category_name"], r["category_id"]) for r in few} == {("a", 1), ("b", 2), ("c", 3), (None, None)}


def test_many_categories_are_numbered_in_many_tasks(spark, monkeypatch):
    """Names beyond MOST_NAMES meet in no single task; nulls and ties of the order are numbered as before, and ids are the same."""
    rows = spark.createDataFrame([(None if k % 50 == 7 else k // 2, f"n{k * 37 % 101}" if k % 9 else None) for k in range(500)], "feature_id long, status string")
    few = annotate.category_ids(rows, "status", "feature_id")
    monkeypatch.setattr(annotate, "MOST_NAMES", 2)
    many = annotate.category_ids(rows, "status", "feature_id")
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert many.schema["category_id"].dataType == few.schema["category_id"].dataType
    assert many.select(F.spark_partition_id()).distinct().count() > 1
    got = sorted((r["category_id"], r["name"]) for r in many.collect())
    assert got == sorted((r["category_id"], r["name"]) for r in few.collect())
    assert [k for k, _ in got] == list(range(1, len(got) + 1)) and len({n for _, n in got}) == len(got) == 102


def test_document_is_made_of_pieces(spark, tmp_path):
    rows = spark.createDataFrame([(k, "cab"[k % 3]) for k in range(1, 40)], "feature_id long, status string").withColumn("rings", G.box(F.col("feature_id"), F.lit(0), F.col("feature_id") + 2, F.lit(3)))
    images = spark.createDataFrame([(2, 'two".tif', 7, 8), (1, "one.tif", 5, 6)], "image_id int, file_name string, width int, height int")
    lics = annotate.licenses(spark, {"free": "http://free"})
    for n in (39, 1, 0):
        some = annotate.with_category(rows.where(F.col("feature_id") <= n).repartition(5), "status")
        notes, cats, imgs = annotate.annotations(some, start=9), annotate.categories(some), annotate.images(images)
        pieces = annotate.coco_document(notes, cats, imgs, lics, {"year": "2024"})
        assert pieces.count() == n + 2 and pieces.where("part = 1").count() == n
        annotate.write_document(pieces, str(tmp_path / f"{n}.json"))
        got = json.loads((tmp_path / f"{n}.json").read_text())
        assert list(got) == ["annotations", "categories", "images", "licenses", "info"]
        assert got["annotations"] == [json.loads(x["j"]) for x in notes.orderBy("id").select(F.to_json(F.struct("*")).alias("j")).collect()]
        assert [a["id"] for a in got["annotations"]] == list(range(9, 9 + n)) and all(a["area"] == 6.0 for a in got["annotations"])
        assert [(c["id"], c["name"]) for c in got["categories"]] == [(k + 1, c) for k, c in enumerate("abc"[: min(n, 3)])]
        assert [i["file_name"] for i in got["images"]] == ["one.tif", 'two".tif']
        assert got["licenses"] == [{"id": 1, "name": "free", "url": "http://free"}] and got["info"] == {"year": "2024"}


def test_presets(spark):
    with pytest.raises(ValueError):
        annotate.with_category(spark.range(1), None, preset=[{"id": 1, "name": "x"}])
    preset = [{"id": 4, "name": "a"}, {"id": 9, "name": "a"}]
    assert annotate.preset_ids(preset) == {"a": 9, "other": 10} and preset[-1] == {"id": 9, "name": "a"}
