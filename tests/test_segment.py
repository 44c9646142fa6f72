"""Overlapped inference against a brute-force version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import grid, infer, nodata, window
from rasterloom.operators.infer import Augmented, Constant, LinearSoftmax
from rasterloom.plans.segment import cells_of, segment_relational, segment_tiles, tile_pixels

MODEL = LinearSoftmax(((1.0, -0.5), (-0.7, 0.9), (0.2, 0.3)), (0.1, 0.0, -0.1), centred=True)


def cube_rows(spark, x, raster="r"):
    _, h, w = x.shape
    rows = [(raster, h, w, i, j, [float(v) for v in x[:, i, j]]) for i in range(h) for j in range(w)]
    return spark.createDataFrame(rows, "raster_id string, height int, width int, y int, x int, bands array<double>")


def nine_windows(i, j, n1, n2, s):
    """The window's cases written out one by one."""
    p = 2 * s
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(p) / p)
    lo, hi = np.where(np.arange(p) < s, 1.0, w), np.where(np.arange(p) < s, w, 1.0)
    if j >= n2 - 2 and i == 0:
        return np.outer(lo, hi)
    if j >= n2 - 2 and 0 < i < n1 - 2:
        return np.outer(w, hi)
    if j >= n2 - 2 and i >= n1 - 2:
        return np.outer(hi, hi)
    if i >= n1 - 2 and 0 < j < n2 - 2:
        return np.outer(hi, w)
    if i >= n1 - 2 and j == 0:
        return np.outer(hi, lo)
    if i == 0 and j == 0:
        return np.outer(lo, lo)
    if j == 0 and 0 < i < n1:
        return np.outer(w, lo)
    if i == 0 and 0 < j < n2 - 2:
        return np.outer(lo, w)
    return np.outer(w, w)


def brute(x, model, s, skip="none", threshold=0.3):
    c, h, w = x.shape
    n1, n2 = -(-h // s), -(-w // s)
    pad = np.zeros((c, n1 * s, n2 * s))
    pad[:, :h, :w] = x
    total, weight = np.zeros((model.classes, n1 * s, n2 * s)), np.zeros((n1 * s, n2 * s))
    for i in range(n1 - 1):
        for j in range(n2 - 1):
            patch = pad[:, i * s : (i + 2) * s, j * s : (j + 2) * s]
            if skip != "none" and (patch == skip).all():
                continue
            wt = nine_windows(i, j, n1, n2, s)
            total[:, i * s : (i + 2) * s, j * s : (j + 2) * s] += model.predict(patch[None])[0] * wt
            weight[i * s : (i + 2) * s, j * s : (j + 2) * s] += wt
    p = np.divide(total, weight, out=np.zeros_like(total), where=weight != 0)
    cls = (p[0] > threshold).astype(int) if model.classes == 1 else p.argmax(axis=0)
    return cls[:h, :w]


def as_array(df, shape):
    out = np.full(shape, -1)
    for r in df.select("y", "x", "cls").collect():
        out[r["y"], r["x"]] = r["cls"]
    return out


@pytest.mark.parametrize("n1", range(2, 6))
@pytest.mark.parametrize("n2", range(2, 6))
def test_window_cases(n1, n2):
    s = 4
    for i in range(n1 - 1):
        for j in range(n2 - 1):
            assert np.allclose(window.weights(i, j, n1, n2, s), nine_windows(i, j, n1, n2, s))


def test_weights_sum_to_one_and_fixed_mode_has_no_hole():
    s = 4
    for n1, n2, mode in ((3, 3, "reference"), (5, 4, "reference"), (2, 2, "fixed"), (2, 4, "fixed"), (4, 2, "fixed")):
        total = np.zeros((n1 * s, n2 * s))
        for i in range(n1 - 1):
            for j in range(n2 - 1):
                total[i * s : (i + 2) * s, j * s : (j + 2) * s] += window.weights(i, j, n1, n2, s, mode)
        assert np.allclose(total, 1.0), (n1, n2, mode)


@pytest.mark.parametrize("shape", [(13, 22), (8, 8), (7, 20), (4, 9), (3, 30), (16, 16)])
def test_both_plans_equal_brute_force(spark, shape):
    x = np.random.default_rng(sum(shape)).normal(size=(2, *shape))
    cube, want = cube_rows(spark, x), brute(x, MODEL, 4)
    assert (as_array(segment_relational(cube, MODEL, 4, 2), shape) == want).all()
    for macro in (1, 2, 8):
        tiles = segment_tiles(cells_of(cube, 4, 2), MODEL, 4, 2, macro=macro)
        assert (as_array(tile_pixels(tiles, 4), shape) == want).all()


def test_empty_patches_are_skipped_in_both_plans(spark):
    x = np.zeros((2, 24, 24))
    x[:, 16:, 16:] = np.random.default_rng(0).normal(size=(2, 8, 8))
    model = LinearSoftmax(((0.0, 0.0), (0.0, 0.0)), (0.0, 1.0))
    cube, want = cube_rows(spark, x), brute(x, model, 4, skip=0.0)
    assert 0 < want.sum() < want.size
    assert (as_array(segment_relational(cube, model, 4, 2, skip=0.0), (24, 24)) == want).all()
    assert (as_array(tile_pixels(segment_tiles(cells_of(cube, 4, 2), model, 4, 2, macro=2, skip=0.0), 4), (24, 24)) == want).all()


def test_other_models_and_binary_threshold(spark):
    x = np.random.default_rng(3).normal(size=(2, 12, 12))
    cube = cube_rows(spark, x)
    assert (as_array(segment_relational(cube, Constant(2, 4), 4, 2), (12, 12)) == brute(x, Constant(2, 4), 4)).all()
    one = LinearSoftmax(((1.0, 0.0),), (0.0,))
    assert (as_array(segment_relational(cube, one, 4, 2, threshold=0.5), (12, 12)) == brute(x, one, 4, threshold=0.5)).all()


@pytest.mark.parametrize("kind", ["d4", "rotate", "flip"])
def test_augmentation(spark, kind):
    x = np.random.default_rng(1).normal(size=(3, 2, 8, 8))
    assert np.allclose(Augmented(MODEL, kind).predict(x), MODEL.predict(x))  # the model doesn't care for direction

    class Slanted:
        classes = 1

        def predict(self, p):
            return p[:, :1] * np.arange(1, 65).reshape(8, 8)

    cube = cube_rows(spark, x[0, :, :8, :8])
    patches = grid.overlap_patches(grid.pad_grid(cube, 4, 2), 4)
    scored = infer.augment(patches, 4, kind).withColumn("p", F.col("bands")[0] * (F.col("ty") * 8 + F.col("tx") + 1))
    got = np.zeros((8, 8))
    for r in infer.merge_variants(scored).collect():
        got[r["py"], r["px"]] = r["p"]
    assert np.allclose(got, Augmented(Slanted(), kind).predict(x[:1])[0, 0])


def test_valid_masks(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0])], "k int, bands array<double>")

    def bad(**options):
        return [r["k"] for r in df.where(~nodata.valid(F.col("bands"), **options)).orderBy("k").collect()]

    assert bad() == [2] and bad(is_float=True) == [3, 4] and bad(declared=1.0) == [1, 2, 3, 4]
    assert bad(declared=nan) == [] and bad(declared=nan, nan_masks=True) == [3]
