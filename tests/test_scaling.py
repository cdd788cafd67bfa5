"""Queries that failed on large inputs: how they are planned, and their results against plain numpy."""

import re

import numpy as np
import pytest

KEY = ["image_id", "y", "x"]
DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _frame(spark, a, gaps=()):
    rows = [("a", y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1]) if (y, x) not in gaps]
    return spark.createDataFrame(rows, "image_id string, y long, x long, v double").repartition(3)


def _array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_steps_of_one_halo_leave_missing_pixels_out(spark, tile):
    from tessera.operators import tiles

    a, gaps = np.random.default_rng(3).integers(0, 50, (19, 11)).astype(float), {(0, 0), (7, 4), (7, 5), (18, 10)}
    gaps -= {(18, 10)}
    r = _frame(spark, a, gaps)
    steps = tiles.eroded(tiles.dilated(r, "disk", 2), "disk", 2)
    np.testing.assert_array_equal(_array(tiles.closed(r, "disk", 2, tile), a.shape), _array(steps, a.shape))
    assert _plan(tiles.closed(r, "disk", 2, tile)).count("FlatMapGroups") == 1


def test_parts_closed_in_one_pass_without_pixels_in_joins(spark):
    from __spark_entry__ import queries

    plan = _plan(queries()["parts_close_disk"](spark, DATA))
    assert plan.count("FlatMapGroups") == 1
    assert not re.search(r"Join \[y#\d+L, x#\d+L\]", plan)


def test_parts_derivative_without_a_column_in_a_task(spark):
    from __spark_entry__ import queries

    assert "Window" not in _plan(queries()["parts_derivative7_x"](spark, DATA))


def test_lines_against_windows(spark):
    from tessera.operators import raster, tiles

    a = np.random.default_rng(5).normal(size=(23, 9))
    r = _frame(spark, a)
    for along in ("x", "y", "xx", "yy", "xy"):
        np.testing.assert_allclose(_array(raster.derivative(r, along, tiles.extents(r)), a.shape), _array(raster.derivative(r, along), a.shape), rtol=0, atol=1e-12)


def test_distances_read_no_column_anew_for_every_pixel(spark):
    from tessera.operators import regions

    rng = np.random.default_rng(9)
    mask, target = rng.random((70, 13)) < 0.5, rng.random((70, 13)) < 0.03
    on = lambda m: spark.createDataFrame([("a", int(y), int(x)) for y, x in zip(*np.nonzero(m), strict=True)], "image_id string, y long, x long")
    df = regions.distance_to(on(mask), on(target))
    assert "unboundedfollowing" not in _plan(df)
    got, (ty, tx) = {(r.y, r.x): r.distance for r in df.collect()}, np.nonzero(target)
    assert set(got) == {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}
    for (y, x), d in got.items():
        assert d == pytest.approx(np.sqrt(((ty - y) ** 2 + (tx - x) ** 2).min()))


@pytest.mark.parametrize("eight", [True, False])
def test_labels_of_a_noisy_column_take_work_by_its_runs(eight):
    import time

    from tessera.operators import regions

    m = np.zeros((30_000, 3), bool)
    m[::2], m[1::4, 1] = True, True
    began = time.time()
    got = regions.label_grid(m, eight)
    assert time.time() - began < 5
    assert len(np.unique(got)) - 1 == 7_500


def test_superpixels_by_tiles_are_those_of_all_centres(spark):
    from tessera.functions import kernels

    rng, step, weight = np.random.default_rng(11), 8, 0.5
    y, x = np.nonzero(np.ones((90, 21)))
    colour = rng.integers(0, 40, (len(y), 3)) / 4  # far apart beside their places: the first margin is too small
    p = np.column_stack([colour, weight * y / step, weight * x / step])
    label = np.unique(y // step * 10_000 + x // step, return_inverse=True)[1]
    for _ in range(3):
        n = np.bincount(label)
        c = np.column_stack([np.bincount(label, p[:, k]) / n for k in range(5)])
        label = np.unique(((c[None] - p[:, None]) ** 2).sum(axis=2).argmin(axis=1), return_inverse=True)[1]
    rows = [("a", int(a), int(b), *map(float, k)) for a, b, k in zip(y, x, colour, strict=True)]
    df = spark.createDataFrame(rows, "image_id string, y long, x long, r double, g double, b double")
    got = {(r.y, r.x): r.label for r in kernels.superpixels(df, step, 3, weight, tile=32, margin=4).collect()}
    assert got == {(int(a), int(b)): int(k) for a, b, k in zip(y, x, label, strict=True)}
