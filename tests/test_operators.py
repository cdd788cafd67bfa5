"""Operators against plain numpy, hand-computed values, and on two images at once."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

KEY = ["image_id", "y", "x"]


def _frame(spark, **images):
    rows = [(n, y, x, float(a[y, x])) for n, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id string, y long, x long, v double").repartition(3)


def _arrays(df, **shapes):
    out = {n: np.full(s, np.nan) for n, s in shapes.items()}
    for r in df.select(*KEY, "v").collect():
        out[r.image_id][r.y, r.x] = r.v
    return out


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(6)
    return {"a": rng.integers(0, 9, (23, 37)).astype(float), "b": rng.integers(3, 30, (11, 14)).astype(float)}


@pytest.fixture(scope="module")
def pair(spark, images):
    return _frame(spark, **images)


def _shapes(images):
    return {n: a.shape for n, a in images.items()}


def _windows(a, half, mode, **more):
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, half, mode=mode, **more), (2 * half + 1,) * 2)


@pytest.mark.parametrize("tile", [5, 8, 64])
def test_tiles_against_whole_images(pair, images, tile):
    from tessera.operators import tiles

    foot = tiles.footprint("octagon", 4)
    cases = {
        "ranked": (tiles.ranked(pair, 7, tiles.footprint("diamond", 2), "symmetric", tile), lambda a: np.sort(_windows(a, 2, "symmetric")[..., tiles.footprint("diamond", 2)], axis=-1)[..., 6]),
        "eroded": (tiles.eroded(pair, "octagon", 4, tile), lambda a: _windows(a, 4, "constant", constant_values=np.inf)[..., foot].min(axis=-1)),
        "deviation": (tiles.deviation(pair, 2, "symmetric", tile), lambda a: _windows(a, 2, "symmetric").std(axis=(-1, -2), ddof=1)),
        "correlated": (tiles.correlated(pair, [[0, 1, 2], [3, 4, 5], [6, 7, 8]], "replicate", tile), lambda a: (_windows(a, 1, "edge") * np.arange(9).reshape(3, 3)).sum(axis=(-1, -2))),
        "mean": (tiles.neighbour_mean(pair, tile), lambda a: np.nanmean(_windows(a, 1, "constant", constant_values=np.nan), axis=(-1, -2))),
    }
    for name, (found, want) in cases.items():
        got = _arrays(found, **_shapes(images))
        for n, a in images.items():
            assert np.allclose(got[n], want(a)), (name, n)


def test_entropy(pair, images):
    from tessera.operators import tiles

    got = _arrays(tiles.entropy(pair, 2, "symmetric", 8), **_shapes(images))
    for n, a in images.items():
        w = _windows(a, 2, "symmetric").reshape(*a.shape, -1)
        for y, x in ((0, 0), (5, 7), (10, 13)):
            p = np.unique(w[y, x], return_counts=True)[1] / 25
            assert got[n][y, x] == pytest.approx(-(p * np.log2(p)).sum())


@pytest.mark.parametrize("tile", [6, 256])
def test_grey_reconstruction_and_thinning_do_not_depend_on_tiles(pair, images, tile):
    from tessera.operators import regions

    both = pair.select(*KEY, (F.col("v") - 3).alias("v"), F.col("v").alias("m"))
    got = _arrays(regions.reconstruct_gray(both, tile), **_shapes(images))
    for n, a in images.items():
        assert np.array_equal(got[n], regions.grown_under(a - 3, a))
    kept = {(r.image_id, r.y, r.x) for r in regions.thinned(pair.filter("v % 3 != 0"), tile, steps=1 if tile == 6 else 8).collect()}
    for n, a in images.items():
        m = np.pad(a % 3 != 0, 1)
        while regions.thin_once(m):
            pass
        assert {(y, x) for k, y, x in kept if k == n} == {(int(y), int(x)) for y, x in np.argwhere(m[1:-1, 1:-1])}


def test_regional_maxima_are_whole_plateaus(spark):
    from tessera.operators import regions

    found = regions.regional_maxima(_frame(spark, a=np.array([[1.0, 1, 1, 2]]), b=np.array([[5.0, 5, 0, 5], [0, 0, 0, 5]])))
    assert {(r.image_id, r.y, r.x) for r in found.collect()} == {("a", 0, 3), ("b", 0, 0), ("b", 0, 1), ("b", 0, 3), ("b", 1, 3)}


def test_histograms_are_matched_image_by_image(spark):
    from tessera.operators import raster

    moving = _frame(spark, a=np.array([[0.0, 1, 2, 3]]), b=np.array([[0.0, 0, 0, 9]]))
    fixed = _frame(spark, a=np.array([[10.0, 20, 30, 40]]), b=np.array([[7.0, 7, 8, 8]]))
    got = _arrays(raster.match_histogram(moving, fixed), a=(1, 4), b=(1, 4))
    assert got["a"].tolist() == [[10, 20, 30, 40]] and got["b"].tolist() == [[8, 8, 8, 8]]


def test_quantiles_and_valley(pair, images):
    from tessera.operators import raster

    found = {r.image_id: tuple(r)[1:] for r in raster.quantiles(pair, [0.0, 0.25, 0.4, 0.9, 1.0], bins=4).collect()}
    for n, a in images.items():
        assert found[n] == pytest.approx(np.quantile(a, [0.0, 0.25, 0.4, 0.9, 1.0]))
    bins = raster.freedman_diaconis(pair).filter("image_id = 'b'").orderBy("bin").collect()
    width = 2 * (np.quantile(images["b"], 0.75) - np.quantile(images["b"], 0.25)) * images["b"].size ** (-1 / 3)
    assert bins[1].left - bins[0].left == pytest.approx(width) and sum(r.n for r in bins) == images["b"].size


def test_fractional_derivative_by_hand(spark):
    from tessera.operators import raster

    a = np.arange(1.0, 31).reshape(5, 6) ** 2
    got = _arrays(raster.fractional_derivative(_frame(spark, a=a, thin=np.ones((1, 4))), 0.6), a=(5, 6), thin=(1, 4))
    assert (got["thin"] == 0).all()
    w, d = [1.0, -0.6, 0.6 * -0.4 / 2], np.full((5, 6), 2.0)
    d[-1], d[:, -1] = 0, 0
    h, b = d.mean(), a * d**1.6
    for y, x, left, right in ((2, 3, (1, 2, 3), (3, 4, 5)), (1, 0, (0, 1), (0, 1, 2)), (1, 1, (0, 1, 2), (1, 2, 3)), (0, 5, (3, 4, 5), (5,)), (4, 2, (0, 1, 2), (2, 3, 4))):
        want = (sum(k * b[y, c] for k, c in zip(w, left, strict=False)) + sum(k * b[y, c] for k, c in zip(w, right, strict=False))) / 2 / h**1.6
        assert got["a"][y, x] == pytest.approx(want)


def test_kernels_and_resizing(spark, pair, images):
    from tessera.operators import raster

    values = spark.createDataFrame([(0.0,), (0.5,), (1.5,), (-1.5,), (2.5,)], "x double").select(raster.rational_kernel(F.col("x")).alias("w")).collect()
    hand = [1.0, (-0.042 - 0.45645 + 1.0808) / (0.25 - 0.41595 + 1.0808), (0.439425 - 0.8787 + 0.3905) / (2.25 - 3.6603 + 1.7676)]
    assert [r.w for r in values] == pytest.approx([*hand, hand[2], 0.0])
    flat = _arrays(raster.resized(_frame(spark, a=np.full((7, 9), 3.5)), 0.37, kernel="lanczos3"), a=(3, 4))["a"]
    assert np.allclose(flat, 3.5)
    same = _arrays(raster.resized(pair, 1.0), **_shapes(images))
    assert all(np.allclose(same[n], a) for n, a in images.items())
    half = _arrays(raster.resized(pair, size=(4, 6), kernel="linear"), a=(4, 6), b=(4, 6))
    assert not any(np.isnan(v).any() for v in half.values())


def test_turns_have_a_sign(spark):
    from tessera.operators import points

    square = [(0, 0), (1, 0), (1, 1), (0, 1)]

    def turned(degrees, k):
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        return [(k * (c * x - s * y), k * (s * x + c * y)) for x, y in square]

    names = [f"{q}{i}{c}" for q in "mf" for i in range(1, 5) for c in "xy"]
    rows = [(i, *[float(v) for p in (*square, *turned(a, 1.5)) for v in p]) for i, a in enumerate((30, -30, 0))]
    found = points.rotation_and_scale(spark.createDataFrame(rows, ["id", *names])).orderBy("id").collect()
    assert [r.theta for r in found] == pytest.approx([30, -30, 0]) and [r.scale for r in found] == pytest.approx([1.5] * 3)


def test_fill_check_rules(spark):
    from tessera.operators import enhance, regions

    def mask(a):
        return spark.createDataFrame([("a", int(y), int(x)) for y, x in np.argwhere(a)], "image_id string, y long, x long")

    def sound(a):
        extent = spark.createDataFrame([("a", y, x) for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id string, y long, x long")
        return enhance.fill_is_sound(mask(a), regions.fill_holes(mask(a), extent, *a.shape), a.size).first().sound

    ring = np.zeros((20, 20), bool)
    ring[4:16, 4:16] = True
    solid = ring.copy()
    ring[5:15, 5:15] = False
    assert sound(ring) and sound(solid)  # an edge that closes; a mask without holes
    small = np.zeros((20, 20), bool)
    small[2:6, 2:6] = True
    small[3:5, 3:5] = False
    assert not sound(small)  # 16 of 400 pixels
    frame = np.ones((20, 20), bool)
    frame[1:19, 1:19] = False
    assert not sound(frame)  # everything


def test_otsu_cuts_are_the_best_of_all():
    from tessera.functions.segment import otsu_cuts

    rng = np.random.default_rng(1)
    for cuts in (1, 2, 3):
        bins, counts = np.sort(rng.choice(60, 12, False)).astype(float), rng.integers(1, 40, 12).astype(float)

        def worth(edges):
            return sum((counts[i:j] * bins[i:j]).sum() ** 2 / counts[i:j].sum() for i, j in itertools.pairwise((0, *edges, 12)))

        assert worth(otsu_cuts(bins, counts, cuts)) == pytest.approx(max(worth(e) for e in itertools.combinations(range(1, 12), cuts)))
    assert len(otsu_cuts(np.arange(256.0), rng.integers(1, 99, 256).astype(float), 10)) == 10


def test_files_round_trip(spark, tmp_path):
    from tessera.operators import files
    from tessera.sources import tiff

    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 255, (13, 17, 3)).astype(np.uint8), rng.random((5, 4)).astype(np.float32)
    (tmp_path / "g_S1_st.tiff").write_bytes(tiff.encode([a]))
    (tmp_path / "g_S2_st.tif").write_bytes(tiff.encode([b, b + 1]))
    (tmp_path / "other.txt").write_text("x")
    heads = {(r.path.rsplit("/", 1)[1], r.page, r.height, r.width, r.samples, r.bits) for r in tiff.headers(spark, str(tmp_path)).collect()}
    assert heads == {("g_S1_st.tiff", 0, 13, 17, 3, 8), ("g_S2_st.tif", 0, 5, 4, 1, 32), ("g_S2_st.tif", 1, 5, 4, 1, 32)}
    pixels = tiff.read_images(spark, str(tmp_path))
    one = np.zeros(a.shape)
    for r in pixels.filter(pixels.image_id.endswith("S1_st.tiff")).collect():
        one[r.y, r.x, r.c] = r.v
    assert np.array_equal(one, a)
    again = tiff.encoded(pixels.filter(pixels.image_id.endswith("S2_st.tif")), "float32").first().content
    assert [s.shape for _, _, s in tiff.strips(bytes(again))] == [(5, 4, 1)] * 2
    listing = files.listed(spark, str(tmp_path))
    assert listing.count() == 2
    assert files.only_match(listing, "s1", "ST").first().path.endswith("g_S1_st.tiff")
    with pytest.raises(Exception, match="files that match"):
        files.only_match(listing, "g", "st").collect()
    assert files.by_base_name(listing, "g_S2_st").first().path.endswith(".tif")
    with pytest.raises(Exception, match="no file"):
        files.by_base_name(listing, "nothing").collect()
    m = spark.createDataFrame([(1.0, 2.5), (3.0, -4.0)], "a double, b double")
    tiff.write_matrix(m, str(tmp_path / "m.csv"))
    assert sorted(tuple(r) for r in tiff.read_matrix(spark, str(tmp_path / "m.csv")).collect()) == [(1.0, 2.5), (3.0, -4.0)]


def test_catalogue_rules(spark):
    from tessera.operators import files

    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    masks = paths("m/g_S1_st_m_v2.png", "m/g_S1_st_n_v2.png", "m/g_S1_st_o_v1.png")
    images = paths("i/g_S1_st_a_v1.tiff", "i/g_S9_st_a_v1.tiff")
    scores = spark.createDataFrame([("i/g_S1_st_a_v1.tiff", "m/g_S1_st_n_v2.png", 0.9), ("i/g_S1_st_a_v1.tiff", "m/g_S1_st_m_v2.png", 0.4)], "image_path string, mask_path string, dice double")
    assert dict(files.best_masks(images, masks, scores).collect()) == {"i/g_S1_st_a_v1.tiff": "m/g_S1_st_n_v2.png", "i/g_S9_st_a_v1.tiff": None}
    listing = paths("d/_7_A.tiff", "d/_7_A.png", "d/_7_B.tiff", "d/_7_B.png", "d/_8_A.png")
    assert tuple(files.four_files(listing, "7", "A", "B").first()) == ("d/_7_A.png", "d/_7_A.tiff", "d/_7_B.png", "d/_7_B.tiff")
    folders = spark.createDataFrame([("/a//b", "/a/b/"), ("/a", "/c")], "raw string, save string").select(files.save_folder(F.col("raw"), F.col("save")).alias("f")).collect()
    assert [r.f for r in folders] == ["/a/b/savedOutput/", "/c/"]
    assert files.sink_name("g_S1_st_", 1 / 3, "ForegroundSegmented", "_v2") == "g_S1_st_scale_0.3333_ForegroundSegmented_v2.tiff"
    with pytest.raises(Exception, match="four underscores"):
        files.checked_names(paths("a_b.tiff"), strict=True).collect()


def test_distances_against_all_pairs(spark):
    from tessera.operators import regions

    m = np.random.default_rng(3).random((19, 31)) < 0.85
    off = np.argwhere(~m)
    want = np.array([[0.0 if not m[y, x] else np.sqrt(((off - (y, x)) ** 2).sum(axis=1).min()) for x in range(31)] for y in range(19)])
    assert np.allclose(regions.distance_grid(m), want)
    assert np.isinf(regions.distance_grid(np.ones((3, 3), bool))).all()


def test_hulls_of_blocks_close_to_the_hull(spark):
    from tessera.operators import points

    rng = np.random.default_rng(5)
    rows = [(n, k, float(x), float(y)) for n in "ab" for k, (x, y) in enumerate(rng.normal(size=(400, 2)))]
    found = points.convex_hull(spark.createDataFrame(rows, "set string, seq long, px double, py double"), 16).orderBy("set", "seq").collect()
    for n in "ab":
        assert [(r.px, r.py) for r in found if r["set"] == n] == points.hull_of([(x, y) for s, _, x, y in rows if s == n])


def test_circles_of_all_sizes_meet(spark):
    from tessera.operators import points

    rng = np.random.default_rng(8)
    rows = [(k, float(x), float(y), float(r)) for k, (x, y, r) in enumerate(zip(rng.random(300) * 50, rng.random(300) * 50, 2.0 ** rng.integers(-6, 4, 300), strict=True))] + [(900, 3.0, 3.0, 0.0), (901, 3.0, 3.0, 0.0)]
    found = [(r.src, r.dst) for r in points.contacts(spark.createDataFrame(rows, "id long, cx double, cy double, r double")).collect()]
    want = {(a, b) for a, ax, ay, ar in rows for b, bx, by, br in rows if a < b and math.hypot(ax - bx, ay - by) <= 1.1 * (ar + br)}
    assert len(found) == len(set(found)) and set(found) == want


def test_local_maps_repeat_a_smooth_map(spark):
    from tessera.functions import kernels
    from tessera.operators import raster, register

    grid = [(x, y) for x in range(0, 41, 8) for y in range(0, 33, 8)]
    bend = lambda x, y: (0.9 * x + 2 + 0.002 * x * y, 0.95 * y + 0.5 + 0.001 * x * x)
    pairs = spark.createDataFrame([("a", k, float(x), float(y), *map(float, bend(x, y))) for k, (x, y) in enumerate(grid)], "id string, seq long, fx double, fy double, mx double, my double")
    r = _frame(spark, a=np.add.outer(np.arange(41.0), 2 * np.arange(49.0)))
    places = register.local_places(r.filter("y <= 32 and x <= 40"), kernels.local_maps(pairs, 0.5))
    for p in places.collect():
        assert (p.sx, p.sy) == pytest.approx(bend(p.x, p.y), abs=1e-6)
    moved = {(p.y, p.x): p.v for p in register.warped(r, places, None).collect()}
    assert moved[10, 10] == pytest.approx(bend(10, 10)[1] + 2 * bend(10, 10)[0])
    same = raster.compare(register.warped(r, r.select(*KEY, F.col("x").cast("double").alias("sx"), F.col("y").cast("double").alias("sy"))), r).first()
    assert same.mse == 0


def test_rigid_registration_finds_scale_and_turn(spark):
    from tessera.functions import pipelines
    from tessera.operators import raster

    def box(h, w, cy, cx, a, b, degrees):
        y, x = np.mgrid[:h, :w]
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        u, v = (x - cx) * c + (y - cy) * s, (y - cy) * c - (x - cx) * s
        return ((np.abs(u) <= a) & (np.abs(v) <= b)).astype(float)

    moving, fixed = box(90, 100, 44, 48, 24, 14, -8), box(120, 130, 64, 60, 30, 17.5, 7)
    m, f = _frame(spark, a=moving), _frame(spark, a=fixed)
    done = pipelines.register_rigid(m, m, f)
    assert done.scale == pytest.approx(1.25, abs=0.04) and done.theta == pytest.approx(15, abs=2)
    on = lambda r: r.filter("v > 0.5").select(*KEY)
    assert raster.dice(on(done.mask), on(f)).first().dice > 0.93
    assert len(done.moving_points) == len(done.fixed_points) == 5
    pairs = spark.createDataFrame([("a", k, *map(float, q), *map(float, p)) for k, (p, q) in enumerate((((x, y), (x, y)) for x in range(0, 130, 30) for y in range(0, 120, 30)))], "id string, seq long, fx double, fy double, mx double, my double")
    ranked = pipelines.register_nonrigid(done.mask, pairs, f).collect()
    assert {r.name for r in ranked} == {"local", "degree 2", "degree 3"} and all(r.r > 0.9 for r in ranked)


def test_windows_lie_on_the_mask_and_apart(spark):
    from tessera.functions import pipelines
    from tessera.settings import Folders, Settings, Windows

    a = np.ones((60, 70))
    a[20:30, 20:30] = 0
    mask = _frame(spark, a=a, b=a[:35]).filter("v > 0").select(*KEY)
    settings = Windows(5, 8, 9)
    found = pipelines.windows_of_interest(mask, settings).collect()
    for n, rows in (("a", a), ("b", a[:35])):
        own = [r for r in found if r.image_id == n]
        assert len(own) == 5
        for r in own:
            assert rows[r.y : r.y + 8, r.x : r.x + 9].sum() == 72
        assert all(abs(p.x - q.x) >= 9 or abs(p.y - q.y) >= 8 for p, q in itertools.combinations(own, 2))
    share = {r.image_id: r.share for r in pipelines.coverage_of(mask, spark.createDataFrame(found), settings).collect()}
    assert share["a"] == pytest.approx(360 / a.sum())
    s = Settings(Folders("/a//b"))
    assert s.folders.resolved().masks == "/a/b/savedOutput/" and s.windows.radius_bounds() == pytest.approx((300, 300 * 2**0.5))
