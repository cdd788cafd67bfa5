"""Further pipelines: full-colour and log-contrast segmentation, rigid registration of two sections, windows of interest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enhance, points, raster, regions, register, tiles
from ..settings import Windows
from . import kernels, segment, vector_calculus

KEY = ["image_id", "y", "x"]
PAD = 9


def colour_edges(rgb: DataFrame) -> DataFrame:
    """The mean of the 24 neighbours in each adjusted, detail-enhanced channel, joined as a length over the channels, scaled to [0, 1]."""
    ring = [[1 / 24 if (i, j) != (2, 2) else 0.0 for j in range(5)] for i in range(5)]
    total = None
    for c in "rgb":
        sharp = kernels.detail_enhanced(raster.adjust(rgb.select(*KEY, F.col(c).alias("v"))), 0.8, 1.25)
        one = raster.filter_kernel(sharp, ring, "replicate").select(*KEY, (F.col("v") * F.col("v")).alias("v"))
        total = one if total is None else total.unionByName(one)
    return raster.rescale(total.groupBy(*KEY).agg(F.sqrt(F.sum("v")).alias("v")))


def segment_full_colour(rgb: DataFrame, least: int = 120, rounds: int = 15) -> DataFrame:
    """Colour edges, their first derivative brightened and rebuilt under them, minima imposed at the mean; pixels above 1.01 of the
    commonest value in regions of at least ``least`` pixels, relaxed as a two-region contour on the gray image.
    """
    edges = regions.shared_copy(raster.padded(colour_edges(rgb), PAD))
    slope = raster.derivative(edges, "x").withColumnRenamed("v", "ex").join(raster.derivative(edges, "y").withColumnRenamed("v", "ey"), KEY)
    bright = kernels.brightened(slope.select(*KEY, F.hypot("ex", "ey").alias("v")))
    rebuilt = regions.reconstruct_gray(bright.join(edges.select(*KEY, F.col("v").alias("m")), KEY))
    mean = rebuilt.groupBy("image_id").agg(F.round(F.avg("v"), 4).alias("mean"))
    markers = rebuilt.join(mean, "image_id").filter(F.round("v", 4) == F.col("mean")).select(*KEY)
    flat = kernels.imposed_minima(raster.complement(rebuilt), markers)
    size = flat.groupBy("image_id").agg((F.max("y") - PAD).alias("y1"), (F.max("x") - PAD).alias("x1"))
    inner = flat.join(size, "image_id").filter(F.col("y").between(F.lit(PAD), F.col("y1")) & F.col("x").between(F.lit(PAD), F.col("x1")))
    inner = regions.shared_copy(inner.select("image_id", (F.col("y") - PAD).alias("y"), (F.col("x") - PAD).alias("x"), F.round("v", 9).alias("v")))
    usual = raster.mode(inner).select("image_id", F.col("v").alias("usual"))
    high = inner.join(usual, "image_id").filter(F.col("v") > 1.01 * F.col("usual")).select(*KEY)
    return segment.two_region_contour(raster.gray(rgb), regions.area_open(regions.label(high), least), rounds)


def log_contrast_mask(rgb: DataFrame, height: int, width: int, window: int = 12) -> DataFrame:
    """Lightness with half its top hat added and half its bottom hat taken, evened by a large median, equalised, complemented and closed;
    the twelfth power of its scaled logarithm plus its slope, above Otsu; closed, filled, opened and cleaned.
    """
    light = regions.shared_copy(raster.rescale(raster.lab(rgb).select(*KEY, F.col("l").alias("v"))))
    up = raster._beside(light, tiles.opened(light, "rounded", 2), F.col("v") + 0.5 * (F.col("v") - F.col("o")))
    both = regions.shared_copy(raster._beside(up, tiles.closed(up, "rounded", 2), F.col("v") - 0.5 * (F.col("o") - F.col("v"))))
    even = regions.shared_copy(raster._beside(both, raster.median_filter(both, window), F.col("v") - F.col("o")))
    dark = raster.closed(raster.complement(raster.equalized(raster.levels(even))))
    logs = regions.shared_copy(raster.rescale(dark.withColumn("v", F.when(F.col("v") > 0, F.log("v")).otherwise(F.lit(2.0**-52)))))
    slope = raster.derivative(logs, "x").withColumnRenamed("v", "ex").join(raster.derivative(logs, "y").withColumnRenamed("v", "ey"), KEY)
    strong = logs.join(slope, KEY).select(*KEY, (F.pow("v", F.lit(12.0)) + F.hypot("ex", "ey")).alias("v"))
    ones = lambda m: logs.select(*KEY).join(m.select(*KEY, F.lit(1.0).alias("v")), KEY, "left").fillna(0.0, ["v"])
    mask = tiles.closed(ones(vector_calculus.above_otsu(strong, 1.0)), "disk", 6).filter("v > 0").select(*KEY)
    full = regions.fill_holes(regions.shared_copy(mask), logs, height, width)
    return regions.cleaned(regions.label(raster.opened(ones(full), 2).filter("v > 0").select(*KEY)))


@dataclass(frozen=True)
class Aligned:
    """A moving section brought onto a fixed one: its image and mask, both sets of points, and the numbers used."""

    image: DataFrame
    mask: DataFrame
    moving_points: list[tuple[float, float]]
    fixed_points: list[tuple[float, float]]
    scale: float
    theta: float
    shift: tuple[int, int]


def _corners(mask: DataFrame) -> list[tuple[float, float]]:
    """Of the mask's hull, reduced to its turns, the vertices nearest to the four corners of its bounds: TL, TR, BR, BL."""
    hull = points.convex_hull(mask.select(F.col("image_id").alias("set"), F.col("y").alias("seq"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")))
    found = {r.corner: (r.px, r.py) for r in points.corners(kernels.reduced(hull, 1.5)).collect()}  # four rows
    return [found[c] for c in ("tl", "tr", "br", "bl")]


def register_rigid(moving: DataFrame, moving_mask: DataFrame, fixed_mask: DataFrame) -> Aligned:
    """One moving image (and mask, both dense 0 to 1) scaled, turned and shifted onto one fixed mask.

    Four corners of each mask give the scale and the turn; the image is resized by the rational kernel and turned by
    cubic interpolation; then corners and centroids give the shift, rounded to whole pixels. What leaves the moving
    canvas is lost, so pad first; beyond it the image is 1 and the mask 0.
    """
    spark = moving.sparkSession
    on = lambda m: m.filter("v > 0.5").select(*KEY)
    a, b = _corners(on(moving_mask)), _corners(on(fixed_mask))
    quad = {"id": 0} | {f"{q}{k + 1}{c}": float(v) for q, p in (("m", a), ("f", b)) for k, xy in enumerate(p) for c, v in zip("xy", xy, strict=True)}
    k = points.rotation_and_scale(spark.createDataFrame([quad])).first().scale
    image, mask = (regions.shared_copy(raster.resized(r, k, kernel="rational")) for r in (moving, moving_mask))
    a = [(x * k, y * k) for x, y in a]
    quad |= {f"m{i + 1}{c}": float(v) for i, xy in enumerate(a) for c, v in zip("xy", xy, strict=True)}
    theta = points.rotation_and_scale(spark.createDataFrame([quad])).first().theta
    my, mx = mask.agg(F.max("y"), F.max("x")).first()
    turned = register.rotated_points(spark.createDataFrame(a, "px double, py double"), theta, mx / 2, my / 2).collect()
    image = regions.shared_copy(register.rotated_cubic(image, theta).fillna(1.0, ["v"]))
    mask = regions.shared_copy(register.binary_again(register.rotated_cubic(mask, theta).fillna(0.0, ["v"])))
    middle = lambda m: tuple(regions.largest(regions.label(on(m))).agg(F.avg("x"), F.avg("y")).first())
    moving_points = [(r.px, r.py) for r in turned] + [middle(mask)]
    fixed_points = [*b, middle(fixed_mask)]
    dx, dy = (round(sum(f[i] - m[i] for f, m in zip(fixed_points, moving_points, strict=True)) / 5) for i in (0, 1))
    fy, fx = fixed_mask.agg(F.max("y"), F.max("x")).first()
    canvas = fixed_mask.select(*KEY)

    def moved(r: DataFrame, fill: float) -> DataFrame:
        there = r.select("image_id", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), "v").filter(F.col("y").between(0, fy) & F.col("x").between(0, fx))
        return canvas.join(there, KEY, "left").fillna(fill, ["v"])

    return Aligned(moved(image, 1.0), moved(mask, 0.0), [(x + dx, y + dy) for x, y in moving_points], fixed_points, k, theta, (dx, dy))


def register_nonrigid(moving: DataFrame, pairs: DataFrame, fixed: DataFrame) -> DataFrame:
    """(name, mse, r) of the moving image mapped by local weighted means and by polynomials of degree 2 and 3, best first by r.

    pairs: (id = image_id, seq, fx, fy, mx, my), the control points of one image.
    """
    out = None
    numbered = pairs.withColumn("id", F.lit(0).cast("long"))
    for name, places in [("local", register.local_places(fixed, kernels.local_maps(pairs)))] + [
        (f"degree {d}", register.polynomial_places(fixed, [(r.px, r.py, r.cx, r.cy) for r in kernels.polynomial_transform(numbered, d).collect()])) for d in (2, 3)  # six and ten rows
    ]:
        one = raster.compare(register.warped(moving, places, 1.0), fixed).select(F.lit(name).alias("name"), "mse", "r")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("r"))


def windows_of_interest(mask: DataFrame, settings: Windows, seed: int = 0, tries: int = 4000) -> DataFrame:
    """(image_id, roi, seq, x, y): so many windows wholly on each image's mask, none over another, from drawn candidates.

    Candidates are drawn by a hash of their number inside the mask's bounds; of those that fit, the first ones are kept.
    """
    box = mask.groupBy("image_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    spots = box.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tries - 1).cast("long"))))
    place = lambda n, low, high, side: F.col(low) + F.pmod(F.xxhash64("image_id", "seq", F.lit(seed), F.lit(n)), F.greatest(F.lit(1).cast("long"), F.col(high) - F.col(low) + 2 - side))
    candidates = spots.select("image_id", "seq", place(0, "x0", "x1", settings.width).alias("x"), place(1, "y0", "y1", settings.height).alias("y"))
    return points.accept_windows(candidates, mask.select(*KEY), settings.height, settings.width, settings.count)


def coverage_of(mask: DataFrame, windows: DataFrame, settings: Windows) -> DataFrame:
    """(image_id, share) of each mask that the windows cover."""
    cells = windows.withColumn("y", F.explode(F.sequence(F.col("y"), F.col("y") + settings.height - 1))).withColumn("x", F.explode(F.sequence(F.col("x"), F.col("x") + settings.width - 1)))
    return enhance.coverage(mask, cells.select(*KEY))
