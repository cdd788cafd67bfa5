"""Pointwise, colour, neighbourhood, histogram, morphology and geometry operators on pixel tables.

Rows are (image_id, y, x, v). Separable operators use two window passes, by row and by column of each image, so work
is spread over all rows of all images; other neighbourhoods go through the halo tiles of ``tiles``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tiles

ROW, COLUMN = ("image_id", "y", "x"), ("image_id", "x", "y")


def _window(axis: tuple[str, str, str]) -> Window:
    return Window.partitionBy(*axis[:2]).orderBy(axis[2])


def _whole() -> Window:
    return Window.partitionBy("image_id")


# pointwise


def ends(r: DataFrame) -> DataFrame:
    """``r`` with each image's least and greatest value (lo, hi): one small row an image, joined back."""
    per = r.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return r.join(per, "image_id")


def rescale(r: DataFrame) -> DataFrame:
    """Min-max scale of each image to [0, 1]; a constant image becomes 0."""
    return ends(r).withColumn("v", F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).drop("lo", "hi")


def complement(r: DataFrame) -> DataFrame:
    return r.withColumn("v", 1 - F.col("v"))


def quantiles(r: DataFrame, shares: list[float], bins: int = 4096) -> DataFrame:
    """(image_id, q0, q1, ...): exact quantiles of v with linear interpolation between order statistics.

    A histogram of ``bins`` bins tells which bins hold the ranks asked for; only those bins' distinct values are
    counted, so no aggregation holds an image's values.
    """
    plain = r.filter(F.col("v").isNotNull()).select("image_id", F.col("v").cast("double").alias("v"))
    span = plain.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    binned = plain.join(span, "image_id").withColumn("bin", bin_.cast("int")).select("image_id", "bin", "v", "n")
    counts = binned.groupBy("image_id", "bin", "n").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("image_id").orderBy("bin")) - F.col("c")
    spots = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("share")) for k, s in enumerate(shares)])
    asked = counts.withColumn("before", before).withColumn("s", F.explode(spots)).withColumn("pos", F.col("s.share") * (F.col("n") - 1))
    asked = asked.filter((F.floor("pos") < F.col("before") + F.col("c")) & (F.ceil("pos") >= F.col("before")))
    asked = asked.select("image_id", "bin", "before", F.col("s.k").alias("k"), "pos")
    values = binned.join(asked.select("image_id", "bin", "before").distinct(), ["image_id", "bin"]).groupBy("image_id", "bin", "before", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("image_id", "bin").orderBy("v"))
    ranked = values.withColumn("upto", upto)  # ranks upto - c to upto - 1 have the value v
    found = ranked.drop("before").join(asked.drop("before"), ["image_id", "bin"])
    has = lambda p: F.max(F.when((p < F.col("upto")) & (p >= F.col("upto") - F.col("c")), F.col("v")))
    ends_ = found.groupBy("image_id", "k", "pos").agg(has(F.floor("pos")).alias("a"), has(F.ceil("pos")).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))
    return ends_.groupBy("image_id").agg(*[F.max(F.when(F.col("k") == k, value)).alias(f"q{k}") for k in range(len(shares))])


def adjust(r: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Saturate the tails at two quantiles of each image, then stretch to [0, 1]; 0 where the quantiles are equal."""
    s = (F.col("v") - F.col("q0")) / F.nullif(F.col("q1") - F.col("q0"), F.lit(0.0))
    return r.join(quantiles(r, [low, high]), "image_id").withColumn("v", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), F.lit(0.0))).drop("q0", "q1")


def double_scaled(r: DataFrame) -> DataFrame:
    """To [0, 1]: images already there are kept, negative ones shifted, larger ones divided by their range."""
    low = F.least("lo", F.lit(0.0))
    high = F.greatest("hi", F.lit(1.0))
    return ends(r).withColumn("v", (F.col("v") - low) / (high - low)).drop("lo", "hi")


# colour


def gray(rgb: DataFrame) -> DataFrame:
    return rgb.select("image_id", "y", "x", (0.2989 * F.col("r") + 0.5870 * F.col("g") + 0.1140 * F.col("b")).alias("v"))


def mean_channels(rgb: DataFrame) -> DataFrame:
    """Sum of the channels, min-max scaled."""
    return rescale(rgb.select("image_id", "y", "x", (F.col("r") + F.col("g") + F.col("b")).alias("v")))


# sRGB primaries to CIE XYZ, and the D65 white point.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def xyz(rgb: DataFrame) -> DataFrame:
    line = lambda c: F.when(F.col(c) <= 0.04045, F.col(c) / 12.92).otherwise(F.pow((F.col(c) + 0.055) / 1.055, F.lit(2.4)))
    return rgb.select("image_id", "y", "x", *[sum((k * line(c) for k, c in zip(row, "rgb", strict=True)), F.lit(0.0)).alias(n) for n, row in zip(("cx", "cy", "cz"), TO_XYZ, strict=True)])


def lab(rgb: DataFrame) -> DataFrame:
    bend = lambda t: F.when(t > 216 / 24389, F.pow(t, F.lit(1 / 3))).otherwise((24389 / 27 * t + 16) / 116)
    a, b, c = (bend(F.col(n) / w) for n, w in zip(("cx", "cy", "cz"), WHITE, strict=True))
    return xyz(rgb).select("image_id", "y", "x", (116 * b - 16).alias("l"), (500 * (a - b)).alias("a"), (200 * (b - c)).alias("b"))


def hsv(rgb: DataFrame) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    hi, d = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    h = F.when(d == 0, 0.0).when(hi == r, F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return rgb.select("image_id", "y", "x", h.alias("h"), F.when(hi == 0, 0.0).otherwise(d / hi).alias("s"), hi.alias("v"))


def rgb_from_lab(pixels: DataFrame) -> DataFrame:
    """The inverse of ``lab``: columns l, a, b to r, g, b; values outside [0, 1] are left as they are."""
    inverse = np.linalg.inv(np.array(TO_XYZ)).tolist()
    bend = lambda t: F.when(t * t * t > 216 / 24389, t * t * t).otherwise((116 * t - 16) * 27 / 24389)
    fy = (F.col("l") + 16) / 116
    found = [w * bend(t) for w, t in zip(WHITE, (fy + F.col("a") / 500, fy, fy - F.col("b") / 200), strict=True)]
    line = [sum((k * v for k, v in zip(row, found, strict=True)), F.lit(0.0)) for row in inverse]
    return pixels.select("image_id", "y", "x", *[F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055).alias(c) for c, v in zip("rgb", line, strict=True)])


def rgb_from_hsv(pixels: DataFrame) -> DataFrame:
    """The inverse of ``hsv``: columns h, s, v in [0, 1] to r, g, b."""
    at = lambda n: F.pmod(F.lit(float(n)) + 6 * F.col("h"), F.lit(6.0))
    part = lambda n: F.col("v") - F.col("v") * F.col("s") * F.greatest(F.lit(0.0), F.least(at(n), 4 - at(n), F.lit(1.0)))
    return pixels.select("image_id", "y", "x", part(5).alias("r"), part(3).alias("g"), part(1).alias("b"))


def label_colours(labelled: DataFrame) -> DataFrame:
    """A full colour for every label v: its hue is the fractional part of v times the golden ratio's inverse."""
    h = 6 * (F.col("v") * 0.6180339887498949 - F.floor(F.col("v") * 0.6180339887498949))
    one = lambda e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), e))
    return labelled.select("image_id", "y", "x", one(F.abs(h - 3) - 1).alias("r"), one(2 - F.abs(h - 2)).alias("g"), one(2 - F.abs(h - 4)).alias("b"))


def unmix(rgb: DataFrame, basis: list[list[float]]) -> DataFrame:
    """Each pixel's XYZ solved against three basis colours (columns), scaled to [0, 1] channel by channel."""
    (a, b, c), (d, e, f), (g, h, i) = basis
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    inverse = [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]
    mixed = xyz(rgb).select("image_id", "y", "x", *[sum((k * F.col(n) for k, n in zip(row, ("cx", "cy", "cz"), strict=True)), F.lit(0.0)).alias(f"s{j}") for j, row in enumerate(inverse)])
    span = mixed.groupBy("image_id").agg(*[f(f"s{j}").alias(f"{n}{j}") for j in range(3) for n, f in (("lo", F.min), ("hi", F.max))])
    return mixed.join(span, "image_id").select("image_id", "y", "x", *[((F.col(f"s{j}") - F.col(f"lo{j}")) / (F.col(f"hi{j}") - F.col(f"lo{j}"))).alias(f"s{j}") for j in range(3)])


# neighbourhoods


def convolve_line(r: DataFrame, taps: list[float], axis: tuple[str, str, str]) -> DataFrame:
    """Correlation with an odd number of taps along one axis; outside the image counts as 0."""
    w, half = _window(axis), len(taps) // 2
    parts = [k * (F.lead("v", i - half, 0.0).over(w) if i > half else F.lag("v", half - i, 0.0).over(w) if i < half else F.col("v")) for i, k in enumerate(taps) if k]
    return r.withColumn("v", F.col("v").cast("double")).withColumn("v", sum(parts[1:], parts[0]))


#: 7-tap interpolator and first and second derivative taps for images.
SMOOTH7 = [0.004711, 0.069321, 0.245410, 0.361117, 0.245410, 0.069321, 0.004711]
FIRST7 = [-0.018708, -0.125376, -0.193091, 0.0, 0.193091, 0.125376, 0.018708]
SECOND7 = [0.055336, 0.137778, -0.056554, -0.273118, -0.056554, 0.137778, 0.055336]


def derivative(r: DataFrame, along: str, box: DataFrame | None = None) -> DataFrame:
    """Separable 7-tap derivative: along "x", "y", "xx", "yy" or "xy".

    By windows, which take the next pixel that is there; with ``box`` (extents of images without gaps) by halo tiles, so
    that no column has to go through one task.
    """
    taps = {"x": (FIRST7, SMOOTH7), "y": (SMOOTH7, FIRST7), "xx": (SECOND7, SMOOTH7), "yy": (SMOOTH7, SECOND7), "xy": (FIRST7, FIRST7)}[along]
    if box is not None:
        return tiles.lines(r, *taps, box=box)
    return convolve_line(convolve_line(r, taps[0], ROW), taps[1], COLUMN)


def gaussian(r: DataFrame, sigma: float = 1.2) -> DataFrame:
    half = max(1, math.ceil(2 * sigma))
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    taps = [k / sum(raw) for k in raw]
    return convolve_line(convolve_line(r, taps, ROW), taps, COLUMN)


def fractional_derivative(r: DataFrame, order: float = 0.5) -> DataFrame:
    """Mean of the left and right Riemann-Liouville sums of an order along rows.

    A pixel counts d = 2 (the distances to its right and lower neighbours) to the power order + 1, and 0 in the last
    row and column; h is the mean of d, n = ceil(2 / h) (2 unless a side is under 4 pixels). With weights
    w_k = (-1)^k C(order, k), the left sum runs over the n pixels before and the pixel itself, w_0 on the farthest;
    the right sum over the pixel and n after it, cut at the edge; both are divided by h^(order + 1). Left of column n
    the left sum takes columns 0 to x + 1. An image one pixel high or wide has no distances: 0 throughout.
    """
    w = _window(ROW)
    weight, k = [1.0], 1
    while k <= 4:
        weight.append(-weight[-1] * (order - k + 1) / k)
        k += 1
    box = r.groupBy("image_id").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    pixels = (F.col("my") + 1) * (F.col("mx") + 1)
    h = F.lit(2.0) * F.col("my") * F.col("mx") / pixels
    n = F.when((F.col("my") > 0) & (F.col("mx") > 0), F.ceil(pixels / (F.col("my") * F.col("mx")).cast("double"))).otherwise(0).cast("int")
    held = (F.col("y") < F.col("my")) & (F.col("x") < F.col("mx"))
    a = r.join(box, "image_id").withColumns({"n": n, "h": h, "a": F.when(held, F.col("v").cast("double") * 2.0 ** (order + 1)).otherwise(0.0)})
    step = lambda d: F.lead("a", d, 0.0).over(w) if d > 0 else F.lag("a", -d, 0.0).over(w) if d < 0 else F.col("a")
    total = lambda terms: sum((weight[j] * step(d) for j, d in terms), F.lit(0.0))
    by_n = lambda f: F.when(F.col("n") == 2, f(2)).when(F.col("n") == 3, f(3)).otherwise(f(4))
    left = by_n(lambda m: total((j, j - m) for j in range(m + 1)))
    for x in range(4):  # the first columns
        left = F.when((F.col("x") == x) & (F.col("x") < F.col("n")), total((j, j - x) for j in range(x + 2))).otherwise(left)
    right = by_n(lambda m: total((j, j) for j in range(m + 1)))
    v = F.when(F.col("n") > 0, (left + right) / 2 / F.pow("h", F.lit(order + 1))).otherwise(0.0)
    return a.withColumn("out", v).select("image_id", "y", "x", F.col("out").alias("v"))


def square_agg(r: DataFrame, half: int, how) -> DataFrame:
    """A separable aggregate (min, max, sum) over the square of side 2 * half + 1, clipped to the image."""
    for axis in (ROW, COLUMN):
        r = r.withColumn("v", how("v").over(_window(axis).rowsBetween(-half, half)))
    return r


def erode(r: DataFrame, half: int = 1) -> DataFrame:
    return square_agg(r, half, F.min)


def dilate(r: DataFrame, half: int = 1) -> DataFrame:
    return square_agg(r, half, F.max)


def opened(r: DataFrame, half: int = 1) -> DataFrame:
    return dilate(erode(r, half), half)


def closed(r: DataFrame, half: int = 1) -> DataFrame:
    return erode(dilate(r, half), half)


def _beside(r: DataFrame, other: DataFrame, value: Column) -> DataFrame:
    return r.join(other.withColumnRenamed("v", "o"), ["image_id", "y", "x"]).withColumn("v", value).drop("o")


def top_hat(r: DataFrame, half: int = 1) -> DataFrame:
    return _beside(r, opened(r, half), F.col("v") - F.col("o"))


def bottom_hat(r: DataFrame, half: int = 1) -> DataFrame:
    return _beside(r, closed(r, half), F.col("o") - F.col("v"))


def background_corrected(r: DataFrame, radius: int = 12, shape: str = "disk", pad: int = 3) -> DataFrame:
    """1 - top hat of the complement over a flat neighbourhood, the image first padded by its nearest pixels: an even bright background."""
    wide = complement(padded(r, pad))
    even = complement(_beside(wide, tiles.opened(wide, shape, radius), F.col("v") - F.col("o")))
    box = r.groupBy("image_id").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    back = even.select("image_id", (F.col("y") - pad).alias("y"), (F.col("x") - pad).alias("x"), "v").join(box, "image_id")
    return back.filter((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") <= F.col("my")) & (F.col("x") <= F.col("mx"))).select("image_id", "y", "x", "v")


def filter_kernel(r: DataFrame, kernel: list[list[float]], border: str = "zero") -> DataFrame:
    """Correlation with a small square kernel."""
    return tiles.correlated(r, kernel, border)


def order_filter(r: DataFrame, rank: int, half: int = 1, border: str = "zero") -> DataFrame:
    """The rank-th smallest (from 1) of each square neighbourhood; zeros outside the image unless told otherwise."""
    return tiles.ranked(r, rank, tiles.footprint("square", half), border)


def median_filter(r: DataFrame, half: int = 1, border: str = "zero") -> DataFrame:
    return order_filter(r, ((2 * half + 1) ** 2 + 1) // 2, half, border)


def local_std(r: DataFrame, half: int = 1, border: str = "symmetric") -> DataFrame:
    """Sample deviation of the neighbourhood, mirrored at the image's border ("clip": its part inside the image)."""
    return tiles.deviation(r, half, border)


def local_range(r: DataFrame, half: int = 1) -> DataFrame:
    return _beside(dilate(r, half), erode(r, half), F.col("v") - F.col("o"))


def local_entropy(r: DataFrame, half: int = 4, border: str = "symmetric") -> DataFrame:
    """Entropy in bits of the levels in the neighbourhood, mirrored at the image's border."""
    return tiles.entropy(r, half, border)


def sobel(r: DataFrame) -> DataFrame:
    """Gradient components and magnitude (gx, gy, v) by 3 x 3 Sobel kernels."""
    line = lambda q, taps, axis: convolve_line(q, taps, axis)
    gx = line(line(r, [-1.0, 0.0, 1.0], ROW), [1.0, 2.0, 1.0], COLUMN).withColumnRenamed("v", "gx")
    gy = line(line(r, [1.0, 2.0, 1.0], ROW), [-1.0, 0.0, 1.0], COLUMN).withColumnRenamed("v", "gy")
    return gx.join(gy, ["image_id", "y", "x"]).withColumn("v", F.hypot("gx", "gy"))


def cooccurrence(r: DataFrame, offsets: tuple[tuple[int, int], ...] = ((0, 1),), symmetric: bool = False) -> DataFrame:
    """Counts of level pairs (i, j) at each (dy, dx) offset, dy 0 or -1; if asked, with each pair counted both ways."""
    out = None
    for dy, dx in offsets:
        moved = r.select("image_id", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("v").alias("n"))
        if dy == 0 and dx > 0:
            pairs = r.withColumn("n", F.lead("v", dx).over(_window(ROW))).filter("n is not null")
        else:
            pairs = r.join(moved, ["image_id", "y", "x"])
        pairs = pairs.select("image_id", F.col("v").alias("i"), F.col("n").alias("j"))
        if symmetric:
            pairs = pairs.unionByName(pairs.select("image_id", F.col("j").alias("i"), F.col("i").alias("j")))
        out = pairs if out is None else out.unionByName(pairs)
    return out.groupBy("image_id", "i", "j").agg(F.count(F.lit(1)).alias("count"))


# histograms


def levels(r: DataFrame, bins: int = 256) -> DataFrame:
    """Each image's values as whole levels 0 .. bins - 1 of its own range."""
    s = F.floor((bins - 1) * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return ends(r).withColumn("v", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), s)).otherwise(0).cast("long")).drop("lo", "hi")


def histogram(levelled: DataFrame) -> DataFrame:
    return levelled.groupBy("image_id", F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu(levelled: DataFrame) -> DataFrame:
    """(image_id, threshold): the first level that splits the histogram with the largest variance between classes.

    Works on histograms alone: at most 256 rows an image after the map-side count.
    """
    w = Window.partitionBy("image_id").orderBy("bin")
    run = histogram(levelled).withColumn("n0", F.sum("n").over(w)).withColumn("s0", F.sum(F.col("n") * F.col("bin")).over(w))
    total = _whole()
    run = run.withColumn("nt", F.sum("n").over(total)).withColumn("st", F.sum(F.col("n") * F.col("bin")).over(total)).filter("n0 < nt")
    d = F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / (F.col("nt") - F.col("n0"))
    run = run.withColumn("b", F.round(F.col("n0").cast("double") * (F.col("nt") - F.col("n0")) * d * d, 3))
    best = Window.partitionBy("image_id").orderBy(F.desc("b"), "bin")
    return run.withColumn("k", F.row_number().over(best)).filter("k = 1").select("image_id", F.col("bin").alias("threshold"))


def binarize(levelled: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The mask of pixels above their image's threshold."""
    return levelled.join(thresholds, "image_id").filter(F.col("v") > F.col("threshold")).select("image_id", "y", "x")


def equalized(levelled: DataFrame) -> DataFrame:
    """Each level replaced by the share of pixels at or below it."""
    w = Window.partitionBy("image_id").orderBy("bin")
    h = histogram(levelled).withColumn("c", F.sum("n").over(w) / F.sum("n").over(_whole())).select("image_id", F.col("bin").alias("v"), "c")
    return levelled.join(h, ["image_id", "v"]).select("image_id", "y", "x", F.col("c").alias("v"))


def match_histogram(moving: DataFrame, fixed: DataFrame) -> DataFrame:
    """Moving levels mapped to the least fixed level of the same image with at least the same cumulative share.

    Both images' levels are put in one order by share; a fixed level answers the moving ones before it, so no level
    meets all others.
    """
    w = Window.partitionBy("image_id").orderBy("bin")
    share = lambda q: histogram(q).withColumn("c", F.sum("n").over(w) / F.sum("n").over(_whole()))
    none = F.lit(None).cast(fixed.schema["v"].dataType)
    asked = share(moving).select("image_id", (F.col("c") - 1e-12).alias("c"), F.col("bin").alias("v"), none.alias("to"))
    given = share(fixed).select("image_id", "c", F.lit(None).cast(moving.schema["v"].dataType).alias("v"), F.col("bin").alias("to"))
    ahead = Window.partitionBy("image_id").orderBy("c", F.col("to").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    rule = asked.unionByName(given).withColumn("to", F.min("to").over(ahead)).filter("v is not null").select("image_id", "v", "to")
    return moving.join(rule, ["image_id", "v"]).select("image_id", "y", "x", F.col("to").alias("v"))


def mode(levelled: DataFrame) -> DataFrame:
    """The commonest value of each image, the least of equals."""
    w = Window.partitionBy("image_id").orderBy(F.desc("n"), "bin")
    return histogram(levelled).withColumn("k", F.row_number().over(w)).filter("k = 1").select("image_id", F.col("bin").alias("v"), "n")


def freedman_diaconis(r: DataFrame) -> DataFrame:
    """(image_id, bin, left, n): a histogram with bins 2 IQR n^(-1/3) wide from the least value on, empty bins too.

    The width is not rounded. An image whose quartiles are equal has one bin.
    """
    plain = r.filter(F.col("v").isNotNull()).select("image_id", F.col("v").cast("double").alias("v"))
    span = plain.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).join(quantiles(plain, [0.25, 0.75]), "image_id")
    width = 2 * (F.col("q1") - F.col("q0")) * F.pow("n", F.lit(-1 / 3))
    span = span.withColumn("width", width).withColumn("bins", F.when(F.col("width") > 0, F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / F.col("width")))).otherwise(1).cast("long")).drop("n")
    at = F.when(F.col("width") > 0, F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) / F.col("width")))).otherwise(0).cast("long")
    found = plain.join(span, "image_id").groupBy("image_id", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = span.select("image_id", "lo", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return every.join(found, ["image_id", "bin"], "left").select("image_id", "bin", (F.col("lo") + F.col("bin") * F.greatest(F.col("width"), F.lit(0.0))).alias("left"), F.coalesce("n", F.lit(0)).alias("n"))


def valley(r: DataFrame) -> DataFrame:
    """(image_id, valley): left edge of the first bin after which the Freedman-Diaconis counts fall and then do not."""
    w = Window.partitionBy("image_id").orderBy("bin")
    turned = (F.lead("n").over(w) < F.col("n")) & (F.lead("n", 2).over(w) >= F.lead("n").over(w))
    return freedman_diaconis(r).withColumn("t", turned).filter("t").groupBy("image_id").agg(F.min("left").alias("valley"))


def top_share(levelled: DataFrame, share: float = 0.04) -> DataFrame:
    """(image_id, threshold): the first level at which more than 1 - share of the pixels lie at or below it."""
    w = Window.partitionBy("image_id").orderBy("bin")
    run = histogram(levelled).withColumn("c", F.sum("n").over(w)).withColumn("t", F.sum("n").over(_whole()))
    return run.filter(F.col("c") > (1 - share) * F.col("t")).groupBy("image_id").agg(F.min("bin").alias("threshold"))


def minimum_near_otsu(levelled: DataFrame, most: int = 4) -> DataFrame:
    """(image_id, threshold): of the deepest local minima of the histogram (at most so many), the one nearest the Otsu level.

    A minimum's depth is its lower neighbour's rise. Without a minimum: the Otsu level itself.
    """
    w = Window.partitionBy("image_id").orderBy("bin")
    before, after = F.lag("n").over(w), F.lead("n").over(w)
    low = histogram(levelled).withColumn("depth", F.least(before, after) - F.col("n")).filter("depth > 0")
    deep = low.withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("depth"), "bin"))).filter(F.col("k") <= most)
    near = otsu(levelled).withColumnRenamed("threshold", "o").join(deep, "image_id", "left")
    best = near.groupBy("image_id", "o").agg(F.min(F.struct(F.abs(F.col("bin") - F.col("o")).alias("d"), F.col("bin").alias("bin"))).alias("b"))
    return best.select("image_id", F.coalesce("b.bin", "o").alias("threshold"))


def local_maxima(levelled: DataFrame) -> DataFrame:
    w = Window.partitionBy("image_id").orderBy("bin")
    return histogram(levelled).withColumn("p", (F.lag("n").over(w) < F.col("n")) & (F.lead("n").over(w) < F.col("n"))).filter("p").select("image_id", "bin", "n")


# masks and geometry


def perimeter(mask: DataFrame) -> DataFrame:
    """Mask pixels with a 4-neighbour outside the mask (or the image)."""
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("dy"), F.lit(b).cast("long").alias("dx")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    votes = mask.select("image_id", "y", "x", F.lit(0).alias("n")).unionByName(mask.withColumn("d", F.explode(steps)).select("image_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), F.lit(1).alias("n")))
    return votes.groupBy("image_id", "y", "x").agg(F.sum("n").alias("n"), F.min("n").alias("own")).filter("own = 0 and n < 4").select("image_id", "y", "x")


def euler_number(mask: DataFrame) -> DataFrame:
    """Pixels minus joins: Euler number (8-connected) from counts of 2 x 2 quads."""
    corner = F.array(*[F.struct(F.lit(a).cast("long").alias("dy"), F.lit(b).cast("long").alias("dx"), F.lit(k).alias("k")) for a, b, k in ((0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8))])
    quads = mask.withColumn("d", F.explode(corner)).groupBy("image_id", (F.col("y") + F.col("d.dy")).alias("qy"), (F.col("x") + F.col("d.dx")).alias("qx")).agg(F.sum("d.k").alias("q"), F.count(F.lit(1)).alias("n"))
    one, three, across = (F.col("n") == 1), (F.col("n") == 3), F.col("q").isin(6, 9)
    return quads.groupBy("image_id").agg(((F.sum(one.cast("int")) - F.sum(three.cast("int")) - 2 * F.sum(across.cast("int"))) / 4).cast("long").alias("euler"))


def quadrants_filled(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Whether all four quadrants of each image hold a mask pixel; quadrants share the middle rows and columns.

    The upper half is rows 0 to ceil(height / 2) - 1, the lower one begins at row floor(height / 2) - 1; columns alike.
    """
    top, left = F.col("y") < -(-height // 2), F.col("x") < -(-width // 2)
    low, right = F.col("y") >= max(0, height // 2 - 1), F.col("x") >= max(0, width // 2 - 1)
    return mask.groupBy("image_id").agg(*[F.max(c.cast("int")).alias(n) for n, c in (("a", top & left), ("b", top & right), ("c", low & left), ("d", low & right))]).select("image_id", (F.col("a") + F.col("b") + F.col("c") + F.col("d") == 4).alias("filled"))


def rotated90(r: DataFrame, turns: int) -> DataFrame:
    """Counter-clockwise quarter turns, by exact coordinate remaps."""
    box = r.groupBy("image_id").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    y, x = {0: ("y", "x"), 1: ("mx - x", "y"), 2: ("my - y", "mx - x"), 3: ("x", "my - y")}[turns % 4]
    return r.join(box, "image_id").select("image_id", F.expr(y).alias("y"), F.expr(x).alias("x"), "v")


def flipped(r: DataFrame, axis: str = "x") -> DataFrame:
    box = r.groupBy("image_id").agg(F.max(axis).alias("m"))
    return r.join(box, "image_id").withColumn(axis, F.col("m") - F.col(axis)).drop("m")


def shifted(r: DataFrame, dy: int, dx: int) -> DataFrame:
    """Cyclic shift."""
    box = r.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return r.join(box, "image_id").select("image_id", F.pmod(F.col("y") + dy, F.col("h")).alias("y"), F.pmod(F.col("x") + dx, F.col("w")).alias("x"), "v")


def cropped(r: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    return r.filter((F.col("y") >= y0) & (F.col("y") < y0 + height) & (F.col("x") >= x0) & (F.col("x") < x0 + width)).withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)


def padded(r: DataFrame, margin: int, fill: float | None = None) -> DataFrame:
    """A margin on all sides: of ``fill``, or of the nearest pixel where that is None."""
    box = r.groupBy("image_id").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    grid = box.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("my") + 2 * margin))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("mx") + 2 * margin)))
    near = lambda c, m: F.greatest(F.lit(0), F.least(F.col(m), F.col(c) - margin)).cast("long") if fill is None else (F.col(c) - margin).cast("long")
    source = r.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    out = grid.withColumn("sy", near("y", "my")).withColumn("sx", near("x", "mx")).join(source, ["image_id", "sy", "sx"], "left")
    return out.select("image_id", F.col("y").cast("long"), F.col("x").cast("long"), F.col("v") if fill is None else F.coalesce("v", F.lit(fill).cast(r.schema["v"].dataType)).alias("v"))


def affine_bilinear(r: DataFrame, a: float, b: float, c: float, d: float, e: float, f: float) -> DataFrame:
    """Output pixel (y, x) takes the input at (c x + d y + f, a x + b y + e) by bilinear weights; outside counts as 0."""
    box = r.groupBy("image_id").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    grid = r.select("image_id", "y", "x").join(box, "image_id")
    at = grid.withColumn("sx", a * F.col("x") + b * F.col("y") + e).withColumn("sy", c * F.col("x") + d * F.col("y") + f)
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    taps = F.array(*[F.struct((F.floor("sy") + i).alias("py"), (F.floor("sx") + j).alias("px"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("k")) for i in (0, 1) for j in (0, 1)])
    wide = at.select("image_id", "y", "x", F.explode(taps).alias("t")).select("image_id", "y", "x", F.col("t.py").alias("py"), F.col("t.px").alias("px"), F.col("t.k").alias("k"))
    source = r.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), "v")
    return wide.join(source, ["image_id", "py", "px"], "left").groupBy("image_id", "y", "x").agg(F.sum(F.col("k") * F.coalesce("v", F.lit(0))).alias("v"))


def shrunk(r: DataFrame, factor: int = 2) -> DataFrame:
    """Box-averaged reduction by a whole factor."""
    return r.groupBy("image_id", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg("v").alias("v"))


def cubic_kernel(x: Column) -> Column:
    """The cubic convolution kernel with a = -1/2, support 4."""
    a = F.abs(x)
    return F.when(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1).when(a <= 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2).otherwise(0.0)


def rational_kernel(x: Column) -> Column:
    """A piecewise rational resize kernel, support 4."""
    a = F.abs(x)
    # The two pieces' coefficients.
    inner = (-0.168 * a * a - 0.9129 * a + 1.0808) / (a * a - 0.8319 * a + 1.0808)
    outer = (0.1953 * a * a - 0.5858 * a + 0.3905) / (a * a - 2.4402 * a + 1.7676)
    return F.when(a <= 1, inner).when(a <= 2, outer).otherwise(0.0)


def triangle_kernel(x: Column) -> Column:
    """Linear interpolation, support 2."""
    return F.greatest(F.lit(0.0), 1 - F.abs(x))


def box_kernel(x: Column) -> Column:
    """The nearest pixel, support 1."""
    return F.when((x >= -0.5) & (x < 0.5), 1.0).otherwise(0.0)


def lanczos3_kernel(x: Column) -> Column:
    """A windowed sinc, support 6."""
    t = F.lit(math.pi) * x
    return F.when(F.abs(x) < 1e-8, 1.0).when(F.abs(x) < 3, 3 * F.sin(t) * F.sin(t / 3) / (t * t)).otherwise(0.0)


KERNELS = {"cubic": (cubic_kernel, 4), "rational": (rational_kernel, 4), "linear": (triangle_kernel, 2), "nearest": (box_kernel, 1), "lanczos3": (lanczos3_kernel, 6)}


def _resized_line(r: DataFrame, along: str, across: str, size: Column, scale: Column, kernel: str, antialias: bool) -> DataFrame:
    """One axis of ``resized``: each line of pixels is an array, and an output pixel a weighted sum of some elements."""
    f, support = KERNELS[kernel]
    lines = r.groupBy("image_id", across).agg(F.sort_array(F.collect_list(F.struct(along, F.col("v").cast("double").alias("v")))).alias("a"))
    lines = lines.withColumn("n", F.size("a")).withColumns({"out": size.cast("int"), "scale": scale.cast("double")})
    squeeze = F.least(F.col("scale"), F.lit(1.0)) if antialias else F.lit(1.0)
    lines = lines.withColumn("k", squeeze).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("out") - 1)))
    middle = (F.col("u") + 0.5) / F.col("scale") - 0.5
    first = F.floor(middle - support / 2 / F.col("k")).cast("int")
    taps = F.sequence(first, first + F.ceil(support / F.col("k")).cast("int") + 1)
    lines = lines.withColumn("m", middle).withColumn("taps", taps)
    weigh = F.transform("taps", lambda i: F.struct(f(F.col("k") * (F.col("m") - i)).alias("w"), F.get("a", F.greatest(F.lit(0), F.least(i, F.col("n") - 1)))["v"].alias("v")))
    lines = lines.withColumn("t", weigh)
    total = F.aggregate("t", F.lit(0.0), lambda s, e: s + e["w"] * e["v"])
    weight = F.aggregate("t", F.lit(0.0), lambda s, e: s + e["w"])
    return lines.select("image_id", F.col(across), F.col("u").cast("long").alias(along), (total / weight).alias("v"))


def resized(r: DataFrame, scale: float | None = None, size: tuple[int, int] | None = None, kernel: str = "cubic", antialias: bool = True) -> DataFrame:
    """Images resized by a factor (sides rounded up) or to (height, width), one axis after the other.

    Output place u takes the input at u / s + (1 / s - 1) / 2 with a kernel of KERNELS, stretched where the image
    shrinks (antialiasing), its weights made to sum to 1; beyond the border the nearest pixel counts. Columns of
    pixels go first, then rows. Images are dense; work is per line, so no image has to fit into a task.
    """
    height, width = (F.ceil(F.col("n") * scale), F.ceil(F.col("n") * scale)) if size is None else (F.lit(size[0]), F.lit(size[1]))
    by = lambda out: F.lit(float(scale)) if size is None else out / F.col("n")
    r = _resized_line(r, "y", "x", height, by(height), kernel, antialias)
    return _resized_line(r, "x", "y", width, by(width), kernel, antialias).select("image_id", "y", "x", "v")


# comparisons


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean squared error and correlation of two rasters of the same extent, image by image."""
    both = a.join(b.withColumnRenamed("v", "w"), ["image_id", "y", "x"])
    return both.groupBy("image_id").agg(F.avg((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))).alias("mse"), F.corr(F.col("v").cast("double"), F.col("w").cast("double")).alias("r"))


def dice(a: DataFrame, b: DataFrame) -> DataFrame:
    """2 |A and B| / (|A| + |B|) of two masks, image by image."""
    tagged = a.withColumn("p", F.lit(1)).withColumn("q", F.lit(0)).unionByName(b.withColumn("p", F.lit(0)).withColumn("q", F.lit(1)))
    cell = tagged.groupBy("image_id", "y", "x").agg(F.max("p").alias("p"), F.max("q").alias("q"))
    return cell.groupBy("image_id").agg((2 * F.sum(F.col("p") * F.col("q")) / (F.sum("p") + F.sum("q"))).alias("dice"))


def combined(*masks: DataFrame) -> DataFrame:
    """Pixels that lie in all masks: one aggregation, whatever their number."""
    every = masks[0].withColumn("k", F.lit(0))
    for i, m in enumerate(masks[1:], 1):
        every = every.unionByName(m.withColumn("k", F.lit(i)))
    return every.groupBy("image_id", "y", "x").agg(F.countDistinct("k").alias("n")).filter(F.col("n") == len(masks)).select("image_id", "y", "x")
