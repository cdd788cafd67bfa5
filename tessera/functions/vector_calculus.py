"""The default segmenter: four edge masks from derivatives of the equalised lightness vote, and the largest filled region stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import enhance, raster, regions, tiles
from . import kernels, segment

KEY = ["image_id", "y", "x"]


def lightness(rgb: DataFrame) -> DataFrame:
    """L* of the colour image, min-max scaled and equalised."""
    light = raster.lab(rgb).select(*KEY, F.col("l").alias("v"))
    return raster.equalized(raster.levels(light))


def _taps(column: str, taps: list[float], axis: tuple[str, str, str]) -> Column:
    w, half = raster._window(axis), len(taps) // 2
    parts = [k * (F.lead(column, i - half, 0.0).over(w) if i > half else F.lag(column, half - i, 0.0).over(w) if i < half else F.col(column)) for i, k in enumerate(taps) if k]
    return sum(parts[1:], parts[0])


def gradient_direction_derivative(r: DataFrame) -> DataFrame:
    """Second derivative in the gradient direction: (dxx dx^2 + dyy dy^2 + 2 dxy dx dy) / (dx^2 + dy^2), 0 where the image is flat.

    All five 7-tap derivatives come from two window passes, one by row and one by column.
    """
    r = r.withColumn("v", F.col("v").cast("double"))
    r = r.withColumns({n: _taps("v", t, raster.ROW) for n, t in (("s", raster.SMOOTH7), ("f", raster.FIRST7), ("g", raster.SECOND7))})
    pairs = {"dx": ("f", raster.SMOOTH7), "dy": ("s", raster.FIRST7), "dxx": ("g", raster.SMOOTH7), "dyy": ("s", raster.SECOND7), "dxy": ("f", raster.FIRST7)}
    r = r.withColumns({n: _taps(c, t, raster.COLUMN) for n, (c, t) in pairs.items()})
    dx, dy, dxx, dyy, dxy = (F.col(c) for c in pairs)
    steep = dx * dx + dy * dy
    return r.select(*KEY, F.when(steep > 0, (dxx * dx * dx + dyy * dy * dy + 2 * dxy * dx * dy) / steep).otherwise(0.0).alias("v"))


def above_otsu(r: DataFrame, factor: float) -> DataFrame:
    """Pixels above ``factor`` times the Otsu level of the image's 256 levels."""
    levels = raster.levels(r)
    return raster.binarize(levels, raster.otsu(levels).withColumn("threshold", F.col("threshold") * factor))


def above_cut(r: DataFrame, cuts: int, k: int) -> DataFrame:
    """Pixels above the k-th (from 0) of the Otsu cuts of the image's levels."""
    levels = raster.levels(r)
    return raster.binarize(levels, segment.multi_otsu(levels, cuts).filter(F.col("k") == k).select("image_id", "threshold"))


def filled_if_sound(mask: DataFrame, extent: DataFrame, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The mask with its holes filled in those images where that passes ``fill_is_sound``; and (image_id, sound)."""
    mask = regions.shared_copy(mask)
    full = regions.shared_copy(regions.fill_holes(mask, extent, height, width))
    sound = enhance.fill_is_sound(mask, full, height * width)
    good = sound.filter("sound").select("image_id")
    return full.join(good, "image_id", "left_semi").unionByName(mask.join(good, "image_id", "left_anti")), sound


def variance_edges(gray: DataFrame, height: int, width: int) -> DataFrame:
    """Edges of the gradient-direction derivative that lie in regions of high local variance; the largest, thinned and filled."""
    spread = raster.median_filter(raster.local_std(gray, 3).fillna(0.0, ["v"]))
    strong = above_cut(raster.adjust(kernels.h_minima(spread, 0.15)), 5, 2)
    steep = regions.shared_copy(tiles.ranked(gradient_direction_derivative(gray), 9, tiles.footprint("square", 1)))
    sharp = regions.shared_copy(raster.rescale(raster.adjust(steep)))
    edges = enhance.edges(raster.closed(sharp))
    labels = regions.label(strong)
    line = regions.thinned(regions.largest(regions.label(regions.reconstruct(labels, edges))))
    out, sound = filled_if_sound(line, gray, height, width)
    out = regions.shared_copy(out)
    # a filled mask of less than half the image: only the region of the pixel at the skeleton's middle stays
    small = out.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < 0.5 * height * width).join(sound.filter("sound"), "image_id", "left_semi").select("image_id")
    few = regions.shared_copy(out.join(small, "image_id", "left_semi"))
    if few.isEmpty():
        return out
    middle = regions.thinned(few).groupBy("image_id").agg(F.round(F.avg("y")).cast("long").alias("y"), F.round(F.avg("x")).cast("long").alias("x"))
    value = gray.select(*KEY).join(few.select(*KEY, F.lit(1.0).alias("v")), KEY, "left").fillna(0.0, ["v"]).join(small, "image_id", "left_semi")
    at = value.join(middle, KEY, "left_semi").select("image_id", F.col("v").alias("s"))
    alike = value.join(at, "image_id").filter("v = s")
    whole = regions.reconstruct(regions.label(alike.select(*KEY)), middle)
    return out.join(small, "image_id", "left_anti").unionByName(whole)


def fractional_edges(gray: DataFrame, order: float = 2.6) -> DataFrame:
    """Otsu mask (times 1.2) of the complement of the equalised, median-filtered fractional derivative."""
    return above_otsu(raster.complement(raster.equalized(raster.levels(raster.median_filter(raster.fractional_derivative(gray, order))))), 1.2)


def fractional_details(gray: DataFrame, order: float = 0.6) -> DataFrame:
    """As ``fractional_edges``, with local detail enhanced in place of the median."""
    return above_otsu(raster.complement(raster.equalized(raster.levels(kernels.detail_enhanced(raster.fractional_derivative(gray, order), 0.3, 0.3)))), 1.2)


def gradient_edges(gray: DataFrame, height: int, width: int) -> DataFrame:
    """Largest region above 0.95 Otsu of the median-filtered Sobel magnitude of the brightened image, filled if that is sound."""
    steep = raster.sobel(kernels.brightened(gray)).select(*KEY, "v")
    return filled_if_sound(regions.largest(regions.label(above_otsu(raster.median_filter(steep, 2), 0.95))), gray, height, width)[0]


def segment_vector_calculus(rgb: DataFrame, height: int, width: int) -> DataFrame:
    """The largest region, holes filled, of pixels whose votes from the four masks, min-max scaled, exceed 0.4."""
    gray = regions.shared_copy(lightness(rgb))
    masks = [variance_edges(gray, height, width), fractional_details(gray), fractional_edges(gray), gradient_edges(gray, height, width)]
    cast = None
    for k, m in enumerate(masks):
        one = m.select(*KEY, F.lit(k).alias("mask"))
        cast = one if cast is None else cast.unionByName(one)
    votes = cast.groupBy(*KEY).agg(F.countDistinct("mask").alias("v"))
    votes = gray.select(*KEY).join(votes, KEY, "left").fillna(0, ["v"])
    some = regions.shared_copy(raster.rescale(votes).filter("v > 0.4").select(*KEY))
    return regions.largest(regions.label(regions.fill_holes(some, gray, height, width)))
