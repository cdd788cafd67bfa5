"""Weights, edge-aware filters, repairs and mask checks on pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import raster, tiles

KEY = ["image_id", "y", "x"]


def sharpened(r: DataFrame, amount: float = 0.8, sigma: float = 1.2) -> DataFrame:
    """Unsharp mask: the pixel plus ``amount`` times its difference to the blurred image."""
    return raster._beside(r.withColumn("v", F.col("v").cast("double")), raster.gaussian(r, sigma), F.col("v") + amount * (F.col("v") - F.col("o")))


def bilateral(r: DataFrame, half: int = 1, sigma: float = 1.0, spread: float = 50.0) -> DataFrame:
    """Mean of the neighbourhood weighted by distance and by likeness in value."""
    return tiles.bilateral(r, half, sigma, spread)


def difference_weight(r: DataFrame, seeds: DataFrame, cut: float = 0.01) -> DataFrame:
    """1 / (difference to the mean value at seed pixels), at most 1 / cut."""
    mean = r.join(seeds.select(*KEY), KEY, "left_semi").groupBy("image_id").agg(F.avg("v").alias("m"))
    return r.join(mean, "image_id").withColumn("v", 1 / F.greatest(F.abs(F.col("v") - F.col("m")), F.lit(cut))).drop("m")


def gradient_weight(r: DataFrame, power: float = 1.5) -> DataFrame:
    """High where the image is flat: 1 / (1 + gradient / mean gradient) ** power."""
    g = raster.sobel(r).select(*KEY, F.col("v").cast("double").alias("v"))
    mean = g.groupBy("image_id").agg(F.avg("v").alias("m"))
    return g.join(mean, "image_id").withColumn("v", F.pow(1 + F.col("v") / F.col("m"), F.lit(-power))).drop("m")


def edges(r: DataFrame, factor: float = 2.0) -> DataFrame:
    """Pixels whose squared Sobel gradient exceeds ``factor`` squared times the mean square, and peaks across x or y."""
    g = raster.sobel(r).withColumn("s", F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    mean = g.groupBy("image_id").agg(F.avg("s").alias("m"))
    across, down = raster._window(raster.ROW), raster._window(raster.COLUMN)
    top_x = (F.col("s") >= F.coalesce(F.lag("s").over(across), F.lit(0.0))) & (F.col("s") > F.coalesce(F.lead("s").over(across), F.lit(0.0)))
    top_y = (F.col("s") >= F.coalesce(F.lag("s").over(down), F.lit(0.0))) & (F.col("s") > F.coalesce(F.lead("s").over(down), F.lit(0.0)))
    marked = g.withColumn("peak", (top_x & (F.abs("gx") >= F.abs("gy"))) | (top_y & (F.abs("gy") > F.abs("gx"))))
    return marked.join(mean, "image_id").filter((F.col("s") > factor * factor * F.col("m")) & F.col("peak")).select(*KEY)


def repaired(r: DataFrame) -> DataFrame:
    """Missing values (null or NaN) replaced by the mean of their present 3 x 3 neighbours; without any, by 0."""
    plain = r.withColumn("v", F.when(~F.isnan(F.col("v").cast("double")), F.col("v").cast("double")))
    near = tiles.neighbour_mean(plain).withColumnRenamed("v", "m")
    return plain.join(near, KEY).select(*KEY, F.coalesce("v", "m", F.lit(0.0)).alias("v"))


def iterated_median(r: DataFrame, rounds: int = 2) -> DataFrame:
    """Repeated 3 x 3 medians, then one part of the source to two of the result."""
    done = r
    for _ in range(rounds):
        done = raster.median_filter(done, 1)
    return raster._beside(r.withColumn("v", F.col("v").cast("double")), done, (F.col("v") + 2 * F.col("o")) / 3)


def mixed_median(r: DataFrame, rounds: int = 2) -> DataFrame:
    """Rounds of three medians over a rounded square, a square and a diamond; then one part of the source to two of the result."""
    done = tiles.mixed_median(r, rounds)
    return raster._beside(r.withColumn("v", F.col("v").cast("double")), done, (F.col("v") + 2 * F.col("o")) / 3)


def border_cleared(r: DataFrame) -> DataFrame:
    """Grey structures lighter than their surroundings that touch the border taken away: the image less its border's reconstruction."""
    from . import regions

    box = raster.ends(r).join(r.groupBy("image_id").agg(F.max("y").alias("my"), F.max("x").alias("mx")), "image_id")
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("my")) | (F.col("x") == F.col("mx"))
    marked = box.select(*KEY, F.when(edge, F.col("v")).otherwise(F.col("lo")).alias("v"), F.col("v").alias("m"))
    return raster._beside(r, regions.reconstruct_gray(marked), F.col("v") - F.col("o"))


def connected_values(levelled: DataFrame, seed: tuple[int, int], tolerance: float) -> DataFrame:
    """The region of pixels within a tolerance of the seed pixel's value that holds the seed."""
    from . import regions

    start = levelled.filter((F.col("y") == seed[0]) & (F.col("x") == seed[1]))
    near = levelled.join(start.select("image_id", F.col("v").alias("s")), "image_id").filter(F.abs(F.col("v") - F.col("s")) <= tolerance)
    return regions.reconstruct(regions.label(near.select(*KEY)), start)


def fill_is_sound(before: DataFrame, after: DataFrame, pixels: int) -> DataFrame:
    """(image_id, sound): whether filling the holes of an edge mask gave ``after`` and not a leak.

    A fill that changed nothing is sound. Else: the filled mask's perimeter has a Dice likeness of at least 0.5 to the
    edge mask, at most 93 % of the image is filled, both masks have at least 10 pixels, and at least 15 % are filled.
    (Below 15 % the largest region would have to reach 20 % after another fill, which a filled mask cannot.)
    """
    a, b = (m.groupBy("image_id").agg(F.count(F.lit(1)).alias(n)) for m, n in ((before, "a"), (after, "b")))
    alike = raster.dice(raster.perimeter(after), before)
    sound = (F.col("b") == F.col("a")) | ((F.coalesce("dice", F.lit(0.0)) >= 0.5) & (F.col("b") <= 0.93 * pixels) & (F.least("a", "b") >= 10) & (F.col("b") >= 0.15 * pixels))
    return a.join(b, "image_id").join(alike, "image_id", "left").select("image_id", sound.alias("sound"))


def combine_by_area(masks: DataFrame, pixels: int, low: float = 0.67, high: float = 0.93) -> DataFrame:
    """Pixels common to all masks (image_id, mask, y, x) whose share of the image lies between two bounds; if none does, to all masks."""
    area = masks.groupBy("image_id", "mask").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("image_id")
    fit = ((F.col("n") / pixels > low) & (F.col("n") / pixels < high)).cast("int")
    marked = area.withColumn("fit", fit).withColumn("some", F.max("fit").over(every)).filter((F.col("fit") == 1) | (F.col("some") == 0)).withColumn("of", F.count(F.lit(1)).over(every)).select("image_id", "mask", "of")
    return masks.join(marked, ["image_id", "mask"]).groupBy("image_id", "y", "x", "of").agg(F.count(F.lit(1)).alias("k")).filter("k = of").select(*KEY)


def votes(masks: DataFrame, least: int) -> DataFrame:
    """Pixels that at least so many masks (image_id, mask, y, x) hold."""
    return masks.groupBy(*KEY).agg(F.countDistinct("mask").alias("n")).filter(F.col("n") >= least).select(*KEY)


def polygon_mask(extent: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Pixels whose centre lies in a polygon of literal (x, y) vertices."""
    from .points import inside

    return inside(extent.select(*KEY, F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")), ring).select(*KEY)


def moving_median(levelled: DataFrame) -> DataFrame:
    """Median of three neighbouring histogram bins (two at the ends: their mean)."""
    w = Window.partitionBy("image_id").orderBy("bin").rowsBetween(-1, 1)
    return raster.histogram(levelled).withColumn("a", F.array_sort(F.collect_list("n").over(w))).withColumn("m", F.when(F.size("a") == 2, (F.get("a", 0) + F.get("a", 1)) / 2).otherwise(F.get("a", F.floor(F.size("a") / 2).cast("int")).cast("double"))).drop("a")


def aligned(points: DataFrame) -> DataFrame:
    """One-sided padding (per image pair) that brings two sets' mean points together: rows set, pad_x, pad_y."""
    mean = points.groupBy("set").agg(F.avg("px").alias("mx"), F.avg("py").alias("my"))
    top = mean.agg(F.max("mx").alias("tx"), F.max("my").alias("ty"))
    return mean.crossJoin(F.broadcast(top)).select("set", F.round(F.col("tx") - F.col("mx")).cast("long").alias("pad_x"), F.round(F.col("ty") - F.col("my")).cast("long").alias("pad_y"))


def edge_margin(mask: DataFrame, height: int, width: int, least: int) -> DataFrame:
    """Padding (top, bottom, left, right) needed so that a mask lies ``least`` pixels from every edge."""
    box = mask.groupBy("image_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    need = lambda c: F.greatest(F.lit(0), F.lit(least) - c).cast("long")
    return box.select("image_id", need(F.col("y0")).alias("top"), need(height - 1 - F.col("y1")).alias("bottom"), need(F.col("x0")).alias("left"), need(width - 1 - F.col("x1")).alias("right"))


def gated(r: DataFrame, mask: DataFrame, other: DataFrame) -> DataFrame:
    """The image on its mask, and ``other`` (a blurred image, a constant) beside it."""
    both = r.withColumn("v", F.col("v").cast("double")).join(other.select(*KEY, F.col("v").cast("double").alias("o")), KEY)
    return both.join(mask.select(*KEY, F.lit(True).alias("on")), KEY, "left").select(*KEY, F.when(F.col("on"), F.col("v")).otherwise(F.col("o")).alias("v"))


def coverage(mask: DataFrame, covered: DataFrame) -> DataFrame:
    """(image_id, share): how much of a mask is covered; 0 where nothing is."""
    marked = mask.select(*KEY).join(covered.select(*KEY).distinct().withColumn("on", F.lit(1)), KEY, "left")
    return marked.groupBy("image_id").agg((F.coalesce(F.sum("on"), F.lit(0)) / F.count(F.lit(1))).alias("share"))


def rank_votes(rows: DataFrame, columns: list[str], keep: float = 2 / 3) -> DataFrame:
    """(image_id, id, share): in how many of the orderings by each column a row is in the first ``keep`` of its image.

    Equal values are ordered by id; rows in no ordering's first part are left out.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("image_id"))
    ranked = rows.withColumn("n", n).withColumns({f"k_{c}": F.row_number().over(Window.partitionBy("image_id").orderBy(c, "id")) for c in columns})
    votes = sum(((F.col(f"k_{c}") <= F.floor(keep * F.col("n") + 1e-9)).cast("int") for c in columns), F.lit(0))
    return ranked.select("image_id", "id", (votes / len(columns)).alias("share")).filter("share > 0")
