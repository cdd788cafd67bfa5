"""Segmentation pipelines, and kernels that need a whole image (one image a task) or several passes."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enhance, points, raster, regions, tiles

KEY = ["image_id", "y", "x"]


def otsu_cuts(bins: np.ndarray, counts: np.ndarray, cuts: int) -> list[int]:
    """Where to cut sorted bins into cuts + 1 classes with the largest variance between them: a dynamic programme over bins.

    Of equal choices the one with the lowest last cut, then the lowest before it; no cut if there are too few bins.
    """
    n = len(bins)
    if n <= cuts:
        return []
    cn, cs = np.r_[0, counts.cumsum()], np.r_[0, (counts * bins).cumsum()]
    i, j = np.triu_indices(n + 1, 1)
    part = np.full((n + 1, n + 1), -np.inf)
    part[i, j] = (cs[j] - cs[i]) ** 2 / (cn[j] - cn[i])
    value, came = part[0].copy(), []
    for _ in range(cuts):
        total = value[:, None] + part
        came.append(total.argmax(axis=0))
        value = total.max(axis=0)
    out, at = [], n
    for back in reversed(came):
        at = int(back[at])
        out.append(at)
    return out[::-1]


def multi_otsu(levelled: DataFrame, cuts: int = 2) -> DataFrame:
    """(image_id, k, threshold): the cuts of the histogram with the largest variance between classes."""

    def best(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("bin")
        edges = otsu_cuts(g.bin.to_numpy(float), g.n.to_numpy(float), cuts)
        return pd.DataFrame({"image_id": [g.image_id.iloc[0]] * len(edges), "k": range(len(edges)), "threshold": [int(g.bin.iloc[e - 1]) for e in edges]})

    return raster.histogram(levelled).groupBy("image_id").applyInPandas(best, "image_id string, k int, threshold long")


def hysteresis(levelled: DataFrame, low: int, high: int) -> DataFrame:
    """Regions above ``low`` that hold a pixel above ``high``."""
    weak = levelled.filter(F.col("v") > low).select("image_id", "y", "x")
    return regions.reconstruct(regions.label(weak), levelled.filter(F.col("v") > high))


def by_derivatives(r: DataFrame, height: int, width: int) -> DataFrame:
    """Votes of four derivative masks; more than 0.4 of them, holes filled, the largest region kept."""
    votes = None
    for along in ("x", "y", "xx", "yy"):
        d = raster.levels(raster.derivative(r, along).withColumn("v", F.abs("v")))
        m = raster.binarize(d, raster.otsu(d))
        votes = m if votes is None else votes.unionByName(m)
    some = votes.groupBy("image_id", "y", "x").count().filter(F.col("count") / 4 > 0.4).select("image_id", "y", "x")
    return regions.largest(regions.label(regions.fill_holes(some, r, height, width)))


def hysteresis_from_histogram(levelled: DataFrame, off: int = 2000, close: int = 9) -> DataFrame:
    """Regions of a generous threshold that hold the largest extended maximum of the image without its border's structures, closed by a disk.

    The threshold is 0.9 of the histogram minimum nearest the Otsu level; where fewer than ``off`` pixels lie at or below
    that, 0.95 of it, and then the minimum itself.
    """
    from . import kernels

    base = raster.minimum_near_otsu(levelled)
    shares = levelled.join(base, "image_id").groupBy("image_id", "threshold").agg(*[F.sum((F.col("v") <= k * F.col("threshold")).cast("int")).alias(n) for n, k in (("a", 0.9), ("b", 0.95))])
    cut = shares.select("image_id", (F.col("threshold") * F.when(F.col("a") >= off, 0.9).when(F.col("b") >= off, 0.95).otherwise(1.0)).alias("threshold"))
    generous = regions.shared_copy(raster.binarize(levelled, cut))
    bright = regions.shared_copy(raster.adjust(enhance.border_cleared(levelled.withColumn("v", F.col("v").cast("double")))))
    seeds = regions.largest(regions.label(kernels.extended_maxima(bright, 0.5).filter("v > 0").select(*KEY)))
    kept = regions.reconstruct(regions.label(generous), seeds)
    ones = levelled.select(*KEY).join(kept.select(*KEY, F.lit(1.0).alias("v")), KEY, "left").fillna(0.0, ["v"])
    return tiles.closed(ones, "disk", close).filter("v > 0").select(*KEY)


def colour_features(rgb: DataFrame) -> DataFrame:
    """Twelve features of each pixel (image_id, y, x, f0 .. f11), each of three channels: the sharpened channel, its local entropy
    and deviation over 9 x 9 pixels (scaled together), and the 7 x 7 median of the brightened entropy.
    """
    from . import kernels

    out = None

    def put(df: DataFrame, k: int) -> None:
        nonlocal out
        one = df.select(*KEY, F.lit(k).alias("k"), F.col("v").cast("double").alias("v"))
        out = one if out is None else out.unionByName(one)

    for k, c in enumerate("rgb"):
        plain = rgb.select(*KEY, F.col(c).alias("v"))
        disorder = regions.shared_copy(raster.local_entropy(raster.levels(plain), 4))
        put(raster.filter_kernel(plain, [[0, -1, 0], [-1, 5, -1], [0, -1, 0]], "symmetric"), k)
        put(disorder, 3 + k)
        put(raster.local_std(plain, 4), 6 + k)
        put(raster.median_filter(kernels.brightened(disorder), 3), 9 + k)
    group = F.floor(F.col("k") / 3)
    ends = out.filter("k between 3 and 8").groupBy("image_id", group.alias("g")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = out.withColumn("g", group).join(ends, ["image_id", "g"], "left")
    value = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("v"))
    return scaled.withColumn("v", value).groupBy(*KEY).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"f{k}") for k in range(12)])


def two_means(rgb: DataFrame, height: int, width: int, seed: int = 1) -> DataFrame:
    """Two clusters of ``colour_features``; ground is the commoner one in rows 1 to 7, columns 1 to 4; the rest with its holes filled."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    features = regions.shared_copy(colour_features(rgb))
    vectors = VectorAssembler(inputCols=[f"f{k}" for k in range(12)], outputCol="features").transform(features)
    got = KMeans(k=2, tol=1e-3, seed=seed).fit(vectors).transform(vectors).select(*KEY, "prediction")
    corner = got.filter("y between 1 and 7 and x between 1 and 4").groupBy("image_id").agg((F.avg("prediction") > 0.5).cast("int").alias("ground"))
    front = regions.shared_copy(got.join(corner, "image_id").filter("prediction != ground").select(*KEY))
    return regions.fill_holes(front, features.select(*KEY), height, width)


def _grid(group: pd.DataFrame) -> np.ndarray:
    out = np.zeros((group.y.max() + 1, group.x.max() + 1))
    out[group.y, group.x] = group.v
    return out


def geodesic(r: DataFrame, seeds: list[tuple[int, int]]) -> DataFrame:
    """Least sum of value differences (plus a small step cost) from seeds, along 4-neighbours; one image a task."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        v = _grid(group)
        cost, heap = np.full(v.shape, np.inf), []
        for y, x in seeds:
            cost[y, x] = 0
            heap.append((0.0, y, x))
        heapq.heapify(heap)
        while heap:
            c, y, x = heapq.heappop(heap)
            if c > cost[y, x]:
                continue
            for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= a < v.shape[0] and 0 <= b < v.shape[1]:
                    d = c + abs(v[a, b] - v[y, x]) + 0.01
                    if d < cost[a, b]:
                        cost[a, b] = d
                        heapq.heappush(heap, (d, a, b))
        return pd.DataFrame({"image_id": group.image_id, "y": group.y, "x": group.x, "cost": cost[group.y, group.x]})

    return r.groupBy("image_id").applyInPandas(walk, "image_id string, y long, x long, cost double")


def two_region_contour(r: DataFrame, start: DataFrame, rounds: int = 15) -> DataFrame:
    """A region contour: each round, pixels go to the nearer of the two regions' means, smoothed by their neighbours."""

    def evolve(group: pd.DataFrame) -> pd.DataFrame:
        v = _grid(group)
        inside = np.zeros(v.shape, bool)
        chosen = group[group.inside > 0]
        inside[chosen.y, chosen.x] = True
        for _ in range(rounds):
            if inside.all() or not inside.any():
                break
            pull = (v - v[~inside].mean()) ** 2 - (v - v[inside].mean()) ** 2
            p = np.pad(inside.astype(float), 1, mode="edge")
            near = sum(p[1 + a : 1 + a + v.shape[0], 1 + b : 1 + b + v.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9
            fresh = pull / (np.abs(pull).max() + 1e-12) + 2 * (near - 0.5) > 0
            if (fresh == inside).all():
                break
            inside = fresh
        y, x = np.nonzero(inside)
        return pd.DataFrame({"image_id": [group.image_id.iloc[0]] * len(y), "y": y, "x": x})

    marked = r.join(start.withColumn("inside", F.lit(1)), ["image_id", "y", "x"], "left").fillna({"inside": 0})
    return marked.groupBy("image_id").applyInPandas(evolve, "image_id string, y long, x long")


def diffused(r: DataFrame, rounds: int = 5, conduct: float = 30.0) -> DataFrame:
    """Edge-preserving diffusion: each round adds a quarter of the damped differences to the four neighbours."""
    r = r.withColumn("v", F.col("v").cast("double"))
    for _ in range(rounds):
        parts = []
        for axis in (raster.ROW, raster.COLUMN):
            w = raster._window(axis)
            for side in (F.lag("v").over(w), F.lead("v").over(w)):
                d = F.coalesce(side - F.col("v"), F.lit(0.0))
                parts.append(d * F.exp(-(d * d) / (conduct * conduct)))
        r = r.withColumn("v", F.col("v") + 0.25 * sum(parts[1:], parts[0]))
    return r


def ica(rgb: DataFrame) -> DataFrame:
    """(part, weight r, g, b): the mixing matrix of three independent sources, signs and order fixed; one task an image."""

    def unmix(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["y", "x"])
        _, mixing = points.fast_ica(g[["r", "g", "b"]].to_numpy())
        a = mixing.T * np.sign(mixing.T[np.arange(3), np.abs(mixing.T).argmax(axis=1)])[:, None]
        a = a[np.lexsort(a.T[::-1])]
        return pd.DataFrame({"part": range(3), "r": a[:, 0].round(4), "g": a[:, 1].round(4), "b": a[:, 2].round(4)})

    return rgb.groupBy("image_id").applyInPandas(unmix, "part int, r double, g double, b double")
