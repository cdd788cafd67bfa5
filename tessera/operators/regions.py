"""Connected regions of masks: labels by tile with seams merged, and what is built on labels."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TILE, ROWS = 1024, 32
STRIDE = 1 << 31  # linear index of a pixel: x * STRIDE + y, column by column


def shared_copy(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back (spark.checkpoint.dir; a temporary folder only where it is unset)."""
    spark: SparkSession = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import re
        import tempfile

        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/tessera-raster/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete what ``shared_copy`` wrote for this application, once its results have been read or stored."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/tessera-raster/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def label_grid(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Labels of a small dense mask by union-find over runs of columns; 0 is background."""
    h, w = mask.shape
    run = np.zeros(mask.shape, np.int64)
    root = [0]
    before: list[tuple[int, int, int]] = []
    for x in range(w):
        column = np.r_[False, mask[:, x], False].astype(np.int8)
        starts, stops = np.flatnonzero(np.diff(column) == 1), np.flatnonzero(np.diff(column) == -1)
        now, first = [], 0
        for a, b in zip(starts, stops, strict=True):
            k = len(root)
            root.append(k)
            while first < len(before) and (before[first][1] < a if eight else before[first][1] <= a):
                first += 1  # runs lie in order: one that ends too early for this one does so for all after it
            for i in range(first, len(before)):
                c, _, j = before[i]
                if (c > b) if eight else (c >= b):
                    break
                p, q = _find(root, j), _find(root, k)
                root[max(p, q)] = min(p, q)
            run[a:b, x] = k
            now.append((a, b, k))
        before = now
    top = np.array([_find(root, i) for i in range(len(root))])
    return top[run]


def label(mask: DataFrame, eight: bool = True, tile: int = TILE) -> DataFrame:
    """(image_id, y, x, label): label is the least linear index x * STRIDE + y of the pixel's region.

    Each tile is labelled in one task; only pixels on tile seams make edges between tile labels, and those are merged by
    repeated least-neighbour steps, each written to the shared folder. So no image has to fit into a task.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = group.y.min(), group.x.min()
        grid = np.zeros((group.y.max() - y0 + 1, group.x.max() - x0 + 1), bool)
        grid[group.y - y0, group.x - x0] = True
        got = label_grid(grid, eight)[group.y - y0, group.x - x0]
        key = group.x.to_numpy().astype(np.int64) * STRIDE + group.y.to_numpy()
        least = pd.Series(key).groupby(got).transform("min").to_numpy()
        return pd.DataFrame({"image_id": group.image_id, "y": group.y, "x": group.x, "local": least})

    tiles = mask.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    local = shared_copy(tiles.groupBy("image_id", "ty", "tx").applyInPandas(one, "image_id string, y long, x long, local long"))
    seam = local.filter((F.col("y") % tile == 0) | (F.col("x") % tile == 0) | (F.col("y") % tile == tile - 1) | (F.col("x") % tile == tile - 1))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    near = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("dy"), F.lit(b).cast("long").alias("dx")) for a, b in steps]))
    moved = seam.withColumn("d", near).select("image_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), F.col("local").alias("a"))
    edges = moved.join(seam.withColumnRenamed("local", "b"), ["image_id", "y", "x"]).filter("a != b").select("image_id", "a", "b").distinct()
    edges = shared_copy(edges.unionByName(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if edges.isEmpty():  # no region crosses a seam
        return local.select("image_id", "y", "x", F.col("local").alias("label"))
    names = shared_copy(edges.select("image_id", "a").distinct().withColumn("l", F.col("a")))
    while True:
        best = edges.join(names.withColumnRenamed("a", "b").withColumnRenamed("l", "m"), ["image_id", "b"]).groupBy("image_id", "a").agg(F.min("m").alias("m"))
        stepped = names.join(best, ["image_id", "a"], "left").select("image_id", "a", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = stepped.join(stepped.select("image_id", F.col("a").alias("l"), F.col("l").alias("j")), ["image_id", "l"], "left")
        fresh = shared_copy(jump.select("image_id", "a", "old", F.least("l", F.coalesce("j", "l")).alias("l")))
        names = fresh.select("image_id", "a", "l")
        if fresh.filter("l != old").isEmpty():
            break
    return local.join(names.select("image_id", F.col("a").alias("local"), "l"), ["image_id", "local"], "left").select("image_id", "y", "x", F.coalesce("l", "local").alias("label"))


def properties(labels: DataFrame) -> DataFrame:
    """Area, centroid and bounds of every region."""
    return labels.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def _chosen(labels: DataFrame, keep: DataFrame) -> DataFrame:
    return labels.join(keep.select("image_id", "label"), ["image_id", "label"], "left_semi").select("image_id", "y", "x")


def area_open(labels: DataFrame, least: int) -> DataFrame:
    """Pixels of regions of at least an area."""
    return _chosen(labels, labels.groupBy("image_id", "label").count().filter(F.col("count") >= least))


def largest(labels: DataFrame, n: int = 1) -> DataFrame:
    """Pixels of each image's n largest regions; of equals the one with the least label."""
    w = Window.partitionBy("image_id").orderBy(F.desc("count"), "label")
    return _chosen(labels, labels.groupBy("image_id", "label").count().withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n))


def clear_border(labels: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels of regions that do not touch the image's border."""
    touch = labels.filter((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)).select("image_id", "label").distinct()
    return labels.join(touch, ["image_id", "label"], "left_anti").select("image_id", "y", "x")


def reconstruct(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pixels of regions that hold a seed pixel: binary reconstruction, and flood fill from seeds."""
    hit = labels.join(seeds.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi")
    return _chosen(labels, hit.select("image_id", "label").distinct())


def fill_holes(mask: DataFrame, extent: DataFrame, height: int, width: int) -> DataFrame:
    """The mask with background regions (4-connected) that miss the border filled; ``extent``: all pixels."""
    outside = extent.select("image_id", "y", "x").join(mask, ["image_id", "y", "x"], "left_anti")
    holes = clear_border(label(outside, eight=False), height, width)
    return mask.select("image_id", "y", "x").unionByName(holes)


def cleaned(labels: DataFrame, reach: float = 250, least: int = 10_000) -> DataFrame:
    """Regions of at least ``least`` pixels with a pixel at most ``reach`` from the largest region, and that one.

    An image whose largest region is smaller than ``least`` is left as it is. Distances come from the two passes of
    ``distance_to``, so work does not grow with the reach.
    """
    main = largest(labels)
    sizes = labels.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area"))
    top = F.max("area").over(Window.partitionBy("image_id"))
    sizes = sizes.withColumn("top", top)
    big = labels.join(sizes.filter(F.col("area") >= least).select("image_id", "label"), ["image_id", "label"], "left_semi")
    near = distance_to(big, main).filter(F.col("distance") <= reach).select("image_id", "y", "x")
    small = sizes.filter(F.col("top") < least).select("image_id", "label")
    return reconstruct(big, near).unionByName(_chosen(labels, small))


def regional_maxima(r: DataFrame, tile: int = TILE) -> DataFrame:
    """Pixels of the plateaus (8-connected, of one value) that no pixel beside them exceeds.

    Pixels without a greater neighbour form the candidates; touching candidates have one value. A region of them is
    dropped when one of its pixels lies beside an equal pixel that has a greater neighbour.
    """
    from .raster import dilate

    key = ["image_id", "y", "x"]
    top = r.join(dilate(r, 1).withColumnRenamed("v", "m"), key)
    beside = dilate(top.select(*key, F.when(F.col("v") < F.col("m"), F.col("v")).alias("v")), 1).withColumnRenamed("v", "low")
    marked = top.filter("v = m").join(beside, key).select(*key, F.coalesce(F.col("low") == F.col("v"), F.lit(False)).alias("open"))
    labels = label(marked.select(*key), tile=tile)
    gone = labels.join(marked.filter("open").select(*key), key, "left_semi").select("image_id", "label").distinct()
    return labels.join(gone, ["image_id", "label"], "left_anti").select(*key)


def grown_under(marker: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Grey reconstruction of one array: the marker grown under the mask (8-connected) until nothing changes; NaN stays out."""
    now = np.fmin(marker, mask)
    while True:
        p = np.pad(now, 1, constant_values=np.nan)
        wide = now
        for a in range(3):
            for b in range(3):
                wide = np.fmax(wide, p[a : a + now.shape[0], b : b + now.shape[1]])
        fresh = np.where(np.isnan(mask), np.nan, np.fmin(wide, mask))
        if np.array_equal(fresh, now, equal_nan=True):
            return now
        now = fresh


def reconstruct_gray(both: DataFrame, tile: int = 256) -> DataFrame:
    """Grey reconstruction: marker ``v`` grown under mask ``m`` (image_id, y, x, v, m), tile by tile until no tile changes.

    Each round every tile with a halo of one pixel grows its marker as far as it goes and is written to the shared
    folder; so rounds are as many as tiles on a path, and no image has to fit into a task.
    """
    def one(group: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(group.ty.iloc[0]), int(group.tx.iloc[0])
        y0, x0 = ty * tile - 1, tx * tile - 1
        y, x = group.y.to_numpy() - y0, group.x.to_numpy() - x0
        v, m = (np.full((tile + 2, tile + 2), np.nan) for _ in range(2))
        v[y, x], m[y, x] = group.v, group.m
        grown = grown_under(v, m)[y, x]
        own = (y >= 1) & (y <= tile) & (x >= 1) & (x <= tile)
        return pd.DataFrame({"image_id": group.image_id, "y": group.y, "x": group.x, "v": grown, "m": group.m, "changed": (grown != group.v).astype(int)})[own]

    now = both.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"), F.col("m").cast("double").alias("m"))
    now = now.withColumn("v", F.least("v", "m"))
    while True:
        part = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile) for d in (-1, 0, 1)])))
        sent = now.withColumn("ty", part("y")).withColumn("tx", part("x")).filter("ty >= 0 and tx >= 0")
        fresh = shared_copy(sent.groupBy("image_id", "ty", "tx").applyInPandas(one, "image_id string, y long, x long, v double, m double, changed int"))
        now = fresh.drop("changed")
        if not fresh.agg(F.max("changed")).first()[0]:
            return now.select("image_id", "y", "x", "v")


def thinned(mask: DataFrame, tile: int = 256, steps: int = 8) -> DataFrame:
    """One-pixel lines: border pixels taken away in two alternating passes while connections hold.

    Tiles with a halo of two pixels a step take so many steps a round; rounds go on until no pixel goes. All tiles
    step together, so the result does not depend on them.
    """
    halo = 2 * steps

    def one(group: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(group.ty.iloc[0]) * tile - halo, int(group.tx.iloc[0]) * tile - halo
        y, x = group.y.to_numpy() - y0, group.x.to_numpy() - x0
        m = np.zeros((tile + 2 * halo + 2,) * 2, bool)
        m[y + 1, x + 1] = True
        for _ in range(steps):
            if not thin_once(m):
                break
        own = (y >= halo) & (y < halo + tile) & (x >= halo) & (x < halo + tile)
        return pd.DataFrame({"image_id": group.image_id, "y": group.y, "x": group.x, "kept": m[y + 1, x + 1]})[own]

    now = mask.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    while True:
        part = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile) for d in (-halo, 0, halo)])))
        sent = now.withColumn("ty", part("y")).withColumn("tx", part("x"))
        fresh = shared_copy(sent.groupBy("image_id", "ty", "tx").applyInPandas(one, "image_id string, y long, x long, kept boolean"))
        now = fresh.filter("kept").drop("kept")
        if fresh.filter("not kept").isEmpty():
            return now


def thin_once(m: np.ndarray) -> bool:
    """One step (both passes) on a mask with an empty frame, in place; whether a pixel went."""
    changed = False
    for first in (True, False):
        n = [m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]]
        near = sum(k.astype(int) for k in n)
        turns = sum((~n[i] & n[(i + 1) % 8]).astype(int) for i in range(8))
        a, b = (n[0] & n[2] & n[4], n[2] & n[4] & n[6]) if first else (n[0] & n[2] & n[6], n[0] & n[4] & n[6])
        gone = m[1:-1, 1:-1] & (near >= 2) & (near <= 6) & (turns == 1) & ~a & ~b
        if gone.any():
            m[1:-1, 1:-1] &= ~gone
            changed = True
    return changed


def lower_envelope(at: np.ndarray, height: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """The least of (x - at)^2 + height over all parabolas at each asked x, in one pass over the sorted ``at``."""
    if not len(at):
        return np.full(len(ask), np.nan)
    keep, start = [0], [-np.inf]
    for q in range(1, len(at)):
        while True:
            p = keep[-1]
            cut = ((height[q] + at[q] ** 2) - (height[p] + at[p] ** 2)) / (2 * (at[q] - at[p]))
            if cut > start[-1]:
                break
            keep.pop()
            start.pop()
        keep.append(q)
        start.append(cut)
    who = np.array(keep)[np.searchsorted(np.array(start), ask, "right") - 1]
    return (ask - at[who]) ** 2 + height[who]


def distance_grid(mask: np.ndarray) -> np.ndarray:
    """Distance of every pixel of an array to the nearest one off the mask: a pass down each column, an envelope along each row."""
    h, w = mask.shape
    y = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(mask, -np.inf, y), axis=0)
    down = np.minimum.accumulate(np.where(mask, np.inf, y)[::-1], axis=0)[::-1]
    g = np.minimum(y - up, down - y) ** 2
    out = np.full((h, w), np.inf)
    for k in range(h):
        known = np.flatnonzero(np.isfinite(g[k]))
        if len(known):
            out[k] = lower_envelope(known.astype(float), g[k, known], np.arange(w, dtype=float))
    return np.sqrt(out)


def buffered(mask: DataFrame, extent: DataFrame, distance: float) -> DataFrame:
    """Pixels of the image at most ``distance`` from the mask."""
    outside = extent.select("image_id", "y", "x").join(mask.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_anti")
    near = distance_to(outside, mask).filter(F.col("distance") <= distance).select("image_id", "y", "x")
    return mask.select("image_id", "y", "x").unionByName(near)


def distance_to(mask: DataFrame, targets: DataFrame) -> DataFrame:
    """Exact Euclidean distance of each mask pixel to the nearest target pixel, by one pass per axis over rows.

    First the nearest target in the pixel's own column, by two window passes; then the least over the pixel's row, ``ROWS`` rows a task's group.
    """
    def near(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "x"])
        ask, known = group[group.ask], group[~group.ask & group.g.notna()]
        out, spots, places, heights = np.empty(len(ask)), ask.x.to_numpy(float), known.x.to_numpy(float), known.g.to_numpy(float) ** 2
        row, of = ask.y.to_numpy(), known.y.to_numpy()
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
        for a, b in zip(start, [*start[1:], len(row)], strict=True):
            c, d = np.searchsorted(of, row[a]), np.searchsorted(of, row[a], "right")
            out[a:b] = lower_envelope(places[c:d], heights[c:d], spots[a:b])
        return pd.DataFrame({"image_id": ask.image_id, "y": ask.y, "x": ask.x, "distance": np.sqrt(out)})

    both = mask.select("image_id", "y", "x").withColumn("ask", F.lit(True)).unionByName(targets.select("image_id", "y", "x").withColumn("ask", F.lit(False)))
    box = both.groupBy("image_id").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    columns = targets.select("image_id", "x").distinct().join(box, "image_id").withColumn("y", F.explode(F.sequence("a", "b"))).select("image_id", "y", "x")
    marks = columns.join(targets.select("image_id", "y", "x", F.col("y").alias("t")), ["image_id", "y", "x"], "left")
    w = Window.partitionBy("image_id", "x").orderBy("y")
    back = Window.partitionBy("image_id", "x").orderBy(F.desc("y"))  # a frame that ends with the column would be read anew for every pixel
    up, down = F.last("t", True).over(w), F.last("t", True).over(back)
    g = marks.withColumn("g", F.least(F.abs(F.col("y") - up), F.abs(F.col("y") - down)).cast("double")).select("image_id", "y", "x", "g", F.lit(False).alias("ask"))
    rows = g.unionByName(mask.select("image_id", "y", "x", F.lit(None).cast("double").alias("g"), F.lit(True).alias("ask")))
    return rows.groupBy("image_id", F.floor(F.col("y") / ROWS)).applyInPandas(near, "image_id string, y long, x long, distance double")
