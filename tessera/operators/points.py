"""Point sets, polygons, registration geometry and regions of interest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedupe(points: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows by keys, the one of the least seq staying (stable unique)."""
    w = Window.partitionBy(*keys).orderBy("seq")
    return points.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose numbers are all finite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.filter(ok)


def polygon_area(points: DataFrame) -> DataFrame:
    """Shoelace area of each closed ring (set, seq, px, py)."""
    w = Window.partitionBy("set").orderBy("seq")
    first = Window.partitionBy("set").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx = F.coalesce(F.lead("px").over(w), F.first("px").over(first))
    ny = F.coalesce(F.lead("py").over(w), F.first("py").over(first))
    return points.withColumn("t", F.col("px") * ny - nx * F.col("py")).groupBy("set").agg((F.abs(F.sum("t")) / 2).alias("area"))


def path_length(points: DataFrame) -> DataFrame:
    """Arc length along each polyline up to every vertex."""
    w = Window.partitionBy("set").orderBy("seq")
    step = F.coalesce(F.hypot(F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w)), F.lit(0.0))
    return points.withColumn("step", step).withColumn("s", F.sum("step").over(w)).drop("step")


def densified(points: DataFrame, most: float) -> DataFrame:
    """Polylines with evenly spaced vertices put in, so that no step is longer than ``most``; (set, seq, part, px, py)."""
    w = Window.partitionBy("set").orderBy("seq")
    seg = points.withColumn("qx", F.lead("px").over(w)).withColumn("qy", F.lead("py").over(w))
    n = F.coalesce(F.greatest(F.lit(1), F.ceil(F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")) / most)), F.lit(1)).cast("int")
    cut = seg.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = F.col("part") / F.col("n")
    return cut.select("set", "seq", "part", (F.col("px") + at * (F.coalesce("qx", "px") - F.col("px"))).alias("px"), (F.col("py") + at * (F.coalesce("qy", "py") - F.col("py"))).alias("py"))


def simplified(points: DataFrame, least: float) -> DataFrame:
    """Vertices without those collinear with their neighbours or nearer than ``least`` to the one before."""
    w = Window.partitionBy("set").orderBy("seq")
    ax, ay, bx, by = F.lag("px").over(w), F.lag("py").over(w), F.lead("px").over(w), F.lead("py").over(w)
    turn = (F.col("px") - ax) * (by - ay) - (F.col("py") - ay) * (bx - ax)
    return points.withColumn("turn", turn).withColumn("gap", F.hypot(F.col("px") - ax, F.col("py") - ay)).filter((F.col("turn").isNull() | (F.abs("turn") > 1e-9)) & (F.col("gap").isNull() | (F.col("gap") >= least))).drop("turn", "gap")


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull vertices, counter-clockwise from the leftmost; points on an edge are left out."""
    p = sorted(set(points))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(q):
        out = []
        for v in q:
            while len(out) > 1 and turn(out[-2], out[-1], v) <= 0:
                out.pop()
            out.append(v)
        return out

    return p if len(p) < 3 else half(p)[:-1] + half(p[::-1])[:-1]


def convex_hull(points: DataFrame, blocks: int = 256) -> DataFrame:
    """Hull vertices of each set, counter-clockwise from the leftmost (set, seq, px, py).

    A set's points are dealt into ``blocks`` by a hash; only the hulls of those go to the task that closes the set's.
    """
    def chain(group: pd.DataFrame) -> pd.DataFrame:
        ring = hull_of(list(zip(group.px, group.py, strict=True)))
        return pd.DataFrame({"set": [group["set"].iloc[0]] * len(ring), "seq": range(len(ring)), "px": [float(a) for a, _ in ring], "py": [float(b) for _, b in ring]})

    schema = "set string, seq long, px double, py double"
    dealt = points.select("set", "px", "py", F.pmod(F.xxhash64("px", "py"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("set", "block").applyInPandas(chain, schema).groupBy("set").applyInPandas(chain, schema)


def inside(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Points strictly within a polygon of literal vertices, by counting crossings."""
    crossings: Column = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if ay != by:
            across = ((F.lit(ay) > F.col("py")) != (F.lit(by) > F.col("py"))) & (F.col("px") < (bx - ax) * (F.col("py") - ay) / (by - ay) + ax)
            crossings = crossings + across.cast("int")
    return points.filter(crossings % 2 == 1)


def corners(points: DataFrame) -> DataFrame:
    """For each of the four corners of a set's bounds, the nearest point (of equals the least seq)."""
    box = points.groupBy("set").agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    spots = F.array(*[F.struct(F.lit(n).alias("corner"), F.col(a).alias("qx"), F.col(b).alias("qy")) for n, a, b in (("tl", "x0", "y0"), ("tr", "x1", "y0"), ("br", "x1", "y1"), ("bl", "x0", "y1"))])
    wide = points.join(box, "set").withColumn("c", F.explode(spots))
    d = F.hypot(F.col("px") - F.col("c.qx"), F.col("py") - F.col("c.qy"))
    return wide.groupBy("set", F.col("c.corner").alias("corner")).agg(F.min(F.struct(d.alias("d"), "seq", "px", "py")).alias("p")).select("set", "corner", "p.seq", "p.px", "p.py")


def nearest(points: DataFrame, to: list[tuple[float, float]]) -> DataFrame:
    """For each literal target (numbered from 0), the nearest point: one aggregation, no pair list is kept."""
    spots = F.array(*[F.struct(F.lit(i).alias("target"), F.lit(float(x)).alias("qx"), F.lit(float(y)).alias("qy")) for i, (x, y) in enumerate(to)])
    d = F.hypot(F.col("px") - F.col("c.qx"), F.col("py") - F.col("c.qy"))
    return points.withColumn("c", F.explode(spots)).groupBy("set", F.col("c.target").alias("target")).agg(F.min(F.struct(d.alias("d"), "seq")).alias("p")).select("set", "target", "p.seq", F.col("p.d").alias("distance"))


def contacts(circles: DataFrame, slack: float = 1.1) -> DataFrame:
    """Pairs of circles (id, cx, cy, r) that touch: distance at most slack * (r1 + r2).

    Circles lie in levels by the power of two of their radius, each with a grid as wide as its circles reach. A circle
    asks the nine cells around it in the grids of its own and of all larger levels, so a giant widens no other's cells
    and no pairs beyond neighbouring cells are formed.
    """
    level = F.when(F.col("r") > 2.0**-20, F.floor(F.log2("r"))).otherwise(-20).cast("int")  # the smallest share a level
    held = circles.select("id", "cx", "cy", "r", level.alias("level"))
    levels = held.agg(F.collect_set("level").alias("levels"))  # one row: as many numbers as there are levels
    side = F.lit(4 * slack) * F.pow(F.lit(2.0), "level")
    at = lambda c: F.floor(F.col(c) / side)
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    asking = held.crossJoin(F.broadcast(levels)).withColumn("own", F.col("level")).withColumn("level", F.explode("levels")).filter("level >= own").drop("levels")
    asking = asking.withColumn("d", around).select(F.col("id").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("r").alias("ar"), "own", "level", (at("cx") + F.col("d.a")).alias("gx"), (at("cy") + F.col("d.b")).alias("gy"))
    there = held.select(F.col("id").alias("b"), "cx", "cy", "r", "level", at("cx").alias("gx"), at("cy").alias("gy"))
    near = F.hypot(F.col("ax") - F.col("cx"), F.col("ay") - F.col("cy")) <= slack * (F.col("ar") + F.col("r"))
    once = (F.col("own") < F.col("level")) | (F.col("a") < F.col("b"))  # equal levels ask both ways
    return asking.join(there, ["level", "gx", "gy"]).filter(near & once & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def checked_centres(centres: DataFrame, mask: DataFrame, radius: float, most: int = 150) -> DataFrame:
    """Centres (image_id, id, cx, cy) whose pixel is on the mask and whose disk lacks fewer than ``most`` mask pixels."""
    reach = int(math.ceil(radius))
    disk = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b <= radius * radius])
    cells = centres.withColumn("d", F.explode(disk)).select("image_id", "id", "cx", "cy", (F.round("cy").cast("long") + F.col("d.a")).alias("y"), (F.round("cx").cast("long") + F.col("d.b")).alias("x"), ((F.col("d.a") == 0) & (F.col("d.b") == 0)).alias("centre"))
    found = cells.join(mask.select("image_id", "y", "x", F.lit(1).alias("on")), ["image_id", "y", "x"], "left")
    kept = found.groupBy("image_id", "id", "cx", "cy").agg(F.sum(F.when(F.col("on").isNull(), 1).otherwise(0)).alias("lacking"), F.max(F.when(F.col("centre"), F.col("on"))).alias("middle"))
    return kept.filter((F.col("middle") == 1) & (F.col("lacking") < most)).select("image_id", "id", "cx", "cy", "lacking")


def hex_lattice(spark: SparkSession, width: int, radius: float, depth: int) -> DataFrame:
    """Centres of a hexagonal packing of circles, ``depth`` rows from y = 1 down, radius * sqrt(3) apart.

    Row k has its centres 2 radius apart from -width + k radius on, as many as the first row has up to ``width``; so
    every row is shifted by a radius against the one above, and none leaves the left side bare.
    """
    cols = int(2 * width / (2 * radius)) + 1
    grid = spark.range(depth).withColumnRenamed("id", "row").withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return grid.select("row", F.col("col").cast("long").alias("col"), (F.lit(float(-width)) + F.col("col") * 2 * radius + F.col("row") * radius).alias("cx"), (1 + F.col("row") * radius * math.sqrt(3)).alias("cy"))


def circumcenter(triangles: DataFrame) -> DataFrame:
    """Centre and radius of the circle through (ax, ay), (bx, by), (cx, cy)."""
    ax, ay, bx, by, cx, cy = (F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy"))
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    out = triangles.withColumn("ux", (a * (by - cy) + b * (cy - ay) + c * (ay - by)) / d).withColumn("uy", (a * (cx - bx) + b * (ax - cx) + c * (bx - ax)) / d)
    return out.withColumn("radius", F.hypot(F.col("ux") - ax, F.col("uy") - ay))


def line_crossings(lines: DataFrame) -> DataFrame:
    """Where each line of group 0 meets each of group 1 (id, grp, x1, y1, x2, y2); parallel lines meet nowhere."""
    a = lines.filter("grp = 0").select(F.col("id").alias("a"), *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    b = lines.filter("grp = 1").select(F.col("id").alias("b"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    both = a.join(F.broadcast(b), F.lit(True))  # a grid has a handful of lines
    dax, day, dbx, dby = F.col("ax2") - F.col("ax1"), F.col("ay2") - F.col("ay1"), F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")
    det = dax * dby - day * dbx
    t = ((F.col("bx1") - F.col("ax1")) * dby - (F.col("by1") - F.col("ay1")) * dbx) / det
    return both.filter(F.abs(det) > 1e-12).select("a", "b", (F.col("ax1") + t * dax).alias("px"), (F.col("ay1") + t * day).alias("py"))


def rotation_and_scale(quads: DataFrame) -> DataFrame:
    """Per pair of quads (m1x .. m4y, f1x .. f4y; order TL, TR, BR, BL): the turn in degrees, and the mean diagonal ratio.

    theta is the mean angle of the fixed quad's top (1 to 2) and bottom (4 to 3) edges to the direction (0, -1), less
    the moving quad's; so it has a sign.
    """
    def angle(q: str, i: int, j: int) -> Column:
        ux, uy = F.col(f"{q}{j}x") - F.col(f"{q}{i}x"), F.col(f"{q}{j}y") - F.col(f"{q}{i}y")
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -uy / F.hypot(ux, uy)))))

    mean = lambda q: (angle(q, 1, 2) + angle(q, 4, 3)) / 2
    side = lambda p, i, j: F.hypot(F.col(f"{p}{j}x") - F.col(f"{p}{i}x"), F.col(f"{p}{j}y") - F.col(f"{p}{i}y"))
    return quads.select("id", (mean("f") - mean("m")).alias("theta"), ((side("f", 1, 3) / side("m", 1, 3) + side("f", 2, 4) / side("m", 2, 4)) / 2).alias("scale"))


def polynomial_fit(samples: DataFrame, degree: int = 2) -> DataFrame:
    """Least-squares coefficients (constant first) and adjusted r2 of y on x for each set, from moment sums alone.

    One aggregation yields 3 * degree + 3 numbers a set; the small system is solved where the sums arrive.
    """
    sums = [F.sum(F.pow("px", F.lit(float(k)))).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(F.pow("px", F.lit(float(k))) * F.col("py")).alias(f"t{k}") for k in range(degree + 1)] + [F.sum(F.col("py") * F.col("py")).alias("yy")]

    def solve(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                a = np.array([[getattr(r, f"s{i + j}") for j in range(degree + 1)] for i in range(degree + 1)])
                t = np.array([getattr(r, f"t{i}") for i in range(degree + 1)])
                c = np.linalg.lstsq(a, t, rcond=None)[0]
                n, rest = r.s0, r.yy - c @ t
                total = r.yy - r.t0**2 / n
                rows.append((r.set, [float(v) for v in c], float(1 - (rest / max(1, n - degree - 1)) / (total / max(1, n - 1))) if total > 0 else None))
            yield pd.DataFrame(rows, columns=["set", "coef", "adj_r2"])

    return samples.groupBy("set").agg(*sums).mapInPandas(solve, "set string, coef array<double>, adj_r2 double")


def accept_windows(candidates: DataFrame, mask: DataFrame, height: int, width: int, count: int) -> DataFrame:
    """The first ``count`` candidate windows (image_id, seq, x, y) that lie wholly on the mask and overlap none accepted before.

    Coverage is counted by one join of mask pixels to windows' rows; only whole windows reach the image's greedy task.
    """
    rows = candidates.withColumn("row", F.explode(F.sequence(F.col("y"), F.col("y") + height - 1)))
    w = Window.partitionBy("image_id", "y").orderBy("x")
    runs = mask.withColumn("g", F.col("x") - F.row_number().over(w)).groupBy("image_id", "y", "g").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    covered = rows.join(runs.select("image_id", F.col("y").alias("row"), "a", "b"), ["image_id", "row"]).filter((F.col("a") <= F.col("x")) & (F.col("b") >= F.col("x") + width - 1))
    whole = covered.groupBy("image_id", "seq", "x", "y").count().filter(F.col("count") == height).drop("count")

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for r in group.sort_values("seq").itertuples():
            if len(kept) < count and all(abs(r.x - k.x) >= width or abs(r.y - k.y) >= height for k in kept):
                kept.append(r)
        return pd.DataFrame({"image_id": [k.image_id for k in kept], "roi": range(len(kept)), "seq": [k.seq for k in kept], "x": [k.x for k in kept], "y": [k.y for k in kept]})

    return whole.groupBy("image_id").applyInPandas(greedy, "image_id string, roi int, seq long, x long, y long")


def fast_ica(samples: np.ndarray, parts: int = 3, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Independent sources and the mixing matrix by symmetric fixed-point steps with the log-cosh contrast."""
    x = samples - samples.mean(axis=0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    white = (vt[:parts].T / s[:parts]).T * np.sqrt(len(x))
    z = x @ white.T
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(parts, parts)))[0]
    for _ in range(rounds):
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - (1 - g**2).mean(axis=0)[:, None] * w
        a, _, b = np.linalg.svd(new)
        new = a @ b
        if np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-8:
            w = new
            break
        w = new
    return z @ w.T, np.linalg.pinv(w @ white)
