"""Registration geometry: cubic rotation, the four sides of an outline, nodes along a side, and control points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .raster import cubic_kernel


def rotated_points(points: DataFrame, degrees: float, cx: float, cy: float) -> DataFrame:
    """Points turned about a centre."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dx, dy = F.col("px") - cx, F.col("py") - cy
    return points.withColumns({"px": c * dx - s * dy + cx, "py": s * dx + c * dy + cy})


def rotated_cubic(r: DataFrame, degrees: float) -> DataFrame:
    """A raster turned about its middle by cubic interpolation over 4 x 4 pixels; v is null where the source lies outside.

    Every output pixel asks for the 16 taps of its source place (beyond the edge: the edge pixel), so work is 16 rows
    a pixel whatever the angle, and one shuffle meets them with the image.
    """
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    box = r.groupBy("image_id").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    dx, dy = F.col("x") - F.col("mx") / 2, F.col("y") - F.col("my") / 2
    at = r.select("image_id", "y", "x").join(box, "image_id").withColumns({"sx": F.round(dx * c + dy * s + F.col("mx") / 2, 9), "sy": F.round(dy * c - dx * s + F.col("my") / 2, 9)})
    inside = (F.col("sx") >= 0) & (F.col("sx") <= F.col("mx")) & (F.col("sy") >= 0) & (F.col("sy") <= F.col("my"))
    four = F.explode(F.sequence(F.lit(-1), F.lit(2)))
    wide = at.filter(inside).withColumn("i", four).withColumn("j", four)
    near = lambda v, k, most: F.greatest(F.lit(0), F.least(F.floor(v) + F.col(k), F.col(most))).cast("long")
    k = cubic_kernel(F.col("sy") - F.floor("sy") - F.col("i")) * cubic_kernel(F.col("sx") - F.floor("sx") - F.col("j"))
    wide = wide.select("image_id", "y", "x", near("sy", "i", "my").alias("py"), near("sx", "j", "mx").alias("px"), k.alias("k"))
    source = r.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), "v")
    found = wide.join(source, ["image_id", "py", "px"]).groupBy("image_id", "y", "x").agg(F.sum(F.col("k") * F.col("v")).alias("v"))
    return r.select("image_id", "y", "x").join(found, ["image_id", "y", "x"], "left")


def window_pixels(windows: DataFrame) -> DataFrame:
    """Pixels (image_id, roi, y, x) of turned rectangles (image_id, roi, cx, cy, height, width, angle in degrees).

    Each rectangle lists the pixels of its own bounding box only; the image is not read.
    """
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    half_y = (F.abs(s) * F.col("width") + F.abs(c) * F.col("height")) / 2
    half_x = (F.abs(c) * F.col("width") + F.abs(s) * F.col("height")) / 2
    span = lambda m, h: F.explode(F.sequence(F.floor(m - h), F.ceil(m + h)))
    cells = windows.withColumns({"c": c, "s": s}).withColumn("y", span(F.col("cy"), half_y)).withColumn("x", span(F.col("cx"), half_x))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    u, v = dx * F.col("c") + dy * F.col("s"), dy * F.col("c") - dx * F.col("s")
    return cells.filter((F.abs(u) <= F.col("width") / 2 + 1e-9) & (F.abs(v) <= F.col("height") / 2 + 1e-9)).select("image_id", "roi", "y", "x")


def chebyshev_nodes(spark: SparkSession, n: int) -> DataFrame:
    """n + 1 nodes (node, ratio) in [0, 1]: the n - 1 Chebyshev nodes in rising order between both ends."""
    k = F.col("id")
    inner = (1 - F.cos((2 * k - 1) * math.pi / (2 * (n - 1)))) / 2
    return spark.range(n + 1).select(k.cast("int").alias("node"), F.when(k == 0, 0.0).when(k == n, 1.0).otherwise(inner).alias("ratio"))


def sides(rings: DataFrame, corners: DataFrame) -> DataFrame:
    """Closed outlines (set, seq, px, py) cut at their corner vertices (set, seq): (set, side, place, seq, px, py).

    A side runs from its corner (place = 0) to the next one, which ends it and begins the next; the last side wraps
    round to the first corner. Sides are numbered by their first corner's place on the ring.
    """
    ring = rings.join(corners.select("set", "seq", F.lit(1).alias("turn")).distinct(), ["set", "seq"], "left")
    w = Window.partitionBy("set").orderBy("seq")
    numbered = ring.withColumn("side", F.sum(F.coalesce("turn", F.lit(0))).over(w) - 1).withColumn("many", F.sum(F.coalesce("turn", F.lit(0))).over(Window.partitionBy("set")))
    wrapped = numbered.filter("many > 0").withColumn("late", (F.col("side") < 0).cast("int")).withColumn("side", F.pmod("side", "many"))
    last = wrapped.filter("turn = 1").withColumn("late", F.lit(2)).withColumn("side", F.pmod(F.col("side") - 1, F.col("many")))
    each = Window.partitionBy("set", "side").orderBy("late", "seq")
    return wrapped.unionByName(last).withColumn("place", F.row_number().over(each) - 1).select("set", F.col("side").cast("int").alias("side"), "place", "seq", "px", "py")


def snapped(sides_: DataFrame, ratios: DataFrame, closest: int = 7) -> DataFrame:
    """Each side's vertices at given shares of its length: (set, side, node, place, px, py).

    A node takes the vertex whose share of arc length is nearest (of equals the earlier); a node fewer than
    ``closest`` vertices after the one before moves a third of the way on to the next.
    """
    along = Window.partitionBy("set", "side").orderBy("place")
    step = F.coalesce(F.hypot(F.col("px") - F.lag("px").over(along), F.col("py") - F.lag("py").over(along)), F.lit(0.0))
    lengths = sides_.withColumn("step", step).withColumn("s", F.sum("step").over(along)).withColumn("total", F.sum("step").over(Window.partitionBy("set", "side")))
    shares = lengths.select("set", "side", "place", F.when(F.col("total") > 0, F.round(F.col("s") / F.col("total"), 9)).otherwise(0.0).alias("share"))
    hits = shares.join(F.broadcast(ratios), F.lit(True))  # a fixed handful of nodes
    first = hits.groupBy("set", "side", "node").agg(F.min(F.struct(F.round(F.abs(F.col("share") - F.col("ratio")), 9).alias("d"), "place")).alias("p")).select("set", "side", "node", "p.place")
    order = Window.partitionBy("set", "side").orderBy("node")
    tight = (F.col("place") - F.lag("place").over(order) < closest) & F.lead("place").over(order).isNotNull()
    moved = F.when(tight, F.floor((2 * F.col("place") + F.lead("place").over(order)) / 3)).otherwise(F.col("place")).cast("int")
    return first.withColumn("to", moved).select("set", "side", "node", F.col("to").alias("place")).join(sides_.select("set", "side", "place", "px", "py"), ["set", "side", "place"])


def middle_grid(sides_: DataFrame) -> DataFrame:
    """Crossings (set, a, b, px, py) of the lines that join opposite sides' points at a quarter, half and three quarters.

    Sides 0 and 2, and 1 and 3, are opposite and run against each other, so quarters meet three quarters.
    """
    spots = sides_.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("node"), (F.col("id") / 4).alias("ratio"))
    at = snapped(sides_, spots, 0).filter("side < 4")
    one, two = at.filter("side < 2"), at.filter("side >= 2").select("set", (F.col("side") - 2).alias("side"), (4 - F.col("node")).alias("node"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    lines = one.join(two, ["set", "side", "node"]).select("set", F.col("side").alias("grp"), (F.col("node") - 1).alias("id"), F.col("px").alias("x1"), F.col("py").alias("y1"), F.col("qx").alias("x2"), F.col("qy").alias("y2"))
    return _crossings_by_set(lines)


def _crossings_by_set(lines: DataFrame) -> DataFrame:
    a = lines.filter("grp = 0").select("set", F.col("id").alias("a"), *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    b = lines.filter("grp = 1").select("set", F.col("id").alias("b"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    ux, uy, vx, vy = (F.col(p) - F.col(q) for p, q in (("ax2", "ax1"), ("ay2", "ay1"), ("bx2", "bx1"), ("by2", "by1")))
    det = ux * vy - uy * vx
    t = ((F.col("bx1") - F.col("ax1")) * vy - (F.col("by1") - F.col("ay1")) * vx) / det
    return a.join(b, "set").filter(F.abs(det) > 1e-9).select("set", "a", "b", (F.col("ax1") + t * ux).alias("px"), (F.col("ay1") + t * uy).alias("py"))


def control_points(sides_: DataFrame, n: int = 20) -> DataFrame:
    """Control points of an outline: n along each of four sides, then the middle grid: (set, kind, place, px, py)."""
    nodes = chebyshev_nodes(sides_.sparkSession, n).filter(F.col("node") < n)  # a side's last node is the next one's first
    edge = snapped(sides_, nodes).select("set", F.lit("side").alias("kind"), (F.col("side") * n + F.col("node")).alias("place"), "px", "py")
    return edge.unionByName(middle_grid(sides_).select("set", F.lit("grid").alias("kind"), (F.col("a") * 3 + F.col("b")).alias("place"), "px", "py"))


def curve_at(x: Column) -> Column:
    """The value at ``x`` of the curve in a row of ``kernels.best_curve`` (kind, coef, mid, half)."""
    t = (x - F.col("mid")) / F.col("half")
    polynomial = F.aggregate(F.reverse("coef"), F.lit(0.0), lambda a, c: a * t + c)
    sine = F.col("coef")[1] * F.sin(F.col("coef")[0] * t) + F.col("coef")[2] * F.cos(F.col("coef")[0] * t) + F.col("coef")[3]
    return F.when(F.col("kind") == "sine", sine).otherwise(polynomial)


def stain_basis(rgb: DataFrame) -> DataFrame:
    """Per image, mean colours of the background and of two stains: (image_id, and r, g, b of each as k0r .. k2b).

    Background: pixels of at least the image's mean brightness. Stains: the others, parted by whether red less blue is above its
    mean among them. Where a part has no pixel its colour is null. Two aggregations; no pixel leaves its task but as sums.
    """
    light = rgb.withColumn("l", F.round((F.col("r") + F.col("g") + F.col("b")) / 3, 9)).withColumn("h", F.round(F.col("r") - F.col("b"), 9))
    cut = light.groupBy("image_id").agg(F.round(F.avg("l"), 9).alias("ml"))
    dark = light.join(cut, "image_id")
    hue = dark.filter("l < ml").groupBy("image_id").agg(F.round(F.avg("h"), 9).alias("mh"))
    part = dark.join(hue, "image_id", "left").withColumn("k", F.when(F.col("l") >= F.col("ml"), 0).when(F.col("h") > F.col("mh"), 1).otherwise(2))
    return part.groupBy("image_id").agg(*[F.avg(F.when(F.col("k") == k, F.col(c))).alias(f"k{k}{c}") for k in range(3) for c in "rgb"])


def unmixed_adaptively(rgb: DataFrame) -> DataFrame:
    """Each pixel solved against its own image's ``stain_basis`` (Cramer's rule): (image_id, y, x, s0, s1, s2).

    Shares are null where the three colours do not span a space.
    """
    all_ = rgb.join(stain_basis(rgb), "image_id")
    col = lambda k: [F.col(f"k{k}{c}") for c in "rgb"]
    own = [F.col(c) for c in "rgb"]
    det = lambda p, q, r: p[0] * (q[1] * r[2] - q[2] * r[1]) - q[0] * (p[1] * r[2] - p[2] * r[1]) + r[0] * (p[1] * q[2] - p[2] * q[1])
    whole = det(col(0), col(1), col(2))
    share = lambda k: F.when(F.abs(whole) > 1e-9, det(*[own if k == j else col(j) for j in range(3)]) / whole)
    return all_.select("image_id", "y", "x", *[share(k).alias(f"s{k}") for k in range(3)])


def warped(r: DataFrame, places: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """A raster sampled bilinearly at ``places`` (image_id, y, x, sx, sy); ``fill`` where the source lies outside.

    Four rows a pixel meet the image in one shuffle, whatever the map.
    """
    box = r.groupBy("image_id").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    at = places.join(box, "image_id")
    inside = (F.col("sx") >= 0) & (F.col("sx") <= F.col("mx")) & (F.col("sy") >= 0) & (F.col("sy") <= F.col("my"))
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    taps = F.array(*[F.struct(F.least(F.floor("sy") + i, F.col("my")).alias("py"), F.least(F.floor("sx") + j, F.col("mx")).alias("px"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("k")) for i in (0, 1) for j in (0, 1)])
    wide = at.filter(inside).select("image_id", "y", "x", F.explode(taps).alias("t")).select("image_id", "y", "x", F.col("t.py").alias("py"), F.col("t.px").alias("px"), F.col("t.k").alias("k"))
    source = r.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), "v")
    found = wide.join(source, ["image_id", "py", "px"]).groupBy("image_id", "y", "x").agg(F.sum(F.col("k") * F.col("v")).alias("v"))
    out = places.select("image_id", "y", "x").join(found, ["image_id", "y", "x"], "left")
    return out if fill is None else out.withColumn("v", F.coalesce("v", F.lit(float(fill))))


def polynomial_places(r: DataFrame, maps: list[tuple[int, int, float, float]]) -> DataFrame:
    """Where a polynomial map (power of x, power of y, coefficient for x, for y) takes each pixel's source from."""
    power = lambda c, k: F.pow(F.col(c).cast("double"), F.lit(float(k))) if k else F.lit(1.0)
    total = lambda i: sum((m[i] * power("x", m[0]) * power("y", m[1]) for m in maps), F.lit(0.0))
    return r.select("image_id", "y", "x", F.round(total(2), 9).alias("sx"), F.round(total(3), 9).alias("sy"))


def local_places(r: DataFrame, maps: DataFrame) -> DataFrame:
    """Where the local weighted means (``kernels.local_maps``, id = image_id) take each pixel's source from; null out of every map's reach.

    Each map counts by 1 - 3 t^2 + 2 t^3, t its distance over its reach. An image's maps are one array, a row each for
    its control points, so no pixel is repeated.
    """
    held = maps.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("point", "x", "y", "reach", "cx", "cy"))).alias("maps")).withColumnRenamed("id", "image_id")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    basis = [F.lit(1.0), x, y, x * y, x * x, y * y]
    value = lambda c: sum((c[k] * b for k, b in enumerate(basis)), F.lit(0.0))

    def step(acc: Column, m: Column) -> Column:
        t = F.hypot(x - m["x"], y - m["y"]) / m["reach"]
        w = F.when(t < 1, 1 - 3 * t * t + 2 * t * t * t).otherwise(0.0)
        return F.struct((acc["w"] + w).alias("w"), (acc["sx"] + w * value(m["cx"])).alias("sx"), (acc["sy"] + w * value(m["cy"])).alias("sy"))

    sums = F.aggregate("maps", F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy")), step)
    found = r.select("image_id", "y", "x").join(held, "image_id").withColumn("s", sums)
    ratio = lambda c: F.when(F.col("s.w") > 0, F.col(f"s.{c}") / F.col("s.w"))
    return found.select("image_id", "y", "x", ratio("sx").alias("sx"), ratio("sy").alias("sy"))


def binary_again(mask_values: DataFrame) -> DataFrame:
    """Resampled mask values: above 0.5 is 1, below it 0, exactly 0.5 stays."""
    return mask_values.withColumn("v", F.when(F.col("v") > 0.5, 1.0).when(F.col("v") < 0.5, 0.0).otherwise(F.col("v")))


def level_crossings(r: DataFrame, level: float) -> DataFrame:
    """(image_id, py, px): where the image crosses a level between neighbouring pixels, by linear interpolation."""
    out = None
    for axis, dy, dx in ((("image_id", "y", "x"), 0, 1), (("image_id", "x", "y"), 1, 0)):
        nxt = F.lead("v").over(Window.partitionBy(*axis[:2]).orderBy(axis[2]))
        step = r.withColumn("v", F.col("v") - F.lit(float(level))).withColumn("n", nxt).filter("n is not null and (v < 0) != (n < 0)")
        t = F.col("v") / (F.col("v") - F.col("n"))
        part = step.select("image_id", (F.col("y") + dy * t).alias("py"), (F.col("x") + dx * t).alias("px"))
        out = part if out is None else out.unionByName(part)
    return out
