"""Outlines and packings that one task works out: concave hulls, curves along sides, and circles moved for a better fill."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regions
from ..operators.register import chebyshev_nodes, curve_at
from .kernels import best_curve


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _hull(p: np.ndarray) -> list[int]:
    """Convex hull, counter-clockwise, of points in rising order."""
    def chain(order: range) -> list[int]:
        out: list[int] = []
        for i in order:
            while len(out) > 1 and _turn(p[out[-2]], p[out[-1]], p[i]) <= 0:
                out.pop()
            out.append(i)
        return out[:-1]

    return chain(range(len(p))) + chain(range(len(p) - 1, -1, -1)) if len(p) > 2 else list(range(len(p)))


def dug(p: np.ndarray, longest: float) -> list[int]:
    """The hull of distinct points in rising order, its edges over ``longest`` replaced by two through the fittest inner point.

    An edge is dug only where the triangle it gives up holds no other point and the new edges cross none, so the ring
    stays simple and every point stays in it or on it.
    """
    ring = _hull(p)
    stuck: set[tuple[int, int]] = set()
    while len(ring) > 2:
        a, b = np.array(ring), np.roll(ring, -1)
        size = np.hypot(*(p[a] - p[b]).T)
        k = next((k for k in np.argsort(-size, kind="stable") if (a[k], b[k]) not in stuck), None)
        if k is None or size[k] <= longest:
            break
        i, j = int(a[k]), int(b[k])
        inner = np.setdiff1d(np.arange(len(p)), ring)
        reach = np.maximum(np.hypot(*(p[inner] - p[i]).T), np.hypot(*(p[inner] - p[j]).T))
        for at in np.argsort(reach, kind="stable"):
            q = int(inner[at])
            if reach[at] >= size[k]:
                continue
            others = np.setdiff1d(np.arange(len(p)), [i, j, q])
            sides = [_turn(p[u], p[v], p[others]) for u, v in ((i, j), (j, q), (q, i))]
            if (np.minimum.reduce(sides) > 1e-9).any() or (np.maximum.reduce(sides) < -1e-9).any():
                continue
            cross = np.zeros(len(a), bool)
            for u in (i, j):
                one = _turn(p[u], p[q], p[a]) * _turn(p[u], p[q], p[b]) < -1e-9
                cross |= one & (_turn(p[a], p[b], p[u]) * _turn(p[a], p[b], p[q]) < -1e-9)
            if not cross.any():
                ring.insert(int(k) + 1, q)
                break
        else:
            stuck.add((i, j))
    return ring


def concave_hull(points: DataFrame, longest: float) -> DataFrame:
    """A simple ring round each set that follows it more closely than the convex hull: (set, place, px, py).

    Repeated places count once. One set is held by a task.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(group[["px", "py"]].to_numpy(float), axis=0)
        ring = p[dug(p, longest)]
        return pd.DataFrame({"set": group["set"].iloc[0], "place": range(len(ring)), "px": ring[:, 0], "py": ring[:, 1]})

    return points.groupBy("set").applyInPandas(run, "set string, place int, px double, py double")


def fitted_nodes(sides: DataFrame, n: int = 20) -> DataFrame:
    """Points on a smooth curve along each side at n + 1 Chebyshev nodes: (set, side, node, px, py).

    A side is turned level by its ends, the best curve is fitted, taken at the nodes, and turned back. Sides of one place have no
    curve and are left out.
    """
    name = F.concat_ws("/", "set", "side")
    ends = sides.groupBy("set", "side").agg(F.min_by(F.struct("px", "py"), "place").alias("a"), F.max_by(F.struct("px", "py"), "place").alias("b"))
    ends = ends.select("set", "side", F.col("a.px").alias("ox"), F.col("a.py").alias("oy"), (F.col("b.px") - F.col("a.px")).alias("dx"), (F.col("b.py") - F.col("a.py")).alias("dy"))
    ends = ends.withColumn("size", F.hypot("dx", "dy")).filter("size > 0").withColumns({"c": F.col("dx") / F.col("size"), "s": F.col("dy") / F.col("size")}).drop("dx", "dy")
    dx, dy = F.col("px") - F.col("ox"), F.col("py") - F.col("oy")
    level = sides.join(ends, ["set", "side"]).select(name.alias("set"), (dx * F.col("c") + dy * F.col("s")).alias("px"), (dy * F.col("c") - dx * F.col("s")).alias("py"))
    curves = best_curve(level).withColumnRenamed("set", "name")
    nodes = ends.withColumn("name", name).join(curves, "name").join(F.broadcast(chebyshev_nodes(sides.sparkSession, n)), F.lit(True))
    u = F.col("ratio") * F.col("size")
    v = curve_at(u)
    return nodes.select("set", "side", "node", (F.col("ox") + u * F.col("c") - v * F.col("s")).alias("px"), (F.col("oy") + u * F.col("s") + v * F.col("c")).alias("py"))


def _filled(y: np.ndarray, x: np.ndarray, free: np.ndarray, kept: list[tuple], least: float, down: int) -> list[tuple]:
    """Circles added to those kept: of the places nearly as roomy as the best, the first from the top or the bottom."""
    out = list(kept)
    for cy, cx, r in out:
        free = np.minimum(free, np.hypot(y - cy, x - cx) - r)
    while len(free) and free.max() >= least:
        roomy = np.flatnonzero(free >= max(least, 0.9 * free.max()))
        i = roomy[np.lexsort([x[roomy], down * y[roomy]])[0]]
        out.append((int(y[i]), int(x[i]), float(free[i])))
        free = np.minimum(free, np.hypot(y - y[i], x - x[i]) - free[i])
    return out


def moved_circles(mask: DataFrame, least: float = 2.0, rounds: int = 5) -> DataFrame:
    """Circles in a mask, bettered in rounds: (image_id, circle, cy, cx, r, first_area, area).

    Each round takes out a circle that touches few others with its two nearest, fills the room anew from the top and
    from the bottom, and keeps what covers most. ``area`` never falls below ``first_area``, that of the first fill.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((group.y.max() + 3, group.x.max() + 3), bool)
        m[group.y + 1, group.x + 1] = True
        y, x = np.nonzero(m)
        free = regions.distance_grid(m)[y, x]
        area = lambda c: float(sum(np.pi * r * r for *_, r in c))
        best = max((_filled(y, x, free, [], least, d) for d in (1, -1)), key=area)
        first = area(best)
        for k in range(rounds):
            if len(best) < 4:
                break
            c = np.array(best)
            far = np.hypot(c[:, None, 0] - c[None, :, 0], c[:, None, 1] - c[None, :, 1])
            degree = ((far <= 1.1 * (c[:, None, 2] + c[None, :, 2])).sum(axis=1)) - 1
            one = int(np.argsort(degree, kind="stable")[k % len(best)])
            gone = set(np.argsort(far[one], kind="stable")[:3].tolist())
            left = [z for i, z in enumerate(best) if i not in gone]
            best = max([best, *(_filled(y, x, free, left, least, d) for d in (1, -1))], key=area)
        return pd.DataFrame([(group.image_id.iloc[0], i, cy - 1, cx - 1, r, first, area(best)) for i, (cy, cx, r) in enumerate(best)], columns=["image_id", "circle", "cy", "cx", "r", "first_area", "area"])

    return mask.groupBy("image_id").applyInPandas(run, "image_id string, circle int, cy long, cx long, r double, first_area double, area double")
