"""Queries of registration geometry, outlines, turned windows, adaptive unmixing and moved circles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import outlines
from ..operators import points, register
from ..sources import rasters
from .catalogue import _ROUTES, RGB, _add, _levels, _on_q, _pixels, _routes

_C, _S = repr(math.cos(math.radians(30))) + "::DOUBLE", repr(math.sin(math.radians(30))) + "::DOUBLE"
_CUBIC = "(CASE WHEN abs({0}) <= 1 THEN 1.5::DOUBLE * power(abs({0}), 3) - 2.5::DOUBLE * power({0}, 2) + 1 WHEN abs({0}) <= 2 THEN -0.5::DOUBLE * power(abs({0}), 3) + 2.5::DOUBLE * power({0}, 2) - 4 * abs({0}) + 2 ELSE 0 END)"
_on_q(
    "rotate_cubic",
    lambda r: register.rotated_cubic(r, 30),
    f", b AS (SELECT max(y) AS my, max(x) AS mx FROM q), a AS (SELECT y, x, my, mx, round((x - mx / 2) * {_C} + (y - my / 2) * {_S} + mx / 2, 9) AS sx, round((y - my / 2) * {_C} - (x - mx / 2) * {_S} + my / 2, 9) AS sy FROM q, b), "
    f"t AS (SELECT y, x, CAST(greatest(0, least(floor(sy) + i, my)) AS BIGINT) AS py, CAST(greatest(0, least(floor(sx) + j, mx)) AS BIGINT) AS px, {_CUBIC.format('(sy - floor(sy) - i)')} * {_CUBIC.format('(sx - floor(sx) - j)')} AS k FROM a, range(-1, 3) u(i), range(-1, 3) w(j) WHERE sx BETWEEN 0 AND mx AND sy BETWEEN 0 AND my), "
    "f AS (SELECT t.y, t.x, sum(k * q.v) AS v FROM t JOIN q ON q.y = t.py AND q.x = t.px GROUP BY 1, 2) SELECT q.y, q.x, round(f.v, 6) AS v FROM q LEFT JOIN f ON q.y = f.y AND q.x = f.x",
)
_add("rotate_points", lambda s, d: _pixels(register.rotated_points(_routes(s, d), 30, 48, 50), "seq", "px", "py"), _ROUTES + f" SELECT seq, round({_C} * (px - 48) - {_S} * (py - 50) + 48, 6) AS px, round({_S} * (px - 48) + {_C} * (py - 50) + 50, 6) AS py FROM p")


def _turned(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return rasters.table(s, d, "supplier").select(F.lit("q").alias("image_id"), k.alias("roi"), (k % 53).cast("double").alias("cx"), (k % 47).cast("double").alias("cy"), F.lit(6.0).alias("height"), F.lit(9.0).alias("width"), (k * 37 % 360).cast("double").alias("angle"))


_add(
    "turned_windows",
    lambda s, d: register.window_pixels(_turned(s, d)).drop("image_id"),
    "WITH w AS (SELECT s_suppkey AS roi, s_suppkey % 53 AS cx, s_suppkey % 47 AS cy, cos(radians(s_suppkey * 37 % 360)) AS c, sin(radians(s_suppkey * 37 % 360)) AS s FROM supplier), k AS (SELECT roi, c, s, cy + i AS y, cx + j AS x, i, j FROM w, range(-8, 9) a(i), range(-8, 9) b(j)) SELECT roi, y, x FROM k WHERE abs(j * c + i * s) <= 4.5 + 1e-9 AND abs(i * c - j * s) <= 3 + 1e-9",
)
_add("chebyshev_nodes", lambda s, d: _pixels(register.chebyshev_nodes(s, 20), "node", "ratio"), "SELECT CAST(i AS INTEGER) AS node, round(CASE i WHEN 0 THEN 0 WHEN 20 THEN 1 ELSE (1 - cos((2 * i - 1) * pi() / 38)) / 2 END, 6) AS ratio FROM range(0, 21) r(i)")

# outlines: each nation's customers in the order of their angle about one place


def _rings(s: SparkSession, d: str) -> DataFrame:
    angle = F.round(F.atan2(F.col("py") - 50, F.col("px") - 48), 9)
    return _routes(s, d).withColumn("seq", F.row_number().over(Window.partitionBy("set").orderBy(angle, "seq")).cast("long"))


def _sides(s: SparkSession, d: str) -> DataFrame:
    rings = _rings(s, d)
    return register.sides(rings, points.corners(rings))


_SIDES = (
    _ROUTES + ", a AS (SELECT set, px, py, row_number() OVER (PARTITION BY set ORDER BY round(atan2(py - 50, px - 48), 9), seq) AS seq FROM p), "
    "bx AS (SELECT set, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM a GROUP BY 1), "
    "cq AS (SELECT set, 0 AS corner, x0 AS qx, y0 AS qy FROM bx UNION ALL SELECT set, 1, x1, y0 FROM bx UNION ALL SELECT set, 2, x1, y1 FROM bx UNION ALL SELECT set, 3, x0, y1 FROM bx), "
    "ck AS (SELECT a.set, a.seq, row_number() OVER (PARTITION BY a.set, corner ORDER BY power(px - qx, 2) + power(py - qy, 2), seq) AS k FROM cq JOIN a ON a.set = cq.set), cr AS (SELECT DISTINCT set, seq FROM ck WHERE k = 1), "
    "tn AS (SELECT a.set, a.seq, px, py, CASE WHEN cr.seq IS NULL THEN 0 ELSE 1 END AS turn FROM a LEFT JOIN cr ON a.set = cr.set AND a.seq = cr.seq), "
    "nm AS (SELECT *, sum(turn) OVER (PARTITION BY set ORDER BY seq) - 1 AS sd, sum(turn) OVER (PARTITION BY set) AS many FROM tn), "
    "wr AS (SELECT set, seq, px, py, CASE WHEN sd < 0 THEN many - 1 ELSE sd END AS side, CASE WHEN sd < 0 THEN 1 ELSE 0 END AS late FROM nm UNION ALL SELECT set, seq, px, py, CASE WHEN sd = 0 THEN many - 1 ELSE sd - 1 END, 2 FROM nm WHERE turn = 1), "
    "sides AS (SELECT set, CAST(side AS INTEGER) AS side, CAST(row_number() OVER (PARTITION BY set, side ORDER BY late, seq) - 1 AS INTEGER) AS place, seq, px, py FROM wr)"
)
_SNAP = (
    ", st AS (SELECT *, coalesce(sqrt(power(px - lag(px) OVER t, 2) + power(py - lag(py) OVER t, 2)), 0) AS step FROM sides WINDOW t AS (PARTITION BY set, side ORDER BY place)), "
    "sh AS (SELECT *, CASE WHEN sum(step) OVER (PARTITION BY set, side) > 0 THEN round(sum(step) OVER (PARTITION BY set, side ORDER BY place) / sum(step) OVER (PARTITION BY set, side), 9) ELSE 0 END AS share FROM st), "
    "nd AS (SELECT CAST(i AS INTEGER) AS node, CASE i WHEN 0 THEN 0 WHEN 8 THEN 1 ELSE (1 - cos((2 * i - 1) * pi() / 14)) / 2 END AS ratio FROM range(0, 9) r(i)), "
    "hit AS (SELECT set, side, node, place, row_number() OVER (PARTITION BY set, side, node ORDER BY round(abs(share - ratio), 9), place) AS k FROM sh, nd), "
    "gap AS (SELECT set, side, node, place, lag(place) OVER t AS before, lead(place) OVER t AS after FROM hit WHERE k = 1 WINDOW t AS (PARTITION BY set, side ORDER BY node)), "
    "mv AS (SELECT set, side, node, CAST(CASE WHEN place - before < 7 AND after IS NOT NULL THEN floor((2 * place + after) / 3) ELSE place END AS INTEGER) AS place FROM gap)"
)
_add("outline_sides", lambda s, d: _sides(s, d), _SIDES + " SELECT set, side, place, seq, px, py FROM sides")
_add("snap_to_outline", lambda s, d: register.snapped(_sides(s, d), register.chebyshev_nodes(s, 8)).select("set", "side", "node", "place", "px", "py"), _SIDES + _SNAP + " SELECT mv.set, mv.side, node, mv.place, px, py FROM mv JOIN sides ON mv.set = sides.set AND mv.side = sides.side AND mv.place = sides.place")
_add("control_points", lambda s, d: _pixels(register.control_points(_sides(s, d)), "set", "kind", "place", "px", "py"))
_add("fitted_nodes", lambda s, d: _pixels(outlines.fitted_nodes(_sides(s, d)), "set", "side", "node", "px", "py", digits=4))
_add("concave_hull", lambda s, d: outlines.concave_hull(_routes(s, d), 20.0))
_add("moved_circles", lambda s, d: _pixels(outlines.moved_circles(_levels(s, d).filter("v >= 60").drop("v"), 1.0), "circle", "cy", "cx", "r", "first_area", "area"))
_SPLIT = ", li AS (SELECT *, round((r + g + b) / 3, 9) AS l, round(r - b, 9) AS h FROM c), cu AS (SELECT *, round(avg(l) OVER (), 9) AS ml FROM li), hu AS (SELECT round(avg(h), 9) AS mh FROM cu WHERE l < ml), pt AS (SELECT y, x, r, g, b, CASE WHEN l >= ml THEN 0 WHEN h > mh THEN 1 ELSE 2 END AS k FROM cu, hu)"
_BASIS_SQL = _SPLIT + ", ba AS (SELECT " + ", ".join(f"avg({c}) FILTER (k = {k}) AS k{k}{c}" for k in range(3) for c in "rgb") + " FROM pt)"


def _det(p: str, q: str, r: str) -> str:
    return f"({p}r * ({q}g * {r}b - {q}b * {r}g) - {q}r * ({p}g * {r}b - {p}b * {r}g) + {r}r * ({p}g * {q}b - {p}b * {q}g))"


_add("stain_basis", lambda s, d: _pixels(register.stain_basis(rasters.rgb_raster(s, d)), *[f"k{k}{c}" for k in range(3) for c in "rgb"]), RGB + _BASIS_SQL + " SELECT " + ", ".join(f"round(k{k}{c}, 6) AS k{k}{c}" for k in range(3) for c in "rgb") + " FROM ba")
_add("unmix_adaptively", lambda s, d: _pixels(register.unmixed_adaptively(rasters.rgb_raster(s, d)), "y", "x", "s0", "s1", "s2", digits=3), RGB + _BASIS_SQL + f" SELECT y, x, {', '.join('round(' + _det(*['pt.' if j == k else f'k{j}' for j in range(3)]) + ' / ' + _det('k0', 'k1', 'k2') + f', 3) AS s{k}' for k in range(3))} FROM pt, ba")
