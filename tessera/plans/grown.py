"""Queries of grey reconstruction, maps, contours, contacts and the further pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, pipelines, segment
from ..operators import enhance, points, regions, register
from ..settings import Windows
from ..sources import rasters
from .catalogue import _PTS, LEVELS, MASK, Q, _add, _mirrored, _on_q, _customers, _levels, _mask, _pixels
from .wider import _rgb_size

# grey reconstruction: every pixel collects the values that reach it under the mask; the greatest counts
_RQ = Q.replace("WITH s AS", "WITH RECURSIVE s AS")


def _rebuilt(name: str, marker: str, mask: str) -> str:
    """CTE ``name`` (y, x, v): the values of table ``marker`` (y, x, v) grown under table ``mask`` (y, x, v)."""
    return f"""{name}_w(y, x, v) AS (SELECT k.y, k.x, least(k.v, m.v)::DOUBLE FROM {marker} k JOIN {mask} m USING (y, x)
    UNION SELECT m.y, m.x, least(w.v, m.v)::DOUBLE FROM {name}_w w JOIN {mask} m ON abs(w.y - m.y) <= 1 AND abs(w.x - m.x) <= 1
    JOIN {marker} k ON k.y = m.y AND k.x = m.x WHERE least(w.v, m.v) > least(k.v, m.v)),
    {name} AS (SELECT y, x, max(v) AS v FROM {name}_w GROUP BY 1, 2)"""


_HIGH = _RQ + ", mk AS (SELECT y, x, v - 8 AS v FROM q), " + _rebuilt("hi", "mk", "q")
_add("h_maxima", lambda s, d: _pixels(kernels.h_maxima(rasters.quantity_raster(s, d), 8), "y", "x", "v"), _HIGH + " SELECT y, x, v FROM hi")
_add("h_minima", lambda s, d: _pixels(kernels.h_minima(rasters.quantity_raster(s, d), 8), "y", "x", "v"), _RQ + ", ng AS (SELECT y, x, -v AS v FROM q), mk AS (SELECT y, x, v - 8 AS v FROM ng), " + _rebuilt("hi", "mk", "ng") + " SELECT y, x, -v AS v FROM hi")
_add(
    "extended_maxima",
    lambda s, d: _pixels(kernels.extended_maxima(rasters.quantity_raster(s, d), 8), "y", "x", "v"),
    _HIGH + """, lo(y, x, v) AS (SELECT a.y, a.x, a.v FROM hi a WHERE EXISTS (SELECT 1 FROM hi b WHERE abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND b.v > a.v)
    UNION SELECT h.y, h.x, h.v FROM lo JOIN hi h ON abs(lo.y - h.y) <= 1 AND abs(lo.x - h.x) <= 1 AND lo.v = h.v)
    SELECT hi.y, hi.x, CASE WHEN lo.y IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM hi LEFT JOIN (SELECT DISTINCT y, x FROM lo) lo ON lo.y = hi.y AND lo.x = hi.x""",
)
_ERODED = "er AS (SELECT a.y, a.x, min(b.v) AS v FROM {0} a JOIN {0} b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2)"
_add("open_by_reconstruction", lambda s, d: _pixels(kernels.opened_by_reconstruction(rasters.quantity_raster(s, d)), "y", "x", "v"), f"{_RQ}, {_ERODED.format('q')}, {_rebuilt('op', 'er', 'q')} SELECT y, x, v FROM op")
_add(
    "close_by_reconstruction",
    lambda s, d: _pixels(kernels.closed_by_reconstruction(rasters.quantity_raster(s, d)), "y", "x", "v"),
    f"{_RQ}, ng AS (SELECT y, x, -v AS v FROM q), {_ERODED.format('ng')}, {_rebuilt('op', 'er', 'ng')} SELECT y, x, -v AS v FROM op",
)
_add(
    "impose_minima",
    lambda s, d: _pixels(kernels.imposed_minima(rasters.quantity_raster(s, d), _mask(s, d)), "y", "x", "v"),
    MASK.replace("WITH s AS", "WITH RECURSIVE s AS") + ", ft AS (SELECT min(v) AS lo, max(v) AS hi, greatest(1e-9::DOUBLE, 0.001::DOUBLE * (max(v) - min(v))) AS st FROM q),"
    + " v0 AS (SELECT q.y, q.x, q.v, CASE WHEN m.y IS NULL THEN hi + st ELSE lo - st END AS k, st FROM ft, q LEFT JOIN m ON q.y = m.y AND q.x = m.x),"
    + " mk AS (SELECT y, x, -k AS v FROM v0), ms AS (SELECT y, x, -least(v + st, k) AS v FROM v0), " + _rebuilt("im", "mk", "ms") + " SELECT y, x, round(-v, 6) AS v FROM im",
)
_add(
    "edge_map",
    lambda s, d: enhance.edges(rasters.quantity_raster(s, d), 1.2).drop("image_id"),
    Q + """, gr AS (SELECT a.y, a.x, sum(sign(b.x - a.x) * (2 - abs(a.y - b.y)) * b.v)::DOUBLE AS gx, sum(sign(b.y - a.y) * (2 - abs(a.x - b.x)) * b.v)::DOUBLE AS gy
    FROM q a JOIN q b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2), sq AS (SELECT *, gx * gx + gy * gy AS s FROM gr),
    k AS (SELECT *, avg(s) OVER () AS m, s >= coalesce(lag(s) OVER r, 0) AND s > coalesce(lead(s) OVER r, 0) AS px, s >= coalesce(lag(s) OVER c, 0) AND s > coalesce(lead(s) OVER c, 0) AS py
    FROM sq WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))
    SELECT y, x FROM k WHERE s > 1.44 * m AND ((px AND abs(gx) >= abs(gy)) OR (py AND abs(gy) > abs(gx)))""",
)

# maps and contours
_MAPS = {2: [(0, 0, 1.5, -0.75), (1, 0, 0.75, 0.125), (0, 1, 0.125, 0.875), (1, 1, 0.0, 0.0625), (2, 0, 0.015625, 0.0), (0, 2, 0.0, 0.0)], 3: [(0, 0, 0.25, 0.5), (1, 0, 0.875, 0.0), (0, 1, 0.0, 0.75), (3, 0, 0.0009765625, 0.0), (0, 3, 0.0, 0.0009765625), (2, 1, 0.0, 0.0)]}
for _degree, _map in _MAPS.items():
    _sx, _sy = (" + ".join(f"{m[i]!r}::DOUBLE * power(x, {m[0]}) * power(y, {m[1]})" for m in _map) for i in (2, 3))
    _add(
        f"warp_polynomial_{_degree}",
        lambda s, d, m=_map: _pixels(register.warped(rasters.quantity_raster(s, d), register.polynomial_places(rasters.quantity_raster(s, d), m), 1.0), "y", "x", "v"),
        Q + f""", p AS (SELECT y, x, round({_sx}, 9) AS sx, round({_sy}, 9) AS sy FROM q), b AS (SELECT max(y) AS my, max(x) AS mx FROM q),
        t AS (SELECT y, x, CAST(least(floor(sy) + i.i, my) AS BIGINT) AS py, CAST(least(floor(sx) + j.j, mx) AS BIGINT) AS px,
        (CASE WHEN i.i = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN j.j = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS k
        FROM p, b, range(0, 2) i(i), range(0, 2) j(j) WHERE sx BETWEEN 0 AND mx AND sy BETWEEN 0 AND my),
        f AS (SELECT t.y, t.x, sum(k * q.v) AS v FROM t JOIN q ON q.y = t.py AND q.x = t.px GROUP BY 1, 2)
        SELECT q.y, q.x, round(coalesce(f.v, 1.0), 6) AS v FROM q LEFT JOIN f ON q.y = f.y AND q.x = f.x""",
    )
_add(
    "level_crossings",
    lambda s, d: _pixels(register.level_crossings(rasters.quantity_raster(s, d), 50.5), "py", "px"),
    Q + """, k AS (SELECT y, x, v - 50.5::DOUBLE AS v, lead(v) OVER r - 50.5::DOUBLE AS n, lead(v) OVER c - 50.5::DOUBLE AS w FROM q WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))
    SELECT round(y, 6)::DOUBLE AS py, round(x + v / (v - n), 6) AS px FROM k WHERE (v < 0) <> (n < 0) UNION ALL SELECT round(y + v / (v - w), 6), round(x, 6)::DOUBLE FROM k WHERE (v < 0) <> (w < 0)""",
)
_add(
    "buffer",
    lambda s, d: regions.buffered(_levels(s, d).filter("v >= 250"), _levels(s, d), 2.5).select("y", "x"),
    LEVELS + " SELECT a.y, a.x FROM lv a WHERE EXISTS (SELECT 1 FROM lv b WHERE b.v >= 250 AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 AND power(a.y - b.y, 2) + power(a.x - b.x, 2) <= 6.25)",
)


def _centres(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return rasters.table(s, d, "supplier").select(F.lit("q").alias("image_id"), k.alias("id"), (k * 7 % 61).cast("double").alias("cx"), (k * 11 % 59).cast("double").alias("cy"))


_add(
    "checked_centres",
    lambda s, d: points.checked_centres(_centres(s, d), _levels(s, d).filter("v >= 60"), 3.0, 20).select("id", F.col("lacking").cast("long").alias("lacking")),
    LEVELS + """, ce AS (SELECT s_suppkey AS id, s_suppkey * 7 % 61 AS cx, s_suppkey * 11 % 59 AS cy FROM supplier), on_ AS (SELECT y, x FROM lv WHERE v >= 60),
    k AS (SELECT ce.id, i.i AS a, j.j AS b, on_.y IS NOT NULL AS hit FROM ce, range(-3, 4) i(i), range(-3, 4) j(j) LEFT JOIN on_ ON on_.y = cy + i.i AND on_.x = cx + j.j WHERE i.i * i.i + j.j * j.j <= 9)
    SELECT id, CAST(count(*) FILTER (NOT hit) AS BIGINT) AS lacking FROM k GROUP BY 1 HAVING count(*) FILTER (NOT hit) < 20 AND bool_or(hit AND a = 0 AND b = 0)""",
)
_add(
    "contacts_of_unequal",
    lambda s, d: points.contacts(_customers(s, d).select(F.col("seq").alias("id"), F.col("px").alias("cx"), F.col("py").alias("cy"), F.when(F.col("seq") % 40 == 0, 12.0).otherwise(0.25 + F.col("seq") % 4 / 8).alias("r"))),
    _PTS + ", c AS (SELECT seq AS id, px, py, CASE WHEN seq % 40 = 0 THEN 12.0::DOUBLE ELSE 0.25 + (seq % 4) / 8.0::DOUBLE END AS r FROM p) SELECT a.id AS src, b.id AS dst FROM c a JOIN c b ON a.id < b.id AND sqrt(power(a.px - b.px, 2) + power(a.py - b.py, 2)) <= 1.1::DOUBLE * (a.r + b.r)",
)

# pipelines
_add("segment_full_colour", lambda s, d: pipelines.segment_full_colour(rasters.rgb_raster(s, d), 20).drop("image_id"))
_add("segment_log_contrast", lambda s, d: pipelines.log_contrast_mask(rasters.rgb_raster(s, d), *_rgb_size(s, d), 3).drop("image_id"))
_add("windows_in_mask", lambda s, d: pipelines.windows_of_interest(_levels(s, d).filter("v >= 0").select("image_id", "y", "x"), Windows(8, 6, 6)).drop("image_id"))
_add("segment_two_means", lambda s, d: segment.two_means(rasters.rgb_raster(s, d), *_rgb_size(s, d)).drop("image_id"))
_add("segment_hysteresis_auto", lambda s, d: segment.hysteresis_from_histogram(_levels(s, d), 200, 2).drop("image_id"))


def _ranked(source: str, rank: int, rule: str) -> str:
    near = _mirrored(source, 2).replace("SELECT a.y, a.x, ", "SELECT a.y, a.x, i.i AS i, j.j AS j, ", 1)
    return f"(SELECT a.y, a.x, list_sort(list(b.v))[{rank}] AS v FROM {near} WHERE {rule} GROUP BY 1, 2)"


_on_q(
    "mixed_median",
    lambda r: enhance.mixed_median(r, 1),
    f", m1 AS {_ranked('q', 11, 'abs(i) + abs(j) < 4')}, m2 AS {_ranked('m1', 13, 'true')}, m3 AS {_ranked('m2', 7, 'abs(i) + abs(j) <= 2')} SELECT y, x, round((q.v + 2 * m3.v) / 3.0::DOUBLE, 6) AS v FROM q JOIN m3 USING (y, x)",
)
_add(
    "border_cleared",
    lambda s, d: _pixels(enhance.border_cleared(rasters.quantity_raster(s, d)), "y", "x", "v"),
    _RQ + ", bx AS (SELECT max(y) AS my, max(x) AS mx, min(v) AS lo FROM q), mk AS (SELECT y, x, CASE WHEN y = 0 OR x = 0 OR y = my OR x = mx THEN v ELSE lo END AS v FROM q, bx), "
    + _rebuilt("ed", "mk", "q") + " SELECT q.y, q.x, q.v - ed.v AS v FROM q JOIN ed USING (y, x)",
)
