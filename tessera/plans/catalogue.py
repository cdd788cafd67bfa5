"""All registered raster, region, point and file queries with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segment
from ..operators import files, points, raster, regions
from ..sources import rasters

Q = """WITH s AS (SELECT l_partkey % 64 AS y, l_suppkey % 64 AS x, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2),
g AS (SELECT a.y, b.x FROM range(0, (SELECT max(y) + 1 FROM s)) a(y), range(0, (SELECT max(x) + 1 FROM s)) b(x)),
q AS (SELECT g.y, g.x, coalesce(s.v, 0) AS v FROM g LEFT JOIN s USING (y, x))"""
E = """WITH e AS (SELECT vec_id AS y, unnest(range(0, len(embedding))) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""
RGB = E + """, w AS (SELECT y, x % 21 AS x, max(CASE WHEN x // 21 = 0 THEN v END) AS r, max(CASE WHEN x // 21 = 1 THEN v END) AS g, max(CASE WHEN x // 21 = 2 THEN v END) AS b
FROM e WHERE x < 63 GROUP BY 1, 2),
c AS (SELECT y, x, (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) AS r, (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) AS g, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS b FROM w)"""
LEVELS = Q + """, lv AS (SELECT y, x, CAST(least(255, floor(255 * (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()))) AS BIGINT) AS v FROM q),
h AS (SELECT v AS bin, count(*) AS n FROM lv GROUP BY 1)"""
OTSU = LEVELS + """, run AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS n0, sum(n * bin) OVER (ORDER BY bin) AS s0, sum(n) OVER () AS nt, sum(n * bin) OVER () AS st FROM h),
o AS (SELECT bin AS threshold FROM run WHERE n0 < nt
ORDER BY round(CAST(n0 AS DOUBLE) * CAST(nt - n0 AS DOUBLE) * power(CAST(s0 AS DOUBLE) / n0 - CAST(st - s0 AS DOUBLE) / (nt - n0), 2), 3) DESC, bin LIMIT 1)"""
MASK = OTSU + ", m AS (SELECT y, x FROM lv, o WHERE v > threshold)"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Callable, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _pixels(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) if kinds[c] == "double" else F.col(c)).alias(c) for c in columns])


def _on_q(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    _add(name, lambda s, d: _pixels(f(rasters.quantity_raster(s, d)), "y", "x", "v"), sql and Q + sql)


def _on_e(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    _add(name, lambda s, d: _pixels(f(rasters.embedding_raster(s, d)), "y", "x", "v"), sql and E + sql)


def _levels(s: SparkSession, d: str) -> DataFrame:
    return raster.levels(rasters.quantity_raster(s, d))


def _mask(s: SparkSession, d: str) -> DataFrame:
    q = _levels(s, d)
    return raster.binarize(q, raster.otsu(q))


def _size(s: SparkSession, d: str) -> tuple[int, int]:
    r = rasters.quantity_raster(s, d).agg(F.max("y"), F.max("x")).first()
    return r[0] + 1, r[1] + 1


# pointwise and colour
_on_q("complement", raster.complement, " SELECT y, x, 1 - v AS v FROM q")
_on_e("rescale", raster.rescale, " SELECT y, x, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS v FROM e")
_on_q("double_scaled", raster.double_scaled, " SELECT y, x, round((v - least(0.0, min(v) OVER ())) / (greatest(1.0, max(v) OVER ()) - least(0.0, min(v) OVER ())), 6) AS v FROM q")
_on_q("adjust_contrast", raster.adjust, ", k AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM q) SELECT y, x, round(greatest(0.0, least(1.0, (v - lo) / (hi - lo))), 6) AS v FROM q, k")
_add("gray", lambda s, d: _pixels(raster.gray(rasters.rgb_raster(s, d)), "y", "x", "v"), RGB + " SELECT y, x, round(0.2989 * r + 0.5870 * g + 0.1140 * b, 6) AS v FROM c")
_add("mean_channels", lambda s, d: _pixels(raster.mean_channels(rasters.rgb_raster(s, d)), "y", "x", "v"), RGB + ", t AS (SELECT y, x, r + g + b AS v FROM c) SELECT y, x, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS v FROM t")
_LINE = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE power(({0} + 0.055) / 1.055, 2.4) END"
_XYZ = RGB + f", t AS (SELECT y, x, {_LINE.format('r')} AS r, {_LINE.format('g')} AS g, {_LINE.format('b')} AS b FROM c), z AS (SELECT y, x, " + ", ".join(f"{a} * r + {b} * g + {c} * b AS {n}" for n, (a, b, c) in zip(("cx", "cy", "cz"), raster.TO_XYZ, strict=True)) + " FROM t)"
_add("to_xyz", lambda s, d: _pixels(raster.xyz(rasters.rgb_raster(s, d)), "y", "x", "cx", "cy", "cz"), _XYZ + " SELECT y, x, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM z")
_BEND = "CASE WHEN {0} > 216.0::DOUBLE / 24389 THEN power({0}, 1.0::DOUBLE / 3) ELSE (24389.0::DOUBLE / 27 * {0} + 16) / 116 END"
_add("to_lab", lambda s, d: _pixels(raster.lab(rasters.rgb_raster(s, d)), "y", "x", "l", "a", "b", digits=4), _XYZ + ", f AS (SELECT y, x, " + ", ".join(f"{_BEND.format(f'({n} / {w}::DOUBLE)')} AS f{n}" for n, w in zip(("cx", "cy", "cz"), raster.WHITE, strict=True)) + " FROM z) SELECT y, x, round(116 * fcy - 16, 4) AS l, round(500 * (fcx - fcy), 4) AS a, round(200 * (fcy - fcz), 4) AS b FROM f")
_add("to_hsv", lambda s, d: _pixels(raster.hsv(rasters.rgb_raster(s, d)), "y", "x", "h", "s", "v"), RGB + """, k AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM c)
SELECT y, x, round(CASE WHEN d = 0 THEN 0 WHEN hi = r THEN ((g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END) WHEN hi = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6, 6) AS h,
round(CASE WHEN hi = 0 THEN 0 ELSE d / hi END, 6) AS s, round(hi, 6) AS v FROM k""")
_BASIS = [[0.6, 0.2, 0.1], [0.5, 0.3, 0.2], [0.2, 0.1, 0.7]]
_INV = np.linalg.inv(np.array(_BASIS)).tolist()
_add("unmix_stains", lambda s, d: _pixels(raster.unmix(rasters.rgb_raster(s, d), _BASIS), "y", "x", "s0", "s1", "s2"), _XYZ + ", u AS (SELECT y, x, " + ", ".join(f"({a!r}::DOUBLE) * cx + ({b!r}::DOUBLE) * cy + ({c!r}::DOUBLE) * cz AS s{j}" for j, (a, b, c) in enumerate(_INV)) + " FROM z) SELECT y, x, " + ", ".join(f"round((s{j} - min(s{j}) OVER ()) / (max(s{j}) OVER () - min(s{j}) OVER ()), 6) AS s{j}" for j in range(3)) + " FROM u")


# neighbourhoods
def _taps(taps: list[float], along: str, across: str, source: str) -> str:
    half = len(taps) // 2
    part = lambda i: "v" if i == half else f"{'lead' if i > half else 'lag'}(v, {abs(i - half)}, 0) OVER t"
    return f"(SELECT y, x, {' + '.join(f'({k!r}::DOUBLE) * {part(i)}' for i, k in enumerate(taps) if k)} AS v FROM {source} WINDOW t AS (PARTITION BY {across} ORDER BY {along}))"


for _n, _a, _b in (("x", raster.FIRST7, raster.SMOOTH7), ("y", raster.SMOOTH7, raster.FIRST7), ("xx", raster.SECOND7, raster.SMOOTH7), ("yy", raster.SMOOTH7, raster.SECOND7), ("xy", raster.FIRST7, raster.FIRST7)):
    _on_e(f"derivative7_{_n}", lambda r, n=_n: raster.derivative(r, n), f" SELECT y, x, round(v, 6) AS v FROM {_taps(_b, 'y', 'x', _taps(_a, 'x', 'y', 'e'))}")
_G = [np.exp(-(i * i) / (2 * 1.2 * 1.2)) for i in range(-3, 4)]
_G = [float(k / sum(_G)) for k in _G]
_on_e("gaussian", raster.gaussian, f" SELECT y, x, round(v, 6) AS v FROM {_taps(_G, 'y', 'x', _taps(_G, 'x', 'y', 'e'))}")


def _fractional(source: str, order: float) -> str:
    """The fractional derivative of a raster of at least four rows and columns, where n is 2."""
    one, two = -order, order * (order - 1) / 2
    return f"""(SELECT y, x, (CASE x
    WHEN 0 THEN a + ({one!r}::DOUBLE) * lead(a, 1, 0) OVER t
    WHEN 1 THEN lag(a, 1, 0) OVER t + ({one!r}::DOUBLE) * a + ({two!r}::DOUBLE) * lead(a, 1, 0) OVER t
    ELSE lag(a, 2, 0) OVER t + ({one!r}::DOUBLE) * lag(a, 1, 0) OVER t + ({two!r}::DOUBLE) * a END
    + a + ({one!r}::DOUBLE) * lead(a, 1, 0) OVER t + ({two!r}::DOUBLE) * lead(a, 2, 0) OVER t)
    / 2 / power(2.0::DOUBLE * my * mx / ((my + 1) * (mx + 1)), {order + 1!r}::DOUBLE) AS v
    FROM (SELECT y, x, my, mx, CASE WHEN y < my AND x < mx THEN v * {2.0 ** (order + 1)!r}::DOUBLE ELSE 0 END AS a
    FROM {source}, (SELECT max(y) AS my, max(x) AS mx FROM {source})) WINDOW t AS (PARTITION BY y ORDER BY x))"""


_on_e("fractional_derivative", raster.fractional_derivative, f" SELECT y, x, round(v, 6) AS v FROM {_fractional('e', 0.5)}")
_NEAR = "(SELECT a.y, a.x, {0} AS v FROM q a JOIN q b ON abs(a.y - b.y) <= {1} AND abs(a.x - b.x) <= {1} GROUP BY 1, 2)"
for _n, _f, _s in (("erode", raster.erode, "min(b.v)"), ("dilate", raster.dilate, "max(b.v)"), ("local_range", raster.local_range, "max(b.v) - min(b.v)"), ("box_sum", lambda r: raster.square_agg(r, 1, F.sum), "CAST(sum(b.v) AS BIGINT)")):
    _on_q(_n, _f, f" SELECT * FROM {_NEAR.format(_s, 1)}")
_MORPH = ", p1 AS (SELECT a.y, a.x, {0}(b.v) AS v FROM q a JOIN q b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2), p2 AS (SELECT a.y, a.x, {1}(b.v) AS v FROM p1 a JOIN p1 b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2)"
_on_q("open", raster.opened, _MORPH.format("min", "max") + " SELECT * FROM p2")
_on_q("close", raster.closed, _MORPH.format("max", "min") + " SELECT * FROM p2")
_on_q("top_hat", raster.top_hat, _MORPH.format("min", "max") + " SELECT y, x, q.v - p2.v AS v FROM q JOIN p2 USING (y, x)")
_on_q("bottom_hat", raster.bottom_hat, _MORPH.format("max", "min") + " SELECT y, x, p2.v - q.v AS v FROM q JOIN p2 USING (y, x)")
_DISK2 = "b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 AND power(a.y - b.y, 2) + power(a.x - b.x, 2) <= 4"
_on_q(
    "background_correction",
    lambda r: raster.background_corrected(r, 2, pad=1),
    f""", bx AS (SELECT max(y) AS my, max(x) AS mx FROM q),
    i AS (SELECT CAST(u.i AS BIGINT) AS y, CAST(w.i AS BIGINT) AS x, 1 - q.v AS v FROM bx, range(-1, (SELECT my + 2 FROM bx)) u(i), range(-1, (SELECT mx + 2 FROM bx)) w(i)
    JOIN q ON q.y = greatest(0, least(my, u.i)) AND q.x = greatest(0, least(mx, w.i))),
    p1 AS (SELECT a.y, a.x, min(b.v) AS v FROM i a JOIN i b ON {_DISK2} GROUP BY 1, 2), p2 AS (SELECT a.y, a.x, max(b.v) AS v FROM p1 a JOIN p1 b ON {_DISK2} GROUP BY 1, 2)
    SELECT y, x, 1 - (i.v - p2.v) AS v FROM i JOIN p2 USING (y, x), bx WHERE y BETWEEN 0 AND my AND x BETWEEN 0 AND mx""",
)
_SORTED = "list_sort(list_concat(list(b.v), [0 for k in range(0, 9 - count(*))]))"
_on_q("median3", raster.median_filter, f" SELECT * FROM {_NEAR.format(f'CAST({_SORTED}[5] AS BIGINT)', 1)}")
_on_q("order_filter", lambda r: raster.order_filter(r, 7), f" SELECT * FROM {_NEAR.format(f'CAST({_SORTED}[7] AS BIGINT)', 1)}")
_on_q("laplacian", lambda r: raster.filter_kernel(r, [[0, 1, 0], [1, -4, 1], [0, 1, 0]]), f" SELECT * FROM {_NEAR.format('CAST(sum(CASE WHEN a.y = b.y AND a.x = b.x THEN -4 * b.v WHEN abs(a.y - b.y) + abs(a.x - b.x) = 1 THEN b.v ELSE 0 END) AS DOUBLE)', 1)}")
_on_q("sobel", raster.sobel, f" SELECT * FROM {_NEAR.format('round(sqrt(power(sum(sign(b.x - a.x) * (2 - abs(a.y - b.y)) * b.v), 2) + power(sum(sign(b.y - a.y) * (2 - abs(a.x - b.x)) * b.v), 2)), 6)', 1)}")


def _mirrored(source: str, half: int) -> str:
    """Pairs a, b of each pixel and those around it, mirrored at the border with the edge pixel."""
    fold = lambda c, m: f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > {m} THEN 2 * {m} + 1 - ({c}) ELSE {c} END"
    return f"""(SELECT a.y, a.x, {fold('a.y + i.i', 'my')} AS by_, {fold('a.x + j.j', 'mx')} AS bx FROM {source} a,
    range({-half}, {half + 1}) i(i), range({-half}, {half + 1}) j(j), (SELECT max(y) AS my, max(x) AS mx FROM {source}) k) a
    JOIN {source} b ON b.y = a.by_ AND b.x = a.bx"""


_on_q("local_std", raster.local_std, f" SELECT a.y, a.x, round(stddev_samp(b.v), 6) AS v FROM {_mirrored('q', 1)} GROUP BY 1, 2")
_add(
    "local_entropy",
    lambda s, d: _pixels(raster.local_entropy(_levels(s, d), 2), "y", "x", "v"),
    LEVELS + f", n AS (SELECT a.y, a.x, b.v AS k, count(*) AS c FROM {_mirrored('lv', 2)} GROUP BY 1, 2, 3) SELECT y, x, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS v FROM n GROUP BY 1, 2",
)
_add("cooccurrence", lambda s, d: raster.cooccurrence(_levels(s, d).withColumn("v", F.floor(F.col("v") / 32))).drop("image_id"), LEVELS + ", k AS (SELECT v // 32 AS i, lead(v // 32) OVER (PARTITION BY y ORDER BY x) AS j FROM lv) SELECT i, j, count(*) AS count FROM k WHERE j IS NOT NULL GROUP BY 1, 2")

# histograms and thresholds
_add("levels", lambda s, d: _levels(s, d).drop("image_id"), LEVELS + " SELECT y, x, v FROM lv")
_add("histogram", lambda s, d: raster.histogram(_levels(s, d)).drop("image_id"), LEVELS + " SELECT bin, n FROM h")
_add("otsu_threshold", lambda s, d: raster.otsu(_levels(s, d)).drop("image_id"), OTSU + " SELECT threshold FROM o")
_add("otsu_mask", lambda s, d: _mask(s, d).drop("image_id"), MASK + " SELECT y, x FROM m")
_add("equalize", lambda s, d: _pixels(raster.equalized(_levels(s, d)), "y", "x", "v"), LEVELS + ", c AS (SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS DOUBLE) / sum(n) OVER () AS c FROM h) SELECT y, x, round(c, 6) AS v FROM lv JOIN c ON bin = v")
_add("histogram_match", lambda s, d: raster.match_histogram(_levels(s, d), _levels(s, d).withColumn("v", F.floor(F.col("v") / 2))).drop("image_id"), LEVELS + ", a AS (SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS DOUBLE) / sum(n) OVER () AS c FROM h), f AS (SELECT bin // 2 AS bin, sum(n) AS n FROM h GROUP BY 1), b AS (SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS DOUBLE) / sum(n) OVER () AS c FROM f), r AS (SELECT a.bin, min(b.bin) AS t FROM a JOIN b ON b.c >= a.c - 1e-12 GROUP BY 1) SELECT y, x, t AS v FROM lv JOIN r ON bin = v")
_add("mode", lambda s, d: raster.mode(_levels(s, d)).drop("image_id"), LEVELS + " SELECT bin AS v, n FROM h ORDER BY n DESC, bin LIMIT 1")
_FD = """, fw AS (SELECT min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, 2 * (quantile_cont(v::DOUBLE, 0.75) - quantile_cont(v::DOUBLE, 0.25)) * power(count(*)::DOUBLE, {third}::DOUBLE) AS w FROM {src}),
fb AS (SELECT lo, w, CASE WHEN w > 0 THEN CAST(greatest(1, ceil((hi - lo) / w)) AS BIGINT) ELSE 1 END AS k FROM fw),
fc AS (SELECT CASE WHEN w > 0 THEN least(k - 1, CAST(floor((v::DOUBLE - lo) / w) AS BIGINT)) ELSE 0 END AS bin, count(*) AS n FROM {src}, fb GROUP BY 1),
fd AS (SELECT CAST(r.i AS BIGINT) AS bin, lo + r.i * greatest(w, 0.0) AS edge, coalesce(fc.n, 0) AS n FROM fb, range(0, (SELECT k FROM fb)) r(i) LEFT JOIN fc ON fc.bin = r.i)""".replace("{third}", repr(-1 / 3))
_add(
    "freedman_diaconis",
    lambda s, d: _pixels(raster.freedman_diaconis(rasters.embedding_raster(s, d)), "bin", "left", "n").withColumnRenamed("left", "edge"),
    E + _FD.format(src="e") + " SELECT bin, round(edge, 6) AS edge, n FROM fd",
)
_add(
    "valley",
    lambda s, d: _pixels(raster.valley(rasters.embedding_raster(s, d)), "valley"),
    E + _FD.format(src="e") + ", fl AS (SELECT edge, n, lead(n) OVER t AS a, lead(n, 2) OVER t AS b FROM fd WINDOW t AS (ORDER BY bin)) SELECT round(min(edge), 6) AS valley FROM fl WHERE a < n AND b >= a HAVING count(*) > 0",
)
_add("top_share", lambda s, d: raster.top_share(_levels(s, d)).drop("image_id"), LEVELS + ", c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS c, sum(n) OVER () AS t FROM h) SELECT min(bin) AS threshold FROM c WHERE c > 0.96 * t")
_add(
    "minimum_near_otsu",
    lambda s, d: raster.minimum_near_otsu(_levels(s, d)).drop("image_id"),
    OTSU + ", w AS (SELECT bin, least(lag(n) OVER t, lead(n) OVER t) - n AS depth, lag(n) OVER t AS a, lead(n) OVER t AS b FROM h WINDOW t AS (ORDER BY bin)), k AS (SELECT bin FROM w WHERE depth > 0 AND a IS NOT NULL AND b IS NOT NULL ORDER BY depth DESC, bin LIMIT 4) SELECT coalesce((SELECT bin FROM k, o ORDER BY abs(bin - threshold), bin LIMIT 1), threshold) AS threshold FROM o",
)
_add("quantiles", lambda s, d: _pixels(raster.quantiles(rasters.embedding_raster(s, d), [0.0, 0.4, 0.75, 1.0]), "q0", "q1", "q2", "q3"), E + " SELECT " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS q{k}" for k, q in enumerate((0.0, 0.4, 0.75, 1.0))) + " FROM e")
_add("histogram_peaks", lambda s, d: raster.local_maxima(_levels(s, d)).drop("image_id"), LEVELS + ", k AS (SELECT bin, n, lag(n) OVER (ORDER BY bin) AS a, lead(n) OVER (ORDER BY bin) AS b FROM h) SELECT bin, n FROM k WHERE a < n AND b < n")
_add("otsu_foreground_rows", lambda s, d: _mask(s, d).groupBy("y").agg(F.count(F.lit(1)).alias("n")), MASK + " SELECT y, count(*) AS n FROM m GROUP BY 1")
_add(
    "multi_thresholds",
    lambda s, d: segment.multi_otsu(_levels(s, d), 2).drop("image_id"),
    LEVELS + """, c AS (SELECT bin, sum(n) OVER t::DOUBLE AS n, sum(n * bin) OVER t::DOUBLE AS s FROM h WINDOW t AS (ORDER BY bin)),
    t AS (SELECT max(n) AS n, max(s) AS s FROM c),
    k AS (SELECT a.bin AS a, b.bin AS b, a.s * a.s / a.n + power(b.s - a.s, 2) / (b.n - a.n) + power(t.s - b.s, 2) / (t.n - b.n) AS w FROM c a, c b, t WHERE a.bin < b.bin AND b.n < t.n),
    best AS (SELECT a, b FROM k ORDER BY round(w, 6) DESC, b, a LIMIT 1)
    SELECT CAST(0 AS INTEGER) AS k, a AS threshold FROM best UNION ALL SELECT 1, b FROM best""",
)

# masks and regions
_add("perimeter", lambda s, d: raster.perimeter(_mask(s, d)).drop("image_id"), MASK + " SELECT y, x FROM m a WHERE (SELECT count(*) FROM m b WHERE abs(a.y - b.y) + abs(a.x - b.x) = 1) < 4")
_CC = MASK.replace("WITH s AS", "WITH RECURSIVE s AS") + """, p AS (SELECT a.x * 2147483648 + a.y AS a, b.x * 2147483648 + b.y AS b FROM m a JOIN m b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
l AS (SELECT CAST(a % 2147483648 AS BIGINT) AS y, CAST(a // 2147483648 AS BIGINT) AS x, min(b) AS label FROM r GROUP BY a),
z AS (SELECT label, count(*) AS area FROM l GROUP BY 1)"""


def _labels(s: SparkSession, d: str, tile: int = regions.TILE) -> DataFrame:
    return regions.label(_mask(s, d), tile=tile)


_add("components", lambda s, d: _labels(s, d).drop("image_id"), _CC + " SELECT y, x, label FROM l")
_add("region_properties", lambda s, d: _pixels(regions.properties(_labels(s, d)), "label", "area", "cy", "cx", "y0", "y1", "x0", "x1"), _CC + " SELECT label, count(*) AS area, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM l GROUP BY 1")
_add("area_open", lambda s, d: regions.area_open(_labels(s, d), 3).drop("image_id"), _CC + " SELECT y, x FROM l JOIN z USING (label) WHERE area >= 3")
_add("largest_region", lambda s, d: regions.largest(_labels(s, d)).drop("image_id"), _CC + " SELECT y, x FROM l WHERE label = (SELECT label FROM z ORDER BY area DESC, label LIMIT 1)")
_add("clear_border", lambda s, d: regions.clear_border(_labels(s, d), *_size(s, d)).drop("image_id"), _CC + " SELECT y, x FROM l WHERE label NOT IN (SELECT label FROM l WHERE y = 0 OR x = 0 OR y = (SELECT max(y) FROM q) OR x = (SELECT max(x) FROM q))")
_add("reconstruct", lambda s, d: regions.reconstruct(_labels(s, d), _levels(s, d).filter("v >= 250")).drop("image_id"), _CC + " SELECT y, x FROM l WHERE label IN (SELECT label FROM l JOIN lv USING (y, x) WHERE v >= 250)")
_add("euler_number", lambda s, d: raster.euler_number(_mask(s, d)).drop("image_id"), MASK + ", w AS (SELECT m.y + a.i AS qy, m.x + b.i AS qx, sum(power(2, 2 * a.i + b.i)) AS q, count(*) AS n FROM m, range(0, 2) a(i), range(0, 2) b(i) GROUP BY 1, 2) SELECT CAST((sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN q IN (6, 9) THEN -2 ELSE 0 END)) / 4 AS BIGINT) AS euler FROM w")
_add("fill_holes", lambda s, d: regions.fill_holes(_mask(s, d), _levels(s, d), *_size(s, d)).drop("image_id"), MASK.replace("WITH s AS", "WITH RECURSIVE s AS") + ", k AS (SELECT y, x FROM q EXCEPT SELECT y, x FROM m), r(y, x) AS (SELECT y, x FROM k WHERE y = 0 OR x = 0 OR y = (SELECT max(y) FROM q) OR x = (SELECT max(x) FROM q) UNION SELECT k.y, k.x FROM r JOIN k ON abs(r.y - k.y) + abs(r.x - k.x) = 1) SELECT y, x FROM q EXCEPT SELECT y, x FROM r")
_add(
    "regional_maxima",
    lambda s, d: regions.regional_maxima(rasters.quantity_raster(s, d)).drop("image_id"),
    Q.replace("WITH s AS", "WITH RECURSIVE s AS") + """, w(y, x, v) AS (SELECT a.y, a.x, a.v FROM q a WHERE EXISTS (SELECT 1 FROM q b WHERE abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND b.v > a.v)
    UNION SELECT q.y, q.x, q.v FROM w JOIN q ON abs(w.y - q.y) <= 1 AND abs(w.x - q.x) <= 1 AND w.v = q.v)
    SELECT y, x FROM q EXCEPT SELECT y, x FROM w""",
)
_add("distance_transform", lambda s, d: _pixels(regions.distance_to(_mask(s, d), _levels(s, d).join(_mask(s, d), ["image_id", "y", "x"], "left_anti")), "y", "x", "distance"), MASK + ", k AS (SELECT y, x FROM q EXCEPT SELECT y, x FROM m) SELECT m.y, m.x, round(min(sqrt(power(m.y - k.y, 2) + power(m.x - k.x, 2))), 6) AS distance FROM m, k GROUP BY 1, 2")
_add(
    "clean_mask",
    lambda s, d: regions.cleaned(_labels(s, d), 2.5, 2).drop("image_id"),
    _CC + """, big AS (SELECT y, x FROM l WHERE label = (SELECT label FROM z ORDER BY area DESC, label LIMIT 1))
    SELECT y, x FROM l WHERE label IN (SELECT label FROM l JOIN z USING (label) WHERE area >= 2 AND EXISTS (SELECT 1 FROM big WHERE power(big.y - l.y, 2) + power(big.x - l.x, 2) <= 6.25))
    OR (SELECT max(area) FROM z) < 2""",
)
_add(
    "quadrants",
    lambda s, d: raster.quadrants_filled(_mask(s, d), *_size(s, d)).drop("image_id"),
    MASK + """, w AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM q)
    SELECT bool_or(y + 1 <= ceil(h / 2.0) AND x + 1 <= ceil(w.w / 2.0)) AND bool_or(y + 1 >= floor(h / 2.0) AND x + 1 <= ceil(w.w / 2.0))
    AND bool_or(y + 1 <= ceil(h / 2.0) AND x + 1 >= floor(w.w / 2.0)) AND bool_or(y + 1 >= floor(h / 2.0) AND x + 1 >= floor(w.w / 2.0)) AS filled FROM m, w""",
)


# geometry of rasters
_on_q("rotate90", lambda r: raster.rotated90(r, 1), " SELECT (SELECT max(x) FROM q) - x AS y, y AS x, v FROM q")
_on_q("rotate270", lambda r: raster.rotated90(r, 3), " SELECT x AS y, (SELECT max(y) FROM q) - y AS x, v FROM q")
_on_q("flip", raster.flipped, " SELECT y, (SELECT max(x) FROM q) - x AS x, v FROM q")
_on_q("cyclic_shift", lambda r: raster.shifted(r, 3, -2), " SELECT (y + 3) % (SELECT max(y) + 1 FROM q) AS y, (x - 2 + (SELECT max(x) + 1 FROM q)) % (SELECT max(x) + 1 FROM q) AS x, v FROM q")
_on_q("crop", lambda r: raster.cropped(r, 2, 3, 5, 6), " SELECT y - 2 AS y, x - 3 AS x, v FROM q WHERE y BETWEEN 2 AND 6 AND x BETWEEN 3 AND 8")
_PAD = ", b AS (SELECT max(y) AS my, max(x) AS mx FROM q), p AS (SELECT CAST(a.i AS BIGINT) AS y, CAST(c.i AS BIGINT) AS x FROM range(0, (SELECT my + 7 FROM b)) a(i), range(0, (SELECT mx + 7 FROM b)) c(i))"
_on_q("pad_replicate", lambda r: raster.padded(r, 3), _PAD + " SELECT p.y, p.x, q.v FROM p, b JOIN q ON q.y = greatest(0, least(my, p.y - 3)) AND q.x = greatest(0, least(mx, p.x - 3))")
_on_q("pad_constant", lambda r: raster.padded(r, 3, 0), _PAD + " SELECT p.y, p.x, coalesce(q.v, 0) AS v FROM p LEFT JOIN q ON q.y = p.y - 3 AND q.x = p.x - 3")
_on_q("shrink", raster.shrunk, " SELECT y // 2 AS y, x // 2 AS x, round(avg(v), 6) AS v FROM q GROUP BY 1, 2")
_on_q("warp_affine", lambda r: raster.affine_bilinear(r, 0.75, 0.25, -0.25, 0.75, 1.5, 2.25), ", t AS (SELECT y, x, 0.75::DOUBLE * x + 0.25::DOUBLE * y + 1.5::DOUBLE AS sx, -0.25::DOUBLE * x + 0.75::DOUBLE * y + 2.25::DOUBLE AS sy FROM q), k AS (SELECT t.y, t.x, CAST(floor(sy) AS BIGINT) + a.i AS py, CAST(floor(sx) AS BIGINT) + b.i AS px, (CASE WHEN a.i = 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE WHEN b.i = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS w FROM t, range(0, 2) a(i), range(0, 2) b(i)) SELECT k.y, k.x, round(sum(w * coalesce(q.v, 0)), 6) AS v FROM k LEFT JOIN q ON q.y = py AND q.x = px GROUP BY 1, 2")

# comparisons
_add("compare_images", lambda s, d: _pixels(raster.compare(rasters.quantity_raster(s, d), raster.shifted(rasters.quantity_raster(s, d), 1, 0)), "mse", "r", digits=4), Q + ", k AS (SELECT (y + 1) % (SELECT max(y) + 1 FROM q) AS y, x, v AS w FROM q) SELECT round(avg(power(v - w, 2)), 4) AS mse, round(corr(v, w), 4) AS r FROM q JOIN k USING (y, x)")
_add("dice", lambda s, d: _pixels(raster.dice(_mask(s, d), raster.shifted(_levels(s, d), 1, 0).filter("v >= 128").drop("v")), "dice"), MASK + ", k AS (SELECT (y + 1) % (SELECT max(y) + 1 FROM q) AS y, x FROM lv WHERE v >= 128) SELECT round(2.0 * (SELECT count(*) FROM m JOIN k USING (y, x)) / ((SELECT count(*) FROM m) + (SELECT count(*) FROM k)), 6) AS dice")
_add("combine_masks", lambda s, d: raster.combined(_mask(s, d), _levels(s, d).filter("v % 2 = 0").drop("v"), _levels(s, d).filter("v < 240").drop("v")).drop("image_id"), MASK + " SELECT y, x FROM m JOIN lv USING (y, x) WHERE v % 2 = 0 AND v < 240")

# points
_PTS = "WITH p AS (SELECT 'customer' AS set, c_custkey AS seq, CAST(c_custkey % 97 AS DOUBLE) AS px, CAST(c_custkey * 7919 % 101 AS DOUBLE) AS py FROM customer)"


def _customers(s: SparkSession, d: str) -> DataFrame:
    c = rasters.table(s, d, "customer")
    return c.select(F.lit("customer").alias("set"), F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 97).cast("double").alias("px"), (F.col("c_custkey") * 7919 % 101).cast("double").alias("py"))


_add("unique_points", lambda s, d: points.dedupe(_customers(s, d), ["px", "py"]).select("seq", "px", "py"), _PTS + " SELECT min(seq) AS seq, px, py FROM p GROUP BY px, py")
_add("corner_points", lambda s, d: points.corners(_customers(s, d)).drop("set"), _PTS + ", b AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM p), c AS (SELECT 'tl' AS corner, x0 AS qx, y0 AS qy FROM b UNION ALL SELECT 'tr', x1, y0 FROM b UNION ALL SELECT 'br', x1, y1 FROM b UNION ALL SELECT 'bl', x0, y1 FROM b), k AS (SELECT corner, seq, px, py, row_number() OVER (PARTITION BY corner ORDER BY sqrt(power(px - qx, 2) + power(py - qy, 2)), seq) AS n FROM p, c) SELECT corner, seq, px, py FROM k WHERE n = 1")
_add("nearest_points", lambda s, d: _pixels(points.nearest(_customers(s, d), [(10.5, 20.25), (50.25, 50.5)]), "target", "seq", "distance"), _PTS + ", t AS (SELECT 0 AS target, 10.5 AS qx, 20.25 AS qy UNION ALL SELECT 1, 50.25, 50.5), k AS (SELECT target, seq, sqrt(power(px - qx, 2) + power(py - qy, 2)) AS d FROM p, t) SELECT target, arg_min(seq, round(d, 9) + seq * 1e-12) AS seq, round(min(d), 6) AS distance FROM k GROUP BY 1")
_add("points_in_polygon", lambda s, d: points.inside(_customers(s, d), [(10.5, 10.5), (80.5, 20.5), (60.5, 90.5)]).select("seq"), _PTS + ", e AS (SELECT 10.5 AS ax, 10.5 AS ay, 80.5 AS bx, 20.5 AS by_ UNION ALL SELECT 80.5, 20.5, 60.5, 90.5 UNION ALL SELECT 60.5, 90.5, 10.5, 10.5) SELECT seq FROM p, e WHERE ((ay > py) <> (by_ > py)) AND px < (bx - ax) * (py - ay) / (by_ - ay) + ax GROUP BY seq HAVING count(*) % 2 = 1")


def _routes(s: SparkSession, d: str) -> DataFrame:
    """All customers as polylines: one a nation, in the order of their keys."""
    c = rasters.table(s, d, "customer")
    return c.select(F.col("c_nationkey").cast("string").alias("set"), F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 97).cast("double").alias("px"), (F.col("c_custkey") * 7919 % 101).cast("double").alias("py"))


_ROUTES = "WITH p AS (SELECT CAST(c_nationkey AS VARCHAR) AS set, c_custkey AS seq, CAST(c_custkey % 97 AS DOUBLE) AS px, CAST(c_custkey * 7919 % 101 AS DOUBLE) AS py FROM customer)"
_ALONG = "WINDOW t AS (PARTITION BY set ORDER BY seq)"
_add("polygon_area", lambda s, d: _pixels(points.polygon_area(_routes(s, d)), "set", "area"), _ROUTES + f", k AS (SELECT set, px, py, coalesce(lead(px) OVER t, first_value(px) OVER t) AS nx, coalesce(lead(py) OVER t, first_value(py) OVER t) AS ny FROM p {_ALONG}) SELECT set, round(abs(sum(px * ny - nx * py)) / 2, 6) AS area FROM k GROUP BY 1")
_add("path_length", lambda s, d: _pixels(points.path_length(_routes(s, d)), "set", "seq", "s"), _ROUTES + f", k AS (SELECT set, seq, coalesce(sqrt(power(px - lag(px) OVER t, 2) + power(py - lag(py) OVER t, 2)), 0) AS t FROM p {_ALONG}) SELECT set, seq, round(sum(t) OVER (PARTITION BY set ORDER BY seq), 6) AS s FROM k")
_add("densify_polyline", lambda s, d: _pixels(points.densified(_routes(s, d), 10.0), "seq", "part", "px", "py"), _ROUTES + f", k AS (SELECT seq, px, py, lead(px) OVER t AS qx, lead(py) OVER t AS qy FROM p {_ALONG}), n AS (SELECT *, CAST(coalesce(greatest(1, ceil(sqrt(power(qx - px, 2) + power(qy - py, 2)) / 10)), 1) AS INTEGER) AS n FROM k), u AS (SELECT *, unnest(range(0, n)) AS part FROM n) SELECT seq, CAST(part AS INTEGER) AS part, round(px + CAST(part AS DOUBLE) / n * (coalesce(qx, px) - px), 6) AS px, round(py + CAST(part AS DOUBLE) / n * (coalesce(qy, py) - py), 6) AS py FROM u")
_add("simplify_polyline", lambda s, d: points.simplified(_routes(s, d), 6.0).select("seq"), _ROUTES + f", k AS (SELECT seq, px, py, lag(px) OVER t AS ax, lag(py) OVER t AS ay, lead(px) OVER t AS bx, lead(py) OVER t AS by_ FROM p {_ALONG}) SELECT seq FROM k WHERE (ax IS NULL OR bx IS NULL OR abs((px - ax) * (by_ - ay) - (py - ay) * (bx - ax)) > 1e-9) AND (ax IS NULL OR sqrt(power(px - ax, 2) + power(py - ay, 2)) >= 6)")
_add("convex_hull", lambda s, d: points.convex_hull(_customers(s, d)).select("px", "py"))
_add("circle_contacts", lambda s, d: points.contacts(_customers(s, d).select(F.col("seq").alias("id"), F.col("px").alias("cx"), F.col("py").alias("cy"), ((F.col("seq") % 3 + 1) * 0.3).alias("r"))), _PTS + ", c AS (SELECT seq AS id, px, py, (seq % 3 + 1) * 0.3::DOUBLE AS r FROM p) SELECT a.id AS src, b.id AS dst FROM c a JOIN c b ON a.id < b.id AND sqrt(power(a.px - b.px, 2) + power(a.py - b.py, 2)) <= 1.1::DOUBLE * (a.r + b.r)")
_add(
    "hex_lattice",
    lambda s, d: _pixels(points.hex_lattice(s, _size(s, d)[1], 5.0, math.ceil(_size(s, d)[0] / (5 * math.sqrt(3)))), "row", "col", "cx", "cy"),
    Q + """, w AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM q)
    SELECT CAST(r.i AS BIGINT) AS row, CAST(c.i AS BIGINT) AS col, round(-w + 10.0::DOUBLE * c.i + 5.0::DOUBLE * r.i, 6) AS cx, round(1 + r.i * 5.0::DOUBLE * sqrt(3), 6) AS cy
    FROM w, range(0, (SELECT CAST(ceil(h / (5 * sqrt(3))) AS BIGINT) FROM w)) r(i), range(0, (SELECT CAST(floor(2 * w / 10.0) + 1 AS BIGINT) FROM w)) c(i)""",
)
_TRI = "WITH t AS (SELECT c_custkey AS id, CAST(c_custkey % 13 AS DOUBLE) AS ax, CAST(c_custkey % 7 AS DOUBLE) AS ay, CAST(20 + c_custkey % 5 AS DOUBLE) AS bx, CAST(c_custkey % 3 AS DOUBLE) AS by_, CAST(c_custkey % 11 AS DOUBLE) AS cx, CAST(30 + c_custkey % 17 AS DOUBLE) AS cy FROM customer)"


def _triangles(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return rasters.table(s, d, "customer").select(k.alias("id"), *[v.cast("double").alias(n) for n, v in (("ax", k % 13), ("ay", k % 7), ("bx", 20 + k % 5), ("by", k % 3), ("cx", k % 11), ("cy", 30 + k % 17))])


_add("circumcenters", lambda s, d: _pixels(points.circumcenter(_triangles(s, d)), "id", "ux", "uy", "radius"), _TRI + ", k AS (SELECT *, 2 * (ax * (by_ - cy) + bx * (cy - ay) + cx * (ay - by_)) AS d, ax * ax + ay * ay AS a2, bx * bx + by_ * by_ AS b2, cx * cx + cy * cy AS c2 FROM t), u AS (SELECT id, ax, ay, (a2 * (by_ - cy) + b2 * (cy - ay) + c2 * (ay - by_)) / d AS ux, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d AS uy FROM k) SELECT id, round(ux, 6) AS ux, round(uy, 6) AS uy, round(sqrt(power(ux - ax, 2) + power(uy - ay, 2)), 6) AS radius FROM u")
_LINES = "SELECT * FROM VALUES (0, 0, 0.0D, 0.0D, 10.0D, 1.0D), (1, 0, 0.0D, 4.0D, 10.0D, 5.0D), (2, 0, 0.0D, 8.0D, 10.0D, 9.5D), (3, 1, 1.0D, 0.0D, 0.5D, 9.0D), (4, 1, 5.0D, 0.0D, 5.0D, 9.0D), (5, 1, 9.0D, 0.0D, 9.5D, 9.0D) AS l(id, grp, x1, y1, x2, y2)"
_add("grid_points", lambda s, d: _pixels(points.line_crossings(s.sql(_LINES)), "a", "b", "px", "py"), "WITH l AS (SELECT * FROM (VALUES (0, 0, 0.0, 0.0, 10.0, 1.0), (1, 0, 0.0, 4.0, 10.0, 5.0), (2, 0, 0.0, 8.0, 10.0, 9.5), (3, 1, 1.0, 0.0, 0.5, 9.0), (4, 1, 5.0, 0.0, 5.0, 9.0), (5, 1, 9.0, 0.0, 9.5, 9.0)) v(id, grp, x1, y1, x2, y2)), k AS (SELECT a.id AS a, b.id AS b, a.x1::DOUBLE AS x1, a.y1::DOUBLE AS y1, (a.x2 - a.x1)::DOUBLE AS ux, (a.y2 - a.y1)::DOUBLE AS uy, (b.x2 - b.x1)::DOUBLE AS vx, (b.y2 - b.y1)::DOUBLE AS vy, (b.x1 - a.x1)::DOUBLE AS wx, (b.y1 - a.y1)::DOUBLE AS wy FROM l a JOIN l b ON a.grp = 0 AND b.grp = 1) SELECT a, b, round(x1 + (wx * vy - wy * vx) / (ux * vy - uy * vx) * ux, 6) AS px, round(y1 + (wx * vy - wy * vx) / (ux * vy - uy * vx) * uy, 6) AS py FROM k")
#: Two quads for every supplier, from its number.
_QUADS = {"m1x": "0", "m1y": "0", "m2x": "4 + k % 3", "m2y": "(k % 5) / 10.0", "m3x": "4 + k % 3", "m3y": "3 + k % 4", "m4x": "(k % 2) / 2.0", "m4y": "3"}
_QUADS |= {"f1x": "0", "f1y": "0", "f2x": "3 + k % 4", "f2y": "k % 7 - 3", "f3x": "2 + k % 3", "f3y": "5 + k % 2", "f4x": "0 - k % 3", "f4y": "4"}
_QUAD_SQL = "SELECT k AS id, " + ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in _QUADS.items())


def _to_north(q: str, i: int, j: int) -> str:
    """The angle in degrees between the edge from corner i to j and the direction (0, -1)."""
    return f"degrees(acos((-1 * ({q}{j}y - {q}{i}y)) / sqrt(power({q}{j}x - {q}{i}x, 2) + power({q}{j}y - {q}{i}y, 2))))"


def _diagonal(q: str, i: int, j: int) -> str:
    return f"sqrt(power({q}{j}x - {q}{i}x, 2) + power({q}{j}y - {q}{i}y, 2))"


def _quads(s: SparkSession, d: str) -> DataFrame:
    k = rasters.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return k.select(F.col("k").alias("id"), *[F.expr(f"CAST({v} AS DOUBLE)").alias(n) for n, v in _QUADS.items()])


_add(
    "rotation_and_scale",
    lambda s, d: _pixels(points.rotation_and_scale(_quads(s, d)), "id", "theta", "scale"),
    f"""WITH qd AS ({_QUAD_SQL} FROM (SELECT s_suppkey AS k FROM supplier))
    SELECT id, round(({_to_north('f', 1, 2)} + {_to_north('f', 4, 3)}) / 2 - ({_to_north('m', 1, 2)} + {_to_north('m', 4, 3)}) / 2, 6) AS theta,
    round(({_diagonal('f', 1, 3)} / {_diagonal('m', 1, 3)} + {_diagonal('f', 2, 4)} / {_diagonal('m', 2, 4)}) / 2, 6) AS scale FROM qd""",
)
_RATIONAL = """CASE WHEN abs({0}) <= 1 THEN (-0.168 * {0} * {0} - 0.9129 * abs({0}) + 1.0808) / ({0} * {0} - 0.8319 * abs({0}) + 1.0808)
WHEN abs({0}) <= 2 THEN (0.1953 * {0} * {0} - 0.5858 * abs({0}) + 0.3905) / ({0} * {0} - 2.4402 * abs({0}) + 1.7676) ELSE 0 END"""
_add(
    "resize_kernel",
    lambda s, d: rasters.table(s, d, "part").select((F.col("p_partkey") % 51 - 25).alias("k")).distinct().select("k", F.round(raster.rational_kernel(F.col("k") / 10), 6).alias("w")),
    f"SELECT k, round({_RATIONAL.format('(k / 10.0::DOUBLE)')}, 6) AS w FROM (SELECT DISTINCT p_partkey % 51 - 25 AS k FROM part)",
)


def _resize_sql(source: str, along: str, across: str, size: str, scale: str, kernel: str, support: int) -> str:
    """One axis of a resize: every output place, its taps, the nearest pixel beyond the border."""
    squeeze = f"least({scale}, 1.0::DOUBLE)"
    return f"""(SELECT b.{across}, t.{along}, sum(w * b.v) / sum(w) AS v FROM (SELECT {along}, i, {kernel.format('(k * (m - i))')} AS w, CAST(greatest(0, least(i, n - 1)) AS BIGINT) AS at
    FROM (SELECT {along}, m, k, n, unnest(range(CAST(floor(m - {support / 2} / k) AS BIGINT), CAST(floor(m - {support / 2} / k) AS BIGINT) + CAST(ceil({support} / k) AS BIGINT) + 2)) AS i
    FROM (SELECT CAST(u.u AS BIGINT) AS {along}, (u.u + 0.5::DOUBLE) / ({scale}) - 0.5 AS m, {squeeze} AS k, n FROM (SELECT max({along}) + 1 AS n FROM {source}) z, range(0, {size.format(f'(SELECT max({along}) + 1 FROM {source})')}) u(u)))) t
    JOIN {source} b ON b.{along} = t.at GROUP BY 1, 2)"""


_CUBIC = """CASE WHEN abs({0}) <= 1 THEN 1.5 * power(abs({0}), 3) - 2.5 * {0} * {0} + 1 WHEN abs({0}) <= 2 THEN -0.5 * power(abs({0}), 3) + 2.5 * {0} * {0} - 4 * abs({0}) + 2 ELSE 0 END"""
for _n, _k, _kernel, _f in (("resize_rational", "rational", _RATIONAL, 0.4), ("resize_cubic", "cubic", _CUBIC, 1.5)):
    _half = _resize_sql("q", "y", "x", f"CAST(ceil({{0}} * {_f}::DOUBLE) AS BIGINT)", f"{_f}::DOUBLE", _kernel, 4)
    _whole_sql = _resize_sql("h1", "x", "y", f"CAST(ceil({{0}} * {_f}::DOUBLE) AS BIGINT)", f"{_f}::DOUBLE", _kernel, 4)
    _on_q(_n, lambda r, k=_k, f=_f: raster.resized(r, f, kernel=k), f", h1 AS {_half} SELECT y, x, round(v, 6) AS v FROM {_whole_sql}")
_on_q(
    "resize_to_size",
    lambda r: raster.resized(r, size=(16, 16), kernel="linear"),
    f""", h1 AS {_resize_sql('q', 'y', 'x', '16', '16.0::DOUBLE / n', 'greatest(0.0, 1 - abs({0}))', 2)}
    SELECT y, x, round(v, 6) AS v FROM {_resize_sql('h1', 'x', 'y', '16', '16.0::DOUBLE / n', 'greatest(0.0, 1 - abs({0}))', 2)}""",
)
_add("polynomial_fit", lambda s, d: points.polynomial_fit(_customers(s, d)).select(F.round(F.get("coef", 0), 4).alias("c0"), F.round(F.get("coef", 1), 5).alias("c1"), F.round("adj_r2", 6).alias("adj_r2")))
_add("windows_of_interest", lambda s, d: points.accept_windows(_customers(s, d).select(F.lit("q").alias("image_id"), "seq", (F.col("px") % 50).cast("long").alias("x"), (F.col("py") % 50).cast("long").alias("y")), _levels(s, d).filter("v >= 0").drop("v"), 6, 6, 8).drop("image_id"))

# files
_PATHS = "WITH p AS (SELECT replace(p_brand, '#', '') || '_S' || p_partkey % 10 || '_' || split_part(p_type, ' ', 1) || '_' || k.kind || '_v' || p_size || '.tiff' AS path FROM part, (SELECT 'adj' AS kind UNION ALL SELECT 'mask') k WHERE k.kind = 'adj' OR p_partkey % 3 = 0), c AS (SELECT path, split_part(path, '_', 1) AS group_id, split_part(path, '_', 2) AS sample_id, split_part(path, '_', 3) AS stain_id, split_part(path, '_', 4) AS kind, CAST(regexp_extract(path, '_v([0-9]+)\\.', 1) AS INTEGER) AS version FROM p), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, sample_id, stain_id, kind ORDER BY version DESC, path) AS k FROM c) WHERE k = 1)"


def _paths(s: SparkSession, d: str) -> DataFrame:
    stem = F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("_S"), F.col("p_partkey") % 10, F.lit("_"), F.split("p_type", " ")[0], F.lit("_"))
    kinds = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("adj"), F.lit("mask"))).otherwise(F.array(F.lit("adj")))
    return rasters.table(s, d, "part").select(stem.alias("stem"), F.explode(kinds).alias("kind"), "p_size").select(F.concat("stem", "kind", F.lit("_v"), "p_size", F.lit(".tiff")).alias("path"))


_add("parse_names", lambda s, d: files.parsed(_paths(s, d)), _PATHS + " SELECT path, group_id, sample_id, stain_id, kind, version FROM c")
_add("latest_versions", lambda s, d: files.latest(files.parsed(_paths(s, d))), _PATHS + " SELECT path, group_id, sample_id, stain_id, kind, version FROM n")
_PAIR = " SELECT a.group_id, a.sample_id, a.stain_id, a.path AS image_path, b.path AS mask_path FROM n a LEFT JOIN n b ON a.group_id = b.group_id AND a.sample_id = b.sample_id AND a.stain_id = b.stain_id AND b.kind = 'mask' WHERE a.kind = 'adj'"
_add("pair_masks", lambda s, d: files.paired(files.latest(files.parsed(_paths(s, d))), "adj", "mask"), _PATHS + _PAIR)
_add("open_work", lambda s, d: files.open_work(files.paired(files.latest(files.parsed(_paths(s, d))), "adj", "mask")).select("image_path"), _PATHS + f", o AS ({_PAIR}) SELECT image_path FROM o WHERE mask_path IS NULL")

# segmentation pipelines and kernels without SQL
_add("segment_by_derivatives", lambda s, d: segment.by_derivatives(rasters.quantity_raster(s, d), *_size(s, d)).drop("image_id"))
_add("segment_hysteresis", lambda s, d: segment.hysteresis(_levels(s, d), 120, 220).drop("image_id"), MASK.replace("WITH s AS", "WITH RECURSIVE s AS") + ", f AS (SELECT y, x, v FROM lv WHERE v > 120), r(y, x) AS (SELECT y, x FROM f WHERE v > 220 UNION SELECT f.y, f.x FROM r JOIN f ON abs(r.y - f.y) <= 1 AND abs(r.x - f.x) <= 1) SELECT y, x FROM r")
_add("segment_geodesic", lambda s, d: _pixels(segment.geodesic(_levels(s, d), [(0, 0)]), "y", "x", "cost", digits=4))
_add("segment_snake", lambda s, d: segment.two_region_contour(_levels(s, d), _mask(s, d), 15).drop("image_id"))
_add("diffuse", lambda s, d: _pixels(segment.diffused(rasters.quantity_raster(s, d), 3), "y", "x", "v", digits=4))
_add("fast_ica", lambda s, d: segment.ica(rasters.rgb_raster(s, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


