"""Queries of the default segmenter's parts, shaped neighbourhoods, colour inverses, catalogue rules and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector_calculus
from ..operators import enhance, files, raster, tiles
from ..sources import rasters
from .catalogue import _G, _SQL, E, LEVELS, MASK, RGB, _add, _fractional, _labels, _levels, _mask, _mirrored, _on_q, _pixels, _taps

# flat neighbourhoods of several shapes: dy, dx are the sides of a pixel's offset
_SHAPES = {"disk": "power(a.y - b.y, 2) + power(a.x - b.x, 2)) <= 9", "diamond": "abs(a.y - b.y) + abs(a.x - b.x)) <= 3", "octagon": "abs(a.y - b.y) + abs(a.x - b.x)) <= 4"}
for _shape, _rule in _SHAPES.items():
    _near = f"abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 AND ({_rule}"
    _both = ", p1 AS (SELECT a.y, a.x, {0}(b.v) AS v FROM q a JOIN q b ON " + _near + " GROUP BY 1, 2), p2 AS (SELECT a.y, a.x, {1}(b.v) AS v FROM p1 a JOIN p1 b ON " + _near + " GROUP BY 1, 2)"
    _on_q(f"erode_{_shape}", lambda r, s=_shape: tiles.eroded(r, s, 3, tile=16), f" SELECT a.y, a.x, min(b.v) AS v FROM q a JOIN q b ON {_near} GROUP BY 1, 2")
    _on_q(f"dilate_{_shape}", lambda r, s=_shape: tiles.dilated(r, s, 3), f" SELECT a.y, a.x, max(b.v) AS v FROM q a JOIN q b ON {_near} GROUP BY 1, 2")
    _on_q(f"open_{_shape}", lambda r, s=_shape: tiles.opened(r, s, 3), _both.format("min", "max") + " SELECT * FROM p2")
    _on_q(f"close_{_shape}", lambda r, s=_shape: tiles.closed(r, s, 3), _both.format("max", "min") + " SELECT * FROM p2")
_on_q("local_std_clipped", lambda r: raster.local_std(r, 2, "clip"), " SELECT a.y, a.x, round(stddev_samp(b.v), 6) AS v FROM q a JOIN q b ON abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2")
_on_q(
    "sharpen_mirrored",
    lambda r: raster.filter_kernel(r, [[0, -1, 0], [-1, 5, -1], [0, -1, 0]], "symmetric"),
    f""", k AS (SELECT a.y, a.x, sum(b.v) FILTER (i = 0 AND j = 0) AS c, sum(b.v) FILTER (abs(i) + abs(j) = 1) AS n
    FROM {_mirrored('q', 1).replace('SELECT a.y, a.x, ', 'SELECT a.y, a.x, i.i AS i, j.j AS j, ', 1)} GROUP BY 1, 2) SELECT y, x, CAST(5 * c - n AS DOUBLE) AS v FROM k""",
)
_on_q("median5_mirrored", lambda r: raster.median_filter(r, 2, "symmetric"), f" SELECT a.y, a.x, CAST(median(b.v) AS BIGINT) AS v FROM {_mirrored('q', 2)} GROUP BY 1, 2")
_add(
    "cooccurrence_symmetric",
    lambda s, d: raster.cooccurrence(_levels(s, d).withColumn("v", F.floor(F.col("v") / 32)), ((0, 1), (-1, 1), (-1, 0), (-1, -1)), True).drop("image_id"),
    LEVELS + """, k AS (SELECT y, x, v // 32 AS v FROM lv), o AS (SELECT * FROM (VALUES (0, 1), (-1, 1), (-1, 0), (-1, -1)) t(dy, dx)),
    gp AS (SELECT a.v AS i, b.v AS j FROM k a, o JOIN k b ON b.y = a.y + dy AND b.x = a.x + dx), u AS (SELECT i, j FROM gp UNION ALL SELECT j, i FROM gp)
    SELECT i, j, count(*) AS count FROM u GROUP BY 1, 2""",
)

# parts of the default segmenter
_DERIVED = {n: _taps(b, "y", "x", _taps(a, "x", "y", "e")) for n, a, b in (("dx", raster.FIRST7, raster.SMOOTH7), ("dy", raster.SMOOTH7, raster.FIRST7), ("dxx", raster.SECOND7, raster.SMOOTH7), ("dyy", raster.SMOOTH7, raster.SECOND7), ("dxy", raster.FIRST7, raster.FIRST7))}
_add(
    "gradient_direction_derivative",
    lambda s, d: _pixels(vector_calculus.gradient_direction_derivative(rasters.embedding_raster(s, d)), "y", "x", "v", digits=4).withColumn("v", F.col("v") + 0.0),
    E + "".join(f", t{n} AS (SELECT y, x, v AS {n} FROM {t})" for n, t in _DERIVED.items())
    + """ SELECT y, x, round(CASE WHEN dx * dx + dy * dy > 0 THEN (dxx * dx * dx + dyy * dy * dy + 2 * dxy * dx * dy) / (dx * dx + dy * dy) ELSE 0 END, 4) + 0.0::DOUBLE AS v
    FROM tdx JOIN tdy USING (y, x) JOIN tdxx USING (y, x) JOIN tdyy USING (y, x) JOIN tdxy USING (y, x)""",
)
_add(
    "fractional_edges",
    lambda s, d: vector_calculus.fractional_edges(rasters.embedding_raster(s, d)).drop("image_id"),
    E + f""", f AS {_fractional('e', 2.6)},
    m AS (SELECT a.y, a.x, list_sort(list_concat(list(b.v), [0.0::DOUBLE for k in range(0, 9 - count(*))]))[5] AS v FROM f a JOIN f b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2),
    l AS (SELECT y, x, CAST(least(255, floor(255 * (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()))) AS BIGINT) AS v FROM m),
    h AS (SELECT v AS bin, count(*) AS n FROM l GROUP BY 1), c AS (SELECT bin, 1 - CAST(sum(n) OVER (ORDER BY bin) AS DOUBLE) / sum(n) OVER () AS c FROM h),
    k AS (SELECT y, x, c AS v FROM l JOIN c ON bin = v),
    l2 AS (SELECT y, x, CAST(least(255, floor(255 * (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()))) AS BIGINT) AS v FROM k),
    h2 AS (SELECT v AS bin, count(*) AS n FROM l2 GROUP BY 1),
    run AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS n0, sum(n * bin) OVER (ORDER BY bin) AS s0, sum(n) OVER () AS nt, sum(n * bin) OVER () AS st FROM h2),
    o AS (SELECT bin * 1.2::DOUBLE AS threshold FROM run WHERE n0 < nt
    ORDER BY round(CAST(n0 AS DOUBLE) * CAST(nt - n0 AS DOUBLE) * power(CAST(s0 AS DOUBLE) / n0 - CAST(st - s0 AS DOUBLE) / (nt - n0), 2), 3) DESC, bin LIMIT 1)
    SELECT y, x FROM l2, o WHERE v > threshold""",
)


def _rgb_size(s: SparkSession, d: str) -> tuple[int, int]:
    r = rasters.rgb_raster(s, d).agg(F.max("y"), F.max("x")).first()
    return r[0] + 1, r[1] + 1


_add("segment_vector_calculus", lambda s, d: vector_calculus.segment_vector_calculus(rasters.rgb_raster(s, d), *_rgb_size(s, d)).drop("image_id"))

# colours back
_add("from_lab", lambda s, d: _pixels(raster.rgb_from_lab(raster.lab(rasters.rgb_raster(s, d))), "y", "x", "r", "g", "b", digits=3), RGB + " SELECT y, x, round(r, 3) AS r, round(g, 3) AS g, round(b, 3) AS b FROM c")
_add("from_hsv", lambda s, d: _pixels(raster.rgb_from_hsv(raster.hsv(rasters.rgb_raster(s, d))), "y", "x", "r", "g", "b"), RGB + " SELECT y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM c")

# masks against images
_add(
    "mask_gate",
    lambda s, d: _pixels(enhance.gated(rasters.quantity_raster(s, d), _mask(s, d), raster.gaussian(rasters.quantity_raster(s, d))), "y", "x", "v"),
    MASK + f", b AS (SELECT y, x, v AS o FROM {_taps(_G, 'y', 'x', _taps(_G, 'x', 'y', 'q'))}) SELECT q.y, q.x, round(CASE WHEN m.y IS NULL THEN o ELSE v END, 6) AS v FROM q JOIN b ON q.y = b.y AND q.x = b.x LEFT JOIN m ON q.y = m.y AND q.x = m.x",
)
_add(
    "label_colours",
    lambda s, d: _pixels(raster.label_colours(_labels(s, d).select("image_id", "y", "x", (F.col("label") % 7).alias("v"))), "y", "x", "r", "g", "b", digits=4),
    _SQL["components"].replace(" SELECT y, x, label FROM l", ", hu AS (SELECT y, x, label % 7 AS v, 6 * ((label % 7) * 0.6180339887498949::DOUBLE - floor((label % 7) * 0.6180339887498949::DOUBLE)) AS h FROM l) SELECT y, x, ")
    + ", ".join(f"round(greatest(0.0, least(1.0, {f})), 4) AS {c}" for c, f in (("r", "abs(h - 3) - 1"), ("g", "2 - abs(h - 2)"), ("b", "2 - abs(h - 4)")))
    + " FROM hu",
)
_add(
    "coverage",
    lambda s, d: _pixels(enhance.coverage(_mask(s, d), _levels(s, d).filter("v >= 128").drop("v")), "share"),
    MASK + " SELECT round((SELECT count(*) FROM m JOIN lv USING (y, x) WHERE v >= 128) * 1.0::DOUBLE / (SELECT count(*) FROM m), 6) AS share",
)


def _ranked(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return rasters.table(s, d, "supplier").select(F.lit("q").alias("image_id"), k.alias("id"), *[(k * m % p).alias(n) for n, m, p in (("area", 37, 101), ("near", 53, 89), ("length", 71, 97), ("bend", 29, 83))])


_add(
    "rank_votes",
    lambda s, d: enhance.rank_votes(_ranked(s, d), ["area", "near", "length", "bend"]).select("id", "share"),
    "WITH k AS (SELECT s_suppkey AS id, s_suppkey * 37 % 101 AS a, s_suppkey * 53 % 89 AS b, s_suppkey * 71 % 97 AS c, s_suppkey * 29 % 83 AS d, count(*) OVER () AS n FROM supplier), r AS ("
    + " UNION ALL ".join(f"SELECT id, n, row_number() OVER (ORDER BY {c}, id) AS k FROM k" for c in "abcd")
    + ") SELECT id, count(*) / 4.0::DOUBLE AS share FROM r WHERE k <= floor(2 * n / 3) GROUP BY 1",
)

# catalogue rules


def _raw(s: SparkSession, d: str) -> DataFrame:
    p = rasters.table(s, d, "part").filter("p_partkey % 5 = 0")
    return p.select(F.concat(F.lit("/raw/"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit("_S"), F.col("p_partkey"), F.lit("_st"), F.col("p_size"), F.lit(".tiff")).alias("path"))


def _saved(s: SparkSession, d: str) -> DataFrame:
    p = rasters.table(s, d, "part").filter("p_partkey % 10 = 0")
    kind = F.when(F.col("p_partkey") % 20 == 0, "_MASK").otherwise("_adj")
    return p.select(F.concat(F.lit("/out/"), F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit("_S"), F.col("p_partkey"), F.lit("_st"), F.col("p_size"), kind, F.lit("_v"), F.col("p_size") % 4, F.lit(".png")).alias("path"))


_RAW = """WITH raw AS (SELECT '/raw/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '_S' || p_partkey || '_st' || p_size || '.tiff' AS path,
lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS t1, 's' || p_partkey AS t2, 'st' || p_size AS t3 FROM part WHERE p_partkey % 5 = 0),
saved AS (SELECT '/out/' || upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '_S' || p_partkey || '_st' || p_size || CASE WHEN p_partkey % 20 = 0 THEN '_MASK' ELSE '_adj' END || '_v' || (p_size % 4) || '.png' AS path FROM part WHERE p_partkey % 10 = 0),
hit AS (SELECT raw.path, saved.path AS output FROM raw JOIN saved ON contains(lower(saved.path), t1) AND contains(lower(saved.path), t2) AND contains(lower(saved.path), t3))"""
_add("outputs_containing", lambda s, d: files.containing(_raw(s, d), _saved(s, d)), _RAW + " SELECT path, output FROM hit")
_add(
    "work_status",
    lambda s, d: files.work_status(_raw(s, d), _saved(s, d).filter("path like '%adj%'"), _saved(s, d).filter("path like '%MASK%'")),
    _RAW + " SELECT path, path NOT IN (SELECT path FROM hit WHERE output LIKE '%adj%') AS need_rgb, path NOT IN (SELECT path FROM hit WHERE output LIKE '%MASK%') AS need_mask FROM raw",
)


def _named(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    extra = F.concat(F.when(k % 3 == 0, "_x_y").when(k % 3 == 1, "_x").otherwise(""), F.lit("_adj"))
    return rasters.table(s, d, "part").select(F.concat(F.lit("/d/g"), (k % 4).cast("string"), F.lit("_S"), (k % 7).cast("string"), F.lit("_st"), (k % 3).cast("string"), extra, F.lit("_v"), F.col("p_size"), F.lit(".tiff")).alias("path"))


_NAMED = """WITH nm AS (SELECT 'g' || (p_partkey % 4) || '_S' || (p_partkey % 7) || '_st' || (p_partkey % 3) AS pre,
CASE p_partkey % 3 WHEN 0 THEN '_x_y' WHEN 1 THEN '_x' ELSE '' END || '_adj_v' || p_size AS post, p_size AS version, p_partkey % 3 AS k FROM part)"""
_add(
    "checked_names",
    lambda s, d: files.checked_names(_named(s, d)).distinct(),
    _NAMED + """ SELECT DISTINCT '/d/' || pre || post || '.tiff' AS path, pre || post AS name, k = 2 OR k = 1 AS sound FROM nm""".replace("pre || post AS name", "CASE WHEN k = 1 THEN pre || substr(post, 2) ELSE pre || post END AS name"),
)
_add(
    "newest_by_prefix",
    lambda s, d: files.newest_by_prefix(_named(s, d)),
    _NAMED + """, r AS (SELECT pre AS prefix, '/d/' || pre || post || '.tiff' AS path, version, row_number() OVER (PARTITION BY pre ORDER BY version DESC, '/d/' || pre || post || '.tiff') AS k FROM nm)
    SELECT prefix, path, version FROM r WHERE k = 1""",
)

# a raster that grows with the tables: one row of 64 pixels for each part

_PARTS = """WITH pt AS (SELECT l_partkey AS y, l_suppkey % 64 AS x, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2),
pr AS (SELECT CAST(a.i AS BIGINT) AS y, CAST(b.i AS BIGINT) AS x, coalesce(pt.v, 0) AS v FROM range(0, (SELECT max(y) + 1 FROM pt)) a(i), range(0, 64) b(i) LEFT JOIN pt ON pt.y = a.i AND pt.x = b.i)"""
_NEAR_DISK = "b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 AND power(a.y - b.y, 2) + power(a.x - b.x, 2) <= 4"
_add("parts_derivative7_x", lambda s, d: _pixels(raster.derivative(rasters.parts_raster(s, d), "x", rasters.parts_extents(s, d)), "y", "x", "v"), _PARTS + f" SELECT y, x, round(v, 6) AS v FROM {_taps(raster.SMOOTH7, 'y', 'x', _taps(raster.FIRST7, 'x', 'y', 'pr'))}")
_add(
    "parts_close_disk",
    lambda s, d: _pixels(tiles.closed(rasters.parts_raster(s, d), "disk", 2, box=rasters.parts_extents(s, d)), "y", "x", "v"),
    _PARTS + f", p1 AS (SELECT a.y, a.x, max(b.v) AS v FROM pr a JOIN pr b ON {_NEAR_DISK} GROUP BY 1, 2) SELECT a.y, a.x, min(b.v) AS v FROM p1 a JOIN p1 b ON {_NEAR_DISK} GROUP BY 1, 2",
)
