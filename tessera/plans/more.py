"""Further queries: enhancement, checks, kernels and pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, pipelines, segment
from ..operators import enhance, points, raster, regions
from ..sources import rasters
from .catalogue import _PTS, _SQL, LEVELS, MASK, Q, _add, _customers, _G, _labels, _levels, _mask, _on_q, _pixels, _routes, _size, _taps

_on_q("sharpen", enhance.sharpened, f", b AS (SELECT y, x, v AS o FROM {_taps(_G, 'y', 'x', _taps(_G, 'x', 'y', 'q'))}) SELECT y, x, round(v + 0.8::DOUBLE * (v - o), 6) AS v FROM q JOIN b USING (y, x)")
_on_q("bilateral", enhance.bilateral, ", k AS (SELECT a.y, a.x, b.v, exp(-(power(a.y - b.y, 2) + power(a.x - b.x, 2)) / 2 - power(b.v - a.v, 2) / 5000) AS w FROM q a JOIN q b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1) SELECT y, x, round(sum(w * v) / sum(w), 6) AS v FROM k GROUP BY 1, 2")
_add("difference_weight", lambda s, d: _pixels(enhance.difference_weight(rasters.quantity_raster(s, d), _mask(s, d)), "y", "x", "v"), MASK + ", a AS (SELECT avg(v) AS k FROM q JOIN m USING (y, x)) SELECT y, x, round(1 / greatest(abs(v - k), 0.01), 6) AS v FROM q, a")
_add("gradient_weight", lambda s, d: _pixels(enhance.gradient_weight(rasters.quantity_raster(s, d)), "y", "x", "v"), Q + ", gw AS (SELECT a.y, a.x, sqrt(power(sum(sign(b.x - a.x) * (2 - abs(a.y - b.y)) * b.v), 2) + power(sum(sign(b.y - a.y) * (2 - abs(a.x - b.x)) * b.v), 2)) AS v FROM q a JOIN q b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2) SELECT y, x, round(power(1 + v / (avg(v) OVER ()), -1.5), 6) AS v FROM gw")
_add("repair_missing", lambda s, d: _pixels(enhance.repaired(rasters.quantity_raster(s, d).withColumn("v", F.when((F.col("y") * 5 + F.col("x")) % 11 != 0, F.col("v")))), "y", "x", "v"), Q + ", n AS (SELECT y, x, CASE WHEN (y * 5 + x) % 11 <> 0 THEN v END AS v FROM q) SELECT a.y, a.x, round(coalesce(max(CASE WHEN a.y = b.y AND a.x = b.x THEN b.v END), avg(b.v), 0), 6) AS v FROM n a JOIN n b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2")
_on_q("iterated_median", enhance.iterated_median)
_add("connected_values", lambda s, d: enhance.connected_values(_levels(s, d), (5, 5), 90).drop("image_id"), LEVELS.replace("WITH s AS", "WITH RECURSIVE s AS") + ", k AS (SELECT y, x FROM lv WHERE abs(v - (SELECT v FROM lv WHERE y = 5 AND x = 5)) <= 90), r(y, x) AS (SELECT y, x FROM k WHERE y = 5 AND x = 5 UNION SELECT k.y, k.x FROM r JOIN k ON abs(r.y - k.y) <= 1 AND abs(r.x - k.x) <= 1) SELECT y, x FROM r")


def _channels(s: SparkSession, d: str) -> DataFrame:
    q, out = _levels(s, d), None
    for k in (40, 60, 100):
        m = q.filter(F.col("v") >= k).select("image_id", F.lit(f"m{k}").alias("mask"), "y", "x")
        out = m if out is None else out.unionByName(m)
    return out


_CHANNELS = LEVELS + ", c AS (SELECT k.k, y, x FROM lv, (SELECT unnest([40, 60, 100]) AS k) k WHERE v >= k.k)"
_add("combine_by_area", lambda s, d: enhance.combine_by_area(_channels(s, d), _size(s, d)[0] * _size(s, d)[1]).drop("image_id"), _CHANNELS + ", a AS (SELECT k, count(*) * 1.0 / (SELECT count(*) FROM q) AS p FROM c GROUP BY 1), f AS (SELECT k FROM a WHERE (p > 0.67 AND p < 0.93) OR (SELECT count(*) FROM a WHERE p > 0.67 AND p < 0.93) = 0) SELECT y, x FROM c JOIN f USING (k) GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM f)")
_add("mask_votes", lambda s, d: enhance.votes(_channels(s, d), 2).drop("image_id"), _CHANNELS + " SELECT y, x FROM c GROUP BY 1, 2 HAVING count(*) >= 2")
_add(
    "fill_check",
    lambda s, d: enhance.fill_is_sound(_mask(s, d), regions.fill_holes(_mask(s, d), _levels(s, d), *_size(s, d)), _size(s, d)[0] * _size(s, d)[1]).drop("image_id"),
    _SQL["fill_holes"].replace(" SELECT y, x FROM q EXCEPT SELECT y, x FROM r", """, f AS (SELECT y, x FROM q EXCEPT SELECT y, x FROM r),
    pf AS (SELECT y, x FROM f a WHERE (SELECT count(*) FROM f b WHERE abs(a.y - b.y) + abs(a.x - b.x) = 1) < 4),
    k AS (SELECT (SELECT count(*) FROM f) AS f, (SELECT count(*) FROM m) AS m, (SELECT count(*) FROM q) AS q, (SELECT count(*) FROM pf) AS p, (SELECT count(*) FROM pf JOIN m USING (y, x)) AS b)
    SELECT f = m OR (2.0 * b / (p + m) >= 0.5 AND f <= 0.93 * q AND f >= 10 AND m >= 10 AND f >= 0.15 * q) AS sound FROM k""").replace(", k AS (SELECT y, x FROM q EXCEPT SELECT y, x FROM m)", ", kk AS (SELECT y, x FROM q EXCEPT SELECT y, x FROM m)").replace("FROM k WHERE y = 0", "FROM kk WHERE y = 0").replace("SELECT k.y, k.x FROM r JOIN k ON abs(r.y - k.y) + abs(r.x - k.x) = 1", "SELECT kk.y, kk.x FROM r JOIN kk ON abs(r.y - kk.y) + abs(r.x - kk.x) = 1"),
)
_add("polygon_mask", lambda s, d: enhance.polygon_mask(rasters.quantity_raster(s, d), [(1.5, 0.5), (8.5, 6.25), (2.25, 40.5)]).drop("image_id"), Q + ", e AS (SELECT 1.5 AS x0, 0.5 AS y0, 8.5 AS x1, 6.25 AS y1 UNION ALL SELECT 8.5, 6.25, 2.25, 40.5 UNION ALL SELECT 2.25, 40.5, 1.5, 0.5) SELECT y, x FROM q, e WHERE ((y0 > y) <> (y1 > y)) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 GROUP BY 1, 2 HAVING count(*) % 2 = 1")
_add("histogram_median", lambda s, d: _pixels(enhance.moving_median(_levels(s, d)), "bin", "n", "m"), LEVELS + " SELECT bin, n, round(median(n) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS m FROM h")
_TWO = _PTS + ", t AS (SELECT * FROM p UNION ALL SELECT 'supplier', s_suppkey, CAST(s_suppkey % 23 AS DOUBLE), CAST(s_suppkey % 31 AS DOUBLE) FROM supplier)"


def _two_sets(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _customers(s, d).unionByName(rasters.table(s, d, "supplier").select(F.lit("supplier").alias("set"), k.alias("seq"), (k % 23).cast("double").alias("px"), (k % 31).cast("double").alias("py")))


_add("align_by_padding", lambda s, d: enhance.aligned(_two_sets(s, d)), _TWO + ", a AS (SELECT set, avg(px) AS ax, avg(py) AS ay FROM t GROUP BY 1) SELECT set, CAST(round(max(ax) OVER () - ax) AS BIGINT) AS pad_x, CAST(round(max(ay) OVER () - ay) AS BIGINT) AS pad_y FROM a")
_add("edge_margin", lambda s, d: enhance.edge_margin(_mask(s, d), *_size(s, d), 4).drop("image_id"), MASK + " SELECT CAST(greatest(0, 4 - min(m.y)) AS BIGINT) AS top, CAST(greatest(0, 4 - ((SELECT max(y) FROM q) - max(m.y))) AS BIGINT) AS bottom, CAST(greatest(0, 4 - min(m.x)) AS BIGINT) AS left, CAST(greatest(0, 4 - ((SELECT max(x) FROM q) - max(m.x))) AS BIGINT) AS right FROM m")
_add("angular_histogram", lambda s, d: kernels.free_directions(_mask(s, d), 5, 5, 24).drop("image_id"), MASK + " SELECT CAST(floor((degrees(atan2(y - 5, x - 5)) + CASE WHEN atan2(y - 5, x - 5) < 0 THEN 360 ELSE 0 END) / 15) AS INTEGER) AS bin, count(*) AS n FROM m WHERE y <> 5 OR x <> 5 GROUP BY 1")
_add("contact_degrees", lambda s, d: (lambda e: e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree")))(points.contacts(_customers(s, d).select(F.col("seq").alias("id"), F.col("px").alias("cx"), F.col("py").alias("cy"), ((F.col("seq") % 3 + 1) * 0.3).alias("r")))), _SQL["circle_contacts"].replace("SELECT a.id AS src", ", e AS (SELECT a.id AS src", 1).replace(" , e AS", ", e AS") + ") SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")

for _name, _f in {
    "non_local_means": kernels.non_local_means,
    "detail_enhance": kernels.detail_enhanced,
    "local_brighten": kernels.brightened,
}.items():
    _on_q(_name, _f)
_add("thin", lambda s, d: regions.thinned(_mask(s, d)).drop("image_id"))
_add("trace_boundaries", lambda s, d: kernels.traced(_labels(s, d)).drop("image_id"))
_add("reduce_polyline", lambda s, d: kernels.reduced(_routes(s, d), 15.0))
_add("smooth_histogram", lambda s, d: _pixels(kernels.envelope_smoothed(raster.histogram(_levels(s, d))), "bin", "n"))
_add("best_curve", lambda s, d: kernels.best_curve(_routes(s, d)).select("set", "kind", F.round("adj_r2", 6).alias("adj_r2")))
_add("polynomial_transform", lambda s, d: _pixels(kernels.polynomial_transform(_customers(s, d).select(F.lit(1).cast("long").alias("id"), F.col("px").alias("fx"), F.col("py").alias("fy"), (2 + 1.5 * F.col("px") - 0.01 * F.col("px") * F.col("py")).alias("mx"), (3 - 0.5 * F.col("py")).alias("my"))), "px", "py", "cx", "cy", digits=4))
_add("tune_control_points", lambda s, d: kernels.tuned_points(raster.shifted(rasters.quantity_raster(s, d), 2, 0), rasters.quantity_raster(s, d), [(20, 5), (30, 5)]).drop("image_id"))
_add("demons", lambda s, d: _pixels(kernels.demons(raster.gaussian(raster.shifted(rasters.quantity_raster(s, d), 1, 0)), raster.gaussian(rasters.quantity_raster(s, d))), "y", "x", "dy", "dx", digits=4))
_add("pack_circles", lambda s, d: kernels.packed_circles(_levels(s, d).filter("v >= 60").drop("v"), 1.0).drop("image_id"))
_add("superpixels", lambda s, d: kernels.superpixels(rasters.rgb_raster(s, d)).drop("image_id"))
_add("graph_cut", lambda s, d: kernels.graph_cut(_levels(s, d), _mask(s, d)).drop("image_id"))


def _windows(s: SparkSession, d: str) -> DataFrame:
    seeds = _customers(s, d).select(F.lit("q").alias("image_id"), "seq", (F.col("px") % 50).cast("long").alias("x"), (F.col("py") % 50).cast("long").alias("y"))
    return points.accept_windows(seeds, _levels(s, d).drop("v"), 5, 5, 6)


def extracted_windows(s: SparkSession, d: str, turns: int = 1) -> DataFrame:
    """The pixels of every accepted window, re-based to its corner and turned by quarter turns."""
    cut = rasters.quantity_raster(s, d).join(_windows(s, d).select("image_id", "roi", F.col("x").alias("x0"), F.col("y").alias("y0")), "image_id").filter((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + 5) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + 5))
    based = cut.select(F.concat_ws("/", "image_id", F.lpad("roi", 3, "0")).alias("image_id"), (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")
    return raster.rotated90(based, turns)


def replaced_window(s: SparkSession, d: str, drop: int = 0) -> DataFrame:
    """The accepted windows after one is rejected: its candidate is taken out, and the greedy choice made anew."""
    gone = _windows(s, d).filter(F.col("roi") == drop).select("seq")
    seeds = _customers(s, d).join(gone, "seq", "left_anti").select(F.lit("q").alias("image_id"), "seq", (F.col("px") % 50).cast("long").alias("x"), (F.col("py") % 50).cast("long").alias("y"))
    return points.accept_windows(seeds, _levels(s, d).drop("v"), 5, 5, 6)


_add("extract_windows", extracted_windows)
_add("replace_window", lambda s, d: replaced_window(s, d).drop("image_id"))


# whole pipelines


def tissue_mask(s: SparkSession, d: str) -> DataFrame:
    """Lightness closed, diffused, cut at Otsu / 1.5, the largest region filled and its contour relaxed."""
    light = raster.lab(rasters.rgb_raster(s, d)).select("image_id", "y", "x", (100 - F.col("l")).alias("v"))
    soft = raster.levels(segment.diffused(raster.closed(light), 2, 10.0))
    cut = raster.otsu(soft).withColumn("threshold", F.col("threshold") / 1.5)
    return segment.two_region_contour(soft, regions.largest(regions.label(raster.binarize(soft, cut))), 15)


def texture_mask(s: SparkSession, d: str) -> DataFrame:
    """Pixels that at least two of entropy, deviation, range, full-colour and log-contrast masks hold."""
    rgb = rasters.rgb_raster(s, d)
    h, w = (v + 1 for v in rgb.agg(F.max("y"), F.max("x")).first())
    gray = raster.gray(rgb)
    parts = pipelines.segment_full_colour(rgb, 20).withColumn("mask", F.lit("colour")).unionByName(pipelines.log_contrast_mask(rgb, h, w, 3).withColumn("mask", F.lit("log")))
    for name, t in (("entropy", raster.local_entropy(raster.levels(gray), 4)), ("std", raster.local_std(gray, 3)), ("range", raster.local_range(gray, 3))):
        lv = raster.levels(t)
        parts = parts.unionByName(raster.binarize(lv, raster.otsu(lv)).withColumn("mask", F.lit(name)))
    return enhance.votes(parts, 2)


def colour_distance_mask(s: SparkSession, d: str) -> DataFrame:
    """Weights by difference to the image's border colour, cut at Otsu, two largest regions kept."""
    rgb = rasters.rgb_raster(s, d)
    edge = rgb.filter("y = 0 or x = 0").groupBy("image_id").agg(*[F.avg(c).alias(f"m{c}") for c in "rgb"])
    far = rgb.join(edge, "image_id").select("image_id", "y", "x", F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "rgb"), F.lit(0.0))).alias("v"))
    lv = raster.levels(far)
    return regions.largest(regions.label(raster.binarize(lv, raster.otsu(lv))), 2)


def morphology_mask(s: SparkSession, d: str) -> DataFrame:
    """Complement closed, maxima extended, opened by reconstruction and cut at Otsu."""
    r = raster.closed(raster.complement(rasters.quantity_raster(s, d)))
    lv = raster.levels(kernels.opened_by_reconstruction(r))
    return raster.binarize(lv, raster.otsu(lv))


def preprocessed(s: SparkSession, d: str) -> DataFrame:
    """Channels to [0, 1], halved in size, background evened."""
    gray = raster.double_scaled(raster.gray(rasters.rgb_raster(s, d)))
    return raster.background_corrected(raster.shrunk(gray, 2), 3)


def register_metrics(s: SparkSession, d: str) -> DataFrame:
    """Error and correlation of candidate shifts of the moving image; rank 1 is the best."""
    from pyspark.sql.window import Window

    fixed, out = rasters.quantity_raster(s, d), None
    moving = raster.shifted(fixed, 2, 0)
    for k in (-3, -2, -1):
        c = raster.compare(raster.shifted(moving, k, 0), fixed).select(F.lit(k).alias("shift"), "mse", "r")
        out = c if out is None else out.unionByName(c)
    return out.withColumn("rank", F.row_number().over(Window.orderBy("mse", "shift")))  # three rows


_add("segment_tissue", lambda s, d: tissue_mask(s, d).drop("image_id"))
_add("segment_textures", lambda s, d: texture_mask(s, d).drop("image_id"))
_add("segment_colour_distance", lambda s, d: colour_distance_mask(s, d).drop("image_id"))
_add("segment_morphology", lambda s, d: morphology_mask(s, d).drop("image_id"))
_add("preprocess", lambda s, d: _pixels(preprocessed(s, d), "y", "x", "v"))
_add("register_candidates", lambda s, d: _pixels(register_metrics(s, d), "shift", "mse", "r", "rank", digits=4))

#: Segmenters and refinements by name: what an interactive menu would offer.
SEGMENTERS = {"tissue": tissue_mask, "textures": texture_mask, "colour distance": colour_distance_mask, "morphology": morphology_mask}
