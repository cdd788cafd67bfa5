"""Reconstruction and local kernels on tiles; further down, whole-image or whole-curve kernels, one image, region or curve a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import raster, regions, tiles

KEY = ["image_id", "y", "x"]


def _dense(group: pd.DataFrame, column: str = "v") -> np.ndarray:
    out = np.zeros((group.y.max() + 1, group.x.max() + 1))
    out[group.y, group.x] = group[column]
    return out


def _under(marker: Column, r: DataFrame) -> DataFrame:
    """The image's values less a marker's drop, grown back under the image."""
    r = r.withColumn("v", F.col("v").cast("double"))
    return regions.reconstruct_gray(r.select("image_id", "y", "x", marker.alias("v"), F.col("v").alias("m")))


def h_maxima(r: DataFrame, h: float) -> DataFrame:
    """Maxima lower than ``h`` above their surroundings flattened."""
    return _under(F.col("v") - h, r)


def _negated(r: DataFrame) -> DataFrame:
    return r.withColumn("v", -F.col("v"))


def h_minima(r: DataFrame, h: float) -> DataFrame:
    return _negated(h_maxima(_negated(r), h))


def extended_maxima(r: DataFrame, h: float) -> DataFrame:
    """v = 1 at the pixels of the regional maxima that remain after ``h_maxima``, else 0."""
    top = regions.regional_maxima(h_maxima(r, h)).withColumn("one", F.lit(1.0))
    return r.select(*KEY).join(top, KEY, "left").select(*KEY, F.coalesce("one", F.lit(0.0)).alias("v"))


def imposed_minima(r: DataFrame, markers: DataFrame) -> DataFrame:
    """The image changed so that its only minima are the marker pixels (0.1 % of the range below the least value)."""
    ends = r.groupBy("image_id").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    both = r.withColumn("v", F.col("v").cast("double")).join(ends, "image_id").join(markers.select(*KEY, F.lit(True).alias("at")), KEY, "left")
    both = both.withColumn("step", F.greatest(F.lit(1e-9), 0.001 * (F.col("hi") - F.col("lo"))))
    marker = F.when(F.col("at"), F.col("lo") - F.col("step")).otherwise(F.col("hi") + F.col("step"))
    both = both.withColumn("v0", marker).select(*KEY, (-F.col("v0")).alias("v"), (-F.least(F.col("v") + F.col("step"), F.col("v0"))).alias("m"))
    return _negated(regions.reconstruct_gray(both))


def opened_by_reconstruction(r: DataFrame, half: int = 1, shape: str = "square") -> DataFrame:
    """The image eroded by a flat neighbourhood and grown back under itself."""
    low = tiles.eroded(r.withColumn("v", F.col("v").cast("double")), shape, half)
    both = low.join(r.select(*KEY, F.col("v").cast("double").alias("m")), KEY)
    return regions.reconstruct_gray(both)


def closed_by_reconstruction(r: DataFrame, half: int = 1, shape: str = "square") -> DataFrame:
    return _negated(opened_by_reconstruction(_negated(r), half, shape))


def non_local_means(r: DataFrame, half: int = 2, strength: float = 40.0) -> DataFrame:
    """Mean over shifts of the image, weighted by the likeness of 3 x 3 patches; mirrored at the border."""

    def run(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[0] - 2 * half - 2, p.shape[1] - 2 * half - 2
        v = p[half : half + h + 2, half : half + w + 2]
        total, weight = np.zeros((h, w)), np.zeros((h, w))
        for i in range(2 * half + 1):
            for j in range(2 * half + 1):
                other = p[i : i + h + 2, j : j + w + 2]
                d = (v - other) ** 2
                patch = sum(d[a : a + h, b : b + w] for a in range(3) for b in range(3)) / 9
                k = np.exp(-patch / strength**2)
                total += k * other[1:-1, 1:-1]
                weight += k
        return total / weight

    return tiles.by_tiles(r, half + 1, run, "symmetric")


def detail_enhanced(r: DataFrame, sigma: float = 30.0, alpha: float = 0.5, layers: int = 3) -> DataFrame:
    """Edge-aware detail: differences of repeated smoothings below ``sigma`` are scaled by a power ``alpha``, larger ones kept."""

    def run(p: np.ndarray) -> np.ndarray:
        base, out = p, 0.0
        for _ in range(layers):
            rows = (base[:-2] + 2 * base[1:-1] + base[2:]) / 4
            low = (rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 4
            d = base[1:-1, 1:-1] - low
            out = (out[1:-1, 1:-1] if np.ndim(out) else out) + np.where(np.abs(d) < sigma, np.sign(d) * sigma * (np.abs(d) / sigma) ** alpha, d)
            base = low
        return out + base

    return tiles.by_tiles(r, layers, run, "symmetric")


def brightened(r: DataFrame, amount: float = 0.8) -> DataFrame:
    """Dark parts lifted: the inverted image is cleared of its local haze and inverted back; values in [0, 1]."""

    inverse = raster.complement(raster.rescale(r))
    haze = F.lit(amount) * F.col("o")
    clear = (F.col("v") - haze) / F.greatest(1 - haze, F.lit(0.1))
    return raster._beside(inverse, raster.opened(inverse), 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), clear))).select(*KEY, "v")


def traced(labels: DataFrame) -> DataFrame:
    """The outer boundary of every region as an ordered ring of pixels (image_id, label, seq, y, x), clockwise from its first pixel."""
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cells = set(zip(group.y, group.x, strict=True))
        start = min(cells)
        ring, at, came = [start], start, 6
        for _ in range(8 * len(cells) + 8):
            for k in range(1, 9):
                d = (came + k) % 8
                step = (at[0] + around[d][0], at[1] + around[d][1])
                if step in cells:
                    break
            else:
                break
            if at == start and len(ring) > 1 and step == ring[1]:
                break
            ring.append(step)
            at, came = step, (d + 4) % 8
        if len(ring) > 1 and ring[-1] == start:
            ring.pop()
        return pd.DataFrame({"image_id": [group.image_id.iloc[0]] * len(ring), "label": [group.label.iloc[0]] * len(ring), "seq": range(len(ring)), "y": [a for a, _ in ring], "x": [b for _, b in ring]})

    return labels.groupBy("image_id", "label").applyInPandas(run, "image_id string, label long, seq long, y long, x long")


def reduced(lines: DataFrame, tolerance: float) -> DataFrame:
    """Polylines (set, seq, px, py) with vertices nearer than a tolerance to the line of those kept taken out."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("seq").reset_index(drop=True)
        p = g[["px", "py"]].to_numpy()
        keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d, q = p[b] - p[a], p[a + 1 : b] - p[a]
            size = np.hypot(*d)
            off = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / size if size else np.hypot(q[:, 0], q[:, 1])
            k = int(off.argmax())
            if off[k] > tolerance:
                keep.add(a + 1 + k)
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return g.iloc[sorted(keep)][["set", "seq", "px", "py"]]

    return lines.groupBy("set").applyInPandas(run, "set string, seq long, px double, py double")


def envelope_smoothed(histograms: DataFrame, rounds: int = 4) -> DataFrame:
    """Counts replaced by the mean of their upper and lower envelopes, a few times; (image_id, bin, n)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("bin")
        n, at = g.n.to_numpy(float), np.arange(len(g))
        for _ in range(rounds):
            inner = n[1:-1]
            top = np.r_[0, 1 + np.flatnonzero((inner >= n[:-2]) & (inner >= n[2:])), len(n) - 1]
            low = np.r_[0, 1 + np.flatnonzero((inner <= n[:-2]) & (inner <= n[2:])), len(n) - 1]
            if len(top) < 4 or len(low) < 4:
                break
            n = (np.interp(at, top, n[top]) + np.interp(at, low, n[low])) / 2
        return pd.DataFrame({"image_id": g.image_id, "bin": g.bin, "n": n})

    return histograms.groupBy("image_id").applyInPandas(run, "image_id string, bin long, n double")


def best_curve(samples: DataFrame, degrees: tuple[int, ...] = (1, 2, 3, 4, 5, 6), tries: int = 30, seed: int = 3) -> DataFrame:
    """The best of polynomials (plain, and robust to outliers) and a sine, by adjusted r2: (set, kind, coef, mid, half, adj_r2).

    Coefficients are of (x - mid) / half.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["px", "py"])
        x, y = g.px.to_numpy(float), g.py.to_numpy(float)
        mid, half = (x.min() + x.max()) / 2, max(1e-9, (x.max() - x.min()) / 2)
        t, total = (x - mid) / half, max(1e-12, ((y - y.mean()) ** 2).sum())
        rate = lambda fit, k: 1 - (((y - fit) ** 2).sum() / max(1, len(y) - k - 1)) / (total / max(1, len(y) - 1))
        found, places = [], len(np.unique(t))
        for d in degrees:
            if places > d + 1:
                c = np.polynomial.polynomial.polyfit(t, y, d)
                found.append((rate(np.polynomial.polynomial.polyval(t, c), d), "polynomial", c))
        rng, most = np.random.default_rng(seed), None
        for _ in range(tries):
            if len(y) < 6:
                break
            pick = rng.choice(len(y), 4, replace=False)
            if len(np.unique(t[pick])) < 4:
                continue
            c = np.polynomial.polynomial.polyfit(t[pick], y[pick], 3)
            good = np.abs(np.polynomial.polynomial.polyval(t, c) - y) <= 20
            if most is None or good.sum() > most.sum():
                most = good
        if most is not None and len(np.unique(t[most])) > 4:
            c = np.polynomial.polynomial.polyfit(t[most], y[most], 3)
            found.append((rate(np.polynomial.polynomial.polyval(t, c), 3), "robust", c))
        for w in np.arange(0.5, 6.5, 0.5):
            a = np.column_stack([np.sin(w * t), np.cos(w * t), np.ones_like(t)])
            c = np.linalg.lstsq(a, y, rcond=None)[0]
            found.append((rate(a @ c, 4), "sine", np.r_[w, c]))
        r2, kind, c = max(found, key=lambda k: k[0])
        return pd.DataFrame({"set": [g["set"].iloc[0]], "kind": [kind], "coef": [[float(v) for v in c]], "mid": [float(mid)], "half": [float(half)], "adj_r2": [float(r2)]})

    return samples.groupBy("set").applyInPandas(run, "set string, kind string, coef array<double>, mid double, half double, adj_r2 double")


def polynomial_transform(pairs: DataFrame, degree: int = 2) -> DataFrame:
    """Least-squares maps from fixed to moving points (id, fx, fy, mx, my): coefficients of x and y by monomial."""
    powers = [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a = np.column_stack([group.fx.to_numpy(float) ** i * group.fy.to_numpy(float) ** j for i, j in powers])
        cx, cy = (np.linalg.lstsq(a, group[c].to_numpy(float), rcond=None)[0] for c in ("mx", "my"))
        return pd.DataFrame({"id": [group.id.iloc[0]] * len(powers), "px": [i for i, _ in powers], "py": [j for _, j in powers], "cx": cx, "cy": cy})

    return pairs.groupBy("id").applyInPandas(run, "id long, px int, py int, cx double, cy double")


def local_maps(pairs: DataFrame, share: float = 0.9) -> DataFrame:
    """Local weighted means, the maps: (id, point, x, y, reach, cx, cy) for each fixed point of (id, seq, fx, fy, mx, my).

    cx and cy are quadratics (1, x, y, x y, x^2, y^2) fitted to the point and its nearest ``share`` of the set's points,
    at least six; reach is the distance of the farthest of those. One set of control points a task.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("seq")
        f, m = g[["fx", "fy"]].to_numpy(float), g[["mx", "my"]].to_numpy(float)
        n, rows = min(len(g), max(6, round(share * len(g)))), []
        basis = np.column_stack([np.ones(len(f)), f[:, 0], f[:, 1], f[:, 0] * f[:, 1], f[:, 0] ** 2, f[:, 1] ** 2])
        for k in range(len(f)):
            d = np.hypot(*(f - f[k]).T)
            near = np.argsort(d, kind="stable")[:n]
            fit = np.linalg.lstsq(basis[near], m[near], rcond=None)[0]
            rows.append((g.id.iloc[0], k, *f[k], float(d[near].max()), fit[:, 0].tolist(), fit[:, 1].tolist()))
        return pd.DataFrame(rows, columns=["id", "point", "x", "y", "reach", "cx", "cy"])

    return pairs.groupBy("id").applyInPandas(run, "id string, point int, x double, y double, reach double, cx array<double>, cy array<double>")


def tuned_points(moving: DataFrame, fixed: DataFrame, spots: list[tuple[int, int]], half: int = 3, reach: int = 4) -> DataFrame:
    """For each spot, the shift of at most ``reach`` pixels at which the moving patch correlates best with the fixed one."""
    both = moving.join(fixed.withColumnRenamed("v", "w"), ["image_id", "y", "x"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b, rows = _dense(group), _dense(group, "w"), []
        for k, (y, x) in enumerate(spots):
            patch = lambda m, y, x: m[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1]
            q, best = patch(b, y, x), (-2.0, 0, 0)
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    if y + dy - half < 0 or x + dx - half < 0:
                        continue
                    p = patch(a, y + dy, x + dx)
                    if p.shape == q.shape and p.std() and q.std():
                        best = max(best, (round(float(np.corrcoef(p.ravel(), q.ravel())[0, 1]), 9), -dy, -dx))
            rows.append((group.image_id.iloc[0], k, -best[1], -best[2], best[0]))
        return pd.DataFrame(rows, columns=["image_id", "spot", "dy", "dx", "r"])

    return both.groupBy("image_id").applyInPandas(run, "image_id string, spot int, dy int, dx int, r double")


def demons(moving: DataFrame, fixed: DataFrame, rounds: int = 20) -> DataFrame:
    """A smooth displacement (image_id, y, x, dy, dx) that pulls the moving image towards the fixed one."""
    both = moving.join(fixed.withColumnRenamed("v", "w"), ["image_id", "y", "x"])

    def smooth(v: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            p = np.pad(v, [(2, 2) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
            n = v.shape[axis]
            v = sum(k * np.take(p, range(i, i + n), axis) for i, k in enumerate((1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)))
        return v

    def run(group: pd.DataFrame) -> pd.DataFrame:
        m, f = _dense(group), _dense(group, "w")
        scale = max(1e-9, np.abs(f).max())
        m, f = m / scale, f / scale
        h, w = f.shape
        yy, xx = np.mgrid[:h, :w]
        dy, dx = np.zeros_like(f), np.zeros_like(f)
        gy, gx = (np.gradient(f, axis=k) if f.shape[k] > 1 else np.zeros_like(f) for k in (0, 1))
        for _ in range(rounds):
            a, b = np.clip(yy + dy, 0, h - 1), np.clip(xx + dx, 0, w - 1)
            i, j = np.floor(a).astype(int), np.floor(b).astype(int)
            k, n = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
            u, v = a - i, b - j
            now = (1 - u) * ((1 - v) * m[i, j] + v * m[i, n]) + u * ((1 - v) * m[k, j] + v * m[k, n])
            d = f - now
            norm = gy**2 + gx**2 + d**2 + 1e-9
            dy, dx = smooth(dy + d * gy / norm), smooth(dx + d * gx / norm)
        return pd.DataFrame({"image_id": group.image_id, "y": group.y, "x": group.x, "dy": dy[group.y, group.x], "dx": dx[group.y, group.x]})

    return both.groupBy("image_id").applyInPandas(run, "image_id string, y long, x long, dy double, dx double")


def packed_circles(mask: DataFrame, least: float = 2.0) -> DataFrame:
    """Circles that fill a mask greedily, the largest free one first, until none of radius ``least`` is left: (image_id, circle, cy, cx, r, covered)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((group.y.max() + 3, group.x.max() + 3), bool)
        m[group.y + 1, group.x + 1] = True
        y, x = np.nonzero(m)
        free = regions.distance_grid(m)[y, x]
        rows, done = [], np.zeros(len(y), bool)
        while free.max() >= least:
            i = int(np.lexsort([x, y, -free])[0])
            r = float(free[i])
            d = np.hypot(y - y[i], x - x[i])
            done |= d < r
            rows.append((group.image_id.iloc[0], len(rows), int(y[i]) - 1, int(x[i]) - 1, round(r, 6), float(done.mean())))
            free = np.minimum(free, d - r)
        return pd.DataFrame(rows, columns=["image_id", "circle", "cy", "cx", "r", "covered"])

    return mask.groupBy("image_id").applyInPandas(run, "image_id string, circle int, cy long, cx long, r double, covered double")


def free_directions(mask: DataFrame, cy: int, cx: int, bins: int = 72) -> DataFrame:
    """Mask pixels round a point by angular bin, and whether a bin is a (cyclic) least one."""
    at = F.floor(F.pmod(F.degrees(F.atan2(F.col("y") - cy, F.col("x") - cx)), F.lit(360.0)) / (360 / bins)).cast("int")
    seen = mask.filter((F.col("y") != cy) | (F.col("x") != cx)).groupBy("image_id", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return seen


def _nearest_centres(step: int, weight: float, reach: float, block: int = 32):
    """The nearest of a tile's centres for its pixels, block by block; ``sure``: whether no centre outside the reach can be nearer."""

    def run(pixels: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        centres = centres.sort_values(["a", "b"])
        c = centres[["cr", "cg", "cb", "cy", "cx"]].to_numpy(float)
        cy, cx, name = c[:, 3] * step / weight, c[:, 4] * step / weight, centres[["a", "b"]].to_numpy(np.int64)
        pixels = pixels.sort_values(["y", "x"], ignore_index=True)
        p = np.column_stack([pixels.r, pixels.g, pixels.b, weight * pixels.y / step, weight * pixels.x / step]).astype(float)
        found, sure = np.zeros((len(p), 2), np.int64), np.zeros(len(p), bool)
        for (j, i), at in pixels.groupby([pixels.y // block, pixels.x // block]).indices.items():
            near = np.flatnonzero((cy >= j * block - reach) & (cy <= j * block + block - 1 + reach) & (cx >= i * block - reach) & (cx <= i * block + block - 1 + reach))
            if len(near):
                d = sum((c[near, k][None] - p[at, k][:, None]) ** 2 for k in range(5))
                best = d.argmin(axis=1)  # the first of equals
                found[at] = name[near[best]]
                sure[at] = ~(d[np.arange(len(at)), best] >= (reach * weight / step) ** 2)
        return pixels.assign(ca=found[:, 0], cb=found[:, 1], sure=sure)

    return run


def superpixels(rgb: DataFrame, step: int = 8, rounds: int = 5, weight: float = 0.5, tile: int = 256, margin: int = 48) -> DataFrame:
    """(image_id, y, x, label): clusters of colour and place around a grid of centres; ``weight`` (above 0) is that of place.

    Each round every pixel goes to its nearest centre, the first of equals; labels count an image's remaining clusters
    in order. Tiles see the centres up to ``margin`` pixels around them; where a pixel's nearest lies as far as what
    that leaves out, the round is run again with twice the margin, so the result is that of all centres.
    """
    if weight <= 0:
        raise ValueError("the weight of place must be above 0")
    tiled, kept = ["image_id", "ty", "tx"], ["y", "x", "r", "g", "b"]
    whole = [F.col(c).cast("long").alias(c) for c in "yx"] + [F.col(c).cast("double").alias(c) for c in "rgb"]
    grid = [F.floor(F.col(c) / step).alias(f"c{n}") for c, n in zip("yx", "ab", strict=True)]  # (ca, cb): where a cluster began; its name and order
    now = regions.shared_copy(rgb.select("image_id", *[F.floor(F.col(c) / tile).alias(f"t{c}") for c in "yx"], *whole, *grid))
    schema = "image_id string, ty long, tx long, y long, x long, r double, g double, b double, ca long, cb long, sure boolean"
    for _ in range(rounds):
        mean = [F.avg(v).alias(f"c{c}") for c, v in [(c, F.col(c)) for c in "rgb"] + [(c, weight * F.col(c) / step) for c in "yx"]]
        centres = regions.shared_copy(now.select("image_id", F.col("ca").alias("a_"), F.col("cb").alias("b_"), *kept).groupBy("image_id", "a_", "b_").agg(*mean))
        centres = centres.withColumnsRenamed({"a_": "a", "b_": "b"})
        while True:
            edge = lambda c, d: F.greatest(F.lit(0), F.floor((F.col(c) * step / weight + d) / tile))
            seen = centres
            for c in "yx":
                seen = seen.withColumn(f"t{c}", F.explode(F.sequence(edge(f"c{c}", -margin - 1), edge(f"c{c}", margin + 1))))
            pairs = now.select(*tiled, *kept).groupBy(*tiled).cogroup(seen.groupBy(*tiled))
            fresh = regions.shared_copy(pairs.applyInPandas(_nearest_centres(step, weight, margin), schema))
            if fresh.filter("not sure").isEmpty():
                break
            margin *= 2
        now = fresh.drop("sure")
    # labels: clusters of earlier grid rows, then those before it in its row
    names = now.select("image_id", "ca", "cb").distinct()
    ahead = names.groupBy("image_id", "ca").agg(F.count(F.lit(1)).alias("n"))
    ahead = ahead.select("image_id", "ca", (F.sum("n").over(Window.partitionBy("image_id").orderBy("ca")) - F.col("n")).alias("before"))
    names = names.select("image_id", "ca", "cb", F.row_number().over(Window.partitionBy("image_id", "ca").orderBy("cb")).alias("k"))
    labels = names.join(ahead, ["image_id", "ca"]).select("image_id", "ca", "cb", (F.col("before") + F.col("k") - 1).cast("long").alias("label"))
    return now.join(labels, ["image_id", "ca", "cb"]).select(*KEY, "label")


def graph_cut(r: DataFrame, inside: DataFrame, smooth: float = 2.0, rounds: int = 10) -> DataFrame:
    """Foreground of least energy by repeated local minimisation: likeness to the two regions' means, and equal neighbours."""
    both = r.join(inside.select("image_id", "y", "x", F.lit(1).alias("m")), ["image_id", "y", "x"], "left").fillna({"m": 0})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        v, m = _dense(group), _dense(group, "m") > 0
        parity = np.add.outer(np.arange(v.shape[0]), np.arange(v.shape[1])) % 2
        for _ in range(rounds):
            if m.all() or not m.any():
                break
            spread = max(v.std(), 1e-9)
            pull = (((v - v[~m].mean()) ** 2 - (v - v[m].mean()) ** 2) / spread**2)
            before = m.copy()
            for side in (0, 1):  # neighbours of one colour of the chessboard are fixed while the other moves
                p = np.pad(m.astype(float) * 2 - 1, 1)
                vote = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]
                m = np.where(parity == side, pull + smooth * vote > 0, m)
            if (m == before).all():
                break
        y, x = np.nonzero(m)
        return pd.DataFrame({"image_id": [group.image_id.iloc[0]] * len(y), "y": y, "x": x})

    return both.groupBy("image_id").applyInPandas(run, "image_id string, y long, x long")
