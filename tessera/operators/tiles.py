"""Neighbourhood filters on halo tiles: pixels near a seam go to the tiles beside it too, and each tile is one dense array.

A tile of ``TILE`` pixels a side with a halo of h is read once and (1 + 2 h / TILE)^2 times its pixels cross the
shuffle, whatever the neighbourhood's size; no image has to fit into a task. Numbers are combined by numpy.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE, PACKED = 256, 1 << 20
BORDERS = {"zero": {"mode": "constant", "constant_values": 0.0}, "clip": {"mode": "constant", "constant_values": np.nan}, "symmetric": {"mode": "symmetric"}, "replicate": {"mode": "edge"}}


def extents(r: DataFrame) -> DataFrame:
    """(image_id, my, mx): each image's greatest y and x."""
    return r.groupBy("image_id").agg(F.max("y").cast("long").alias("my"), F.max("x").cast("long").alias("mx"))


def _packed(r: DataFrame, halo: int, tile: int) -> DataFrame:
    """Pixels as arrays, some thousand of a tile (with its halo) a row: (image_id, ty, tx, y, x, v), places within the tile."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        names = t.column(0).combine_chunks().dictionary_encode()
        code, y, x, v = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), *(t.column(i).to_numpy() for i in (1, 2, 3))
        ylow, yhigh, xlow, xhigh = np.maximum((y - halo) // tile, 0), (y + halo) // tile, np.maximum((x - halo) // tile, 0), (x + halo) // tile
        parts = []
        for i in range(3):
            for j in range(3):
                at = np.flatnonzero((ylow + i <= yhigh) & (xlow + j <= xhigh))
                if len(at):
                    parts.append((at, ylow[at] + i, xlow[at] + j))
        at, ty, tx = (np.concatenate(p) for p in zip(*parts, strict=True))
        key = (code[at] * (ty.max() + 1) + ty) * (tx.max() + 1) + tx
        order = np.argsort(key, kind="stable")
        at, ty, tx, key = at[order], ty[order], tx[order], key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        cut = [*start.tolist(), len(key)]
        blobs = [[a[i:j].tobytes() for i, j in itertools.pairwise(cut)] for a in ((y[at] - ty * tile).astype("<i4"), (x[at] - tx * tile).astype("<i4"), v[at].astype("<f8"))]
        return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code[at[start]])), pa.array(ty[start]), pa.array(tx[start]), *(pa.array(b, pa.binary()) for b in blobs)], names=["image_id", "ty", "tx", "y", "x", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= PACKED:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    plain = r.filter("image_id is not null").select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    return plain.mapInArrow(pack, "image_id string, ty long, tx long, y binary, x binary, v binary")


def by_tiles(r: DataFrame, halo: int, run: Callable[[np.ndarray], np.ndarray], border: str = "zero", tile: int = TILE, box: DataFrame | None = None) -> DataFrame:
    """``run`` on every tile with its halo: (h + 2 halo, w + 2 halo) -> (h, w); pixels that are missing are NaN.

    Outside the image the halo is filled as ``border`` says: 0, left out (NaN), mirrored with the edge pixel, or the
    nearest pixel. Extents run from 0 to each image's greatest y and x; ``box`` (as of ``extents``) saves reading ``r`` for them.
    Pixels cross the shuffle as arrays. Keeps the type of v where it is a whole number
    and the result is one of the values (``run`` returns what it was given), else double.
    """
    tile = max(tile, halo)
    box = extents(r) if box is None else box
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(m) / tile)))
    none = F.lit(None).cast("binary")
    marks = box.filter("image_id is not null").withColumn("ty", every("my")).withColumn("tx", every("mx")).select("image_id", "ty", "tx", none.alias("y"), none.alias("x"), none.alias("v"), "my", "mx")
    nothing = F.lit(None).cast("long")
    sent = _packed(r, halo, tile).select("*", nothing.alias("my"), nothing.alias("mx")).unionByName(marks)

    def one(group: pa.Table) -> pa.Table:
        y, x, v = (np.frombuffer(b"".join(k for k in group.column(c).to_pylist() if k), t) for c, t in (("y", "<i4"), ("x", "<i4"), ("v", "<f8")))
        size = [m for m in zip(group.column("my").to_pylist(), group.column("mx").to_pylist(), strict=True) if m[0] is not None]
        if not size or not len(y):  # a tile beyond the image, or without pixels
            return _pixel_table(None, y[:0], x[:0], v[:0])
        ty, tx = group.column("ty")[0].as_py(), group.column("tx")[0].as_py()
        ends, pads = [], []
        for t, m in zip((ty, tx), size[0], strict=True):
            a, b = t * tile, min(m + 1, t * tile + tile)
            low, high = max(0, a - halo), min(m + 1, b + halo)
            ends.append((a, b, low, high))
            pads.append((halo - (a - low), halo - (high - b)))
        (a, b, y0, y1), (c, d, x0, x1) = ends
        dense = np.full((y1 - y0, x1 - x0), np.nan)
        near = (y >= y0 - a) & (y < y1 - a) & (x >= x0 - c) & (x < x1 - c)
        dense[y[near] + (a - y0), x[near] + (c - x0)] = v[near]
        done = run(np.pad(dense, pads, **BORDERS[border]))
        own = (y >= 0) & (y < b - a) & (x >= 0) & (x < d - c)
        y, x = y[own], x[own]
        return _pixel_table(group.column("image_id")[0].as_py(), y.astype(np.int64) + a, x.astype(np.int64) + c, done[y, x].astype(float))

    return sent.groupBy("image_id", "ty", "tx").applyInArrow(one, "image_id string, y long, x long, v double")


def _pixel_table(image: str | None, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> pa.Table:
    return pa.table([pa.repeat(pa.scalar(image, pa.string()), len(y)), pa.array(y, pa.int64()), pa.array(x, pa.int64()), pa.array(v, pa.float64())], names=["image_id", "y", "x", "v"])


def shifts(a: np.ndarray, half: int):
    """(dy, dx, the array shifted so) of a padded array, for every offset of the square."""
    h, w = a.shape[0] - 2 * half, a.shape[1] - 2 * half
    for dy in range(-half, half + 1):
        for dx in range(-half, half + 1):
            yield dy, dx, a[half + dy : half + dy + h, half + dx : half + dx + w]


def footprint(shape: str, radius: int) -> np.ndarray:
    """A flat neighbourhood of side 2 radius + 1: "square", "disk" (Euclidean), "diamond" (L1), "octagon" or "rounded" (a square without its corners)."""
    d = np.abs(np.arange(-radius, radius + 1))
    dy, dx = d[:, None], d[None, :]
    if shape == "square":
        return np.ones((2 * radius + 1,) * 2, bool)
    if shape == "disk":
        return dy * dy + dx * dx <= radius * radius
    if shape == "diamond":
        return dy + dx <= radius
    if shape == "octagon":
        return dy + dx <= radius + radius // 3
    if shape == "rounded":
        return ~((dy == radius) & (dx == radius))
    raise ValueError(f"no such shape: {shape}")


def _rows_of(foot: np.ndarray) -> list[tuple[int, int]]:
    """(dy, half width) of a footprint whose rows are symmetric runs."""
    half = len(foot) // 2
    return [(i - half, int(foot[i].sum()) // 2) for i in range(len(foot)) if foot[i].any()]


def extreme(r: DataFrame, shape: str, radius: int, greatest: bool, tile: int = TILE) -> DataFrame:
    """Least or greatest value over a neighbourhood clipped to the image: flat erosion and dilation."""
    return extremes(r, shape, radius, (greatest,), tile)


def extremes(r: DataFrame, shape: str, radius: int, greatest: tuple[bool, ...], tile: int = TILE, box: DataFrame | None = None) -> DataFrame:
    """Several erosions (False) and dilations (True) after one another, within one halo.

    Row minima are widened step by step and combined over rows, so work is in proportion to the radius, not its square.
    Between steps missing pixels and those outside the image stay out.
    """
    rows = _rows_of(footprint(shape, radius))

    def step(a: np.ndarray, how: Callable) -> np.ndarray:
        h, w = a.shape[0] - 2 * radius, a.shape[1] - 2 * radius
        wide, now = {0: a[:, radius : radius + w]}, a[:, radius : radius + w]
        for k in range(1, max(n for _, n in rows) + 1):
            now = how(now, how(a[:, radius - k : radius - k + w], a[:, radius + k : radius + k + w]))
            wide[k] = now
        out = None
        for dy, n in rows:
            part = wide[n][radius + dy : radius + dy + h]
            out = part if out is None else how(out, part)
        return out

    def run(a: np.ndarray) -> np.ndarray:
        for g in greatest:
            inner = a[radius : a.shape[0] - radius, radius : a.shape[1] - radius]
            a = np.where(np.isnan(inner), np.nan, step(a, np.fmax if g else np.fmin))
        return a

    return _typed(by_tiles(r, radius * len(greatest), run, "clip", tile, box), r)


def _typed(out: DataFrame, r: DataFrame) -> DataFrame:
    return out.withColumn("v", F.col("v").cast(r.schema["v"].dataType))


def eroded(r: DataFrame, shape: str = "disk", radius: int = 3, tile: int = TILE) -> DataFrame:
    return extreme(r, shape, radius, False, tile)


def dilated(r: DataFrame, shape: str = "disk", radius: int = 3, tile: int = TILE) -> DataFrame:
    return extreme(r, shape, radius, True, tile)


def opened(r: DataFrame, shape: str = "disk", radius: int = 3, tile: int = TILE) -> DataFrame:
    return extremes(r, shape, radius, (False, True), tile)


def closed(r: DataFrame, shape: str = "disk", radius: int = 3, tile: int = TILE, box: DataFrame | None = None) -> DataFrame:
    return extremes(r, shape, radius, (True, False), tile, box)


def lines(r: DataFrame, across: list[float], down: list[float], tile: int = TILE, box: DataFrame | None = None) -> DataFrame:
    """Correlation with odd numbers of taps along rows and then along columns, as two passes of one halo; what is missing counts as 0."""
    half = max(len(across), len(down)) // 2

    def run(a: np.ndarray) -> np.ndarray:
        a = np.where(np.isnan(a), 0.0, a)
        h, w = a.shape[0] - 2 * half, a.shape[1] - 2 * half
        row = [k * a[:, half + i - len(across) // 2 :][:, :w] for i, k in enumerate(across) if k]
        a = sum(row[1:], row[0])
        column = [k * a[half + i - len(down) // 2 :][:h] for i, k in enumerate(down) if k]
        return sum(column[1:], column[0])

    return by_tiles(r, half, run, "zero", tile, box)


def correlated(r: DataFrame, kernel: list[list[float]], border: str = "zero", tile: int = TILE) -> DataFrame:
    """Sum of the neighbourhood weighted by a small square kernel."""
    half, k = len(kernel) // 2, np.array(kernel, float)

    def run(a: np.ndarray) -> np.ndarray:
        return sum(k[dy + half, dx + half] * s for dy, dx, s in shifts(a, half) if k[dy + half, dx + half])

    return by_tiles(r, half, run, border, tile)


def ranked(r: DataFrame, rank: int, foot: np.ndarray, border: str = "zero", tile: int = TILE) -> DataFrame:
    """The rank-th smallest (from 1) of the values under a footprint; rows of the tile are sorted some at a time."""
    half = len(foot) // 2
    cells = np.flatnonzero(foot.ravel())

    def run(a: np.ndarray) -> np.ndarray:
        views = np.lib.stride_tricks.sliding_window_view(a, foot.shape)
        step = max(1, (1 << 22) // max(1, views.shape[1] * len(cells)))
        rows = [np.partition(views[i : i + step].reshape(-1, views.shape[1], foot.size)[..., cells], rank - 1, axis=2)[..., rank - 1] for i in range(0, len(views), step)]
        return np.concatenate(rows)

    return _typed(by_tiles(r, half, run, border, tile), r)


def deviation(r: DataFrame, half: int = 1, border: str = "symmetric", tile: int = TILE) -> DataFrame:
    """Sample deviation of the square neighbourhood; of one pixel alone, null."""

    def run(a: np.ndarray) -> np.ndarray:
        parts = [s for _, _, s in shifts(a, half)]
        n = sum((~np.isnan(s)).astype(float) for s in parts)
        mean = sum(np.nan_to_num(s) for s in parts) / np.maximum(n, 1)
        return np.sqrt(sum(np.nan_to_num(s - mean) ** 2 for s in parts) / np.where(n > 1, n - 1, np.nan))

    out = by_tiles(r, half, run, border, tile)
    return out.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def entropy(levelled: DataFrame, half: int = 4, border: str = "symmetric", tile: int = TILE) -> DataFrame:
    """Entropy in bits of the levels in the square neighbourhood."""

    def run(a: np.ndarray) -> np.ndarray:
        side = 2 * half + 1
        views = np.lib.stride_tricks.sliding_window_view(a, (side, side))
        step = max(1, (1 << 21) // max(1, views.shape[1] * side * side))
        return np.concatenate([_entropies(views[i : i + step].reshape(-1, side * side)).reshape(-1, views.shape[1]) for i in range(0, len(views), step)])

    return by_tiles(levelled, half, run, border, tile)


def _entropies(rows: np.ndarray) -> np.ndarray:
    """For each row of numbers (NaN: none), the entropy of its values' shares."""
    s = np.sort(rows, axis=1)  # NaN last
    n, width = s.shape
    total = (~np.isnan(s)).sum(axis=1)
    first = np.ones(s.shape, bool)
    first[:, 1:] = s[:, 1:] != s[:, :-1]
    first &= ~np.isnan(s)
    at = np.flatnonzero(first.ravel())
    row = at // width
    stop = np.r_[at[1:], 0]
    last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
    stop[last] = (row * width + total[row])[last]
    run = (stop - at).astype(float)
    return np.log2(np.maximum(total, 1)) - np.bincount(row, run * np.log2(run), n) / np.maximum(total, 1)


def bilateral(r: DataFrame, half: int, sigma: float, spread: float, tile: int = TILE) -> DataFrame:
    """Mean of the neighbourhood inside the image, weighted by distance and by likeness in value."""

    def run(a: np.ndarray) -> np.ndarray:
        centre = a[half : a.shape[0] - half, half : a.shape[1] - half]
        total, weight = np.zeros(centre.shape), np.zeros(centre.shape)
        for dy, dx, s in shifts(a, half):
            w = np.where(np.isnan(s), 0.0, np.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma) - (s - centre) ** 2 / (2 * spread * spread)))
            total += w * np.nan_to_num(s)
            weight += w
        return total / weight

    return by_tiles(r, half, run, "clip", tile)


def neighbour_mean(r: DataFrame, tile: int = TILE) -> DataFrame:
    """Mean of the present pixels of the 3 x 3 neighbourhood; null where there is none."""

    def run(a: np.ndarray) -> np.ndarray:
        n = sum((~np.isnan(s)).astype(float) for _, _, s in shifts(a, 1))
        return sum(np.nan_to_num(s) for _, _, s in shifts(a, 1)) / np.where(n > 0, n, np.nan)

    out = by_tiles(r, 1, run, "clip", tile)
    return out.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def mixed_median(r: DataFrame, rounds: int = 2, tile: int = TILE) -> DataFrame:
    """Each round three medians with mirrored borders: rank 11 of a 5 x 5 square without corners, 13 of the whole square, 7 of a diamond of radius 2."""
    for _ in range(rounds):
        for rank, shape in ((11, "rounded"), (13, "square"), (7, "diamond")):
            r = ranked(r, rank, footprint(shape, 2), "symmetric", tile)
    return r
