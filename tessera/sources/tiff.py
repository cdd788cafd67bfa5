"""Baseline TIFF (uncompressed, strips, chunky) as a source and sink, and matrices as CSV."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tag numbers and field sizes of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
_FIELD = {1: "B", 3: "H", 4: "I", 16: "Q"}
_KIND = {1: "u", 2: "i", 3: "f"}


def fields(data: bytes) -> tuple[str, list[dict[int, tuple]]]:
    """Byte order, and each page's directory: tag -> values."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages, seen = struct.unpack(order + "I", data[4:8])[0], [], set()
    while at and at not in seen:
        seen.add(at)
        n, page = struct.unpack(order + "H", data[at : at + 2])[0], {}
        for k in range(n):
            tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
            if kind in _FIELD:
                size = struct.calcsize(_FIELD[kind]) * count
                start = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
                page[tag] = struct.unpack(f"{order}{count}{_FIELD[kind]}", data[start : start + size])
        pages.append(page)
        at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return order, pages


def strips(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(page, first row, rows x width x samples) of every strip of an uncompressed file."""
    order, pages = fields(data)
    for number, page in enumerate(pages):
        if page.get(COMPRESSION, (1,))[0] != 1:
            raise ValueError("compressed TIFF files are not read")
        width, height, samples = page[WIDTH][0], page[HEIGHT][0], page.get(SAMPLES, (1,))[0]
        kind = np.dtype(f"{order}{_KIND[page.get(FORMAT, (1,))[0]]}{page.get(BITS, (8,))[0] // 8}")
        rows, first = page.get(ROWS, (height,))[0], 0
        for at in page[OFFSETS]:
            many = min(rows, height - first)
            yield number, first, np.frombuffer(data, kind, many * width * samples, at).reshape(many, width, samples)
            first += many


def encode(pages: list[np.ndarray]) -> bytes:
    """Pages (height x width, or x samples) as one little-endian, uncompressed file."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for a in pages:
        a = a[..., None] if a.ndim == 2 else a
        a = np.ascontiguousarray(a, a.dtype.newbyteorder("<"))
        start = len(out)
        out += a.tobytes() + b"\0" * (a.nbytes % 2)
        samples = a.shape[2]
        bits = len(out)
        out += struct.pack(f"<{samples}H", *[a.dtype.itemsize * 8] * samples) + b"\0" * (2 * samples % 4)
        entries = [(WIDTH, 4, 1, a.shape[1]), (HEIGHT, 4, 1, a.shape[0]), (BITS, 3, samples, bits if samples > 2 else a.dtype.itemsize * 8 * (1 + (samples > 1) * 65536)), (COMPRESSION, 3, 1, 1), (PHOTOMETRIC, 3, 1, 2 if samples >= 3 else 1)]
        entries += [(OFFSETS, 4, 1, start), (SAMPLES, 3, 1, samples), (ROWS, 4, 1, a.shape[0]), (COUNTS, 4, 1, a.nbytes), (FORMAT, 3, 1, {"u": 1, "i": 2, "f": 3}[a.dtype.kind])]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def headers(spark: SparkSession, folder: str, pattern: str = "*.{tif,tiff}") -> DataFrame:
    """(path, page, height, width, samples, bits) of every file, one row a page, without decoding pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.path, k, p[HEIGHT][0], p[WIDTH][0], p.get(SAMPLES, (1,))[0], p.get(BITS, (8,))[0]) for r in batch.itertuples() for k, p in enumerate(fields(r.content)[1])]
            yield pd.DataFrame(rows, columns=["path", "page", "height", "width", "samples", "bits"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, page long, height long, width long, samples long, bits long")


def read_images(spark: SparkSession, folder: str, pattern: str = "*.{tif,tiff}") -> DataFrame:
    """Pixels (image_id, page, y, x, c, v) of every file; image_id is the path. A fourth channel and beyond are left out.

    A file is decoded strip by strip in the task that reads it; the file itself must fit into that task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                for page, first, a in strips(r.content):
                    a = a[..., :3]
                    step = max(1, 200_000 // max(1, a.shape[1] * a.shape[2]))
                    for k in range(0, len(a), step):
                        part = a[k : k + step]
                        y, x, c = (g.ravel() for g in np.indices(part.shape))
                        yield pd.DataFrame({"image_id": r.path, "page": page, "y": y + first + k, "x": x, "c": c, "v": part.ravel().astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, "image_id string, page long, y long, x long, c long, v double")


def encoded(pixels: DataFrame, kind: str = "uint8") -> DataFrame:
    """(image_id, content): one file's bytes per image of (image_id, page, y, x, c, v); missing pixels are 0. One image a task."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        pages = []
        for _, g in group.groupby("page"):
            a = np.zeros((g.y.max() + 1, g.x.max() + 1, g.c.max() + 1), kind)
            a[g.y, g.x, g.c] = g.v
            pages.append(a)
        return pd.DataFrame({"image_id": [group.image_id.iloc[0]], "content": [encode(pages)]})

    return pixels.groupBy("image_id").applyInPandas(one, "image_id string, content binary")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Rows of numbers from CSV without a header, as columns c0, c1, ..."""
    found = spark.read.option("inferSchema", "true").csv(path)
    return found.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(found.columns)])


def write_matrix(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path)
