"""Histogram sort: shards of near equal bytes from exact counts below refined key boundaries, then one exchange.

The sort key is (63 bits of a hash of the text, identifier): equal texts are neighbours, yet every row has its own
place, so even a group of copies with a third of all rows can be cut where the balance asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import local_table, materialize, whole_text

FIRST_BITS, PROBES, MAX_LEVELS, CELL_SHARE = 12, 64, 48, 1024


@dataclass
class Cell:
    """A half-open key interval with its exact counts. ``path`` orders the cells."""

    path: tuple[int, ...]
    cell: int
    rows: int
    size: int
    low: tuple[int, int]
    high: tuple[int, int]


def _counts(rows: DataFrame) -> list:
    found = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"), F.min(F.struct("h", "k")).alias("low"), F.max(F.struct("h", "k")).alias("high"))
    return found.collect()  # at most 2**FIRST_BITS cells, or PROBES for each interval that is refined


def _cut(cells: list[Cell], shards: int, tolerance: float, most_rows: int) -> set[int]:
    """The cells to probe more finely: those with a splitter further off than tolerance, and those with too many rows."""
    total, below, again = sum(c.size for c in cells), 0, set()
    slack = tolerance * total / shards
    targets = [total * i / shards for i in range(1, shards)]
    at = 0
    for c in cells:
        while at < len(targets) and targets[at] <= below + c.size:
            if min(targets[at] - below, below + c.size - targets[at]) > slack and c.low != c.high:
                again.add(c.cell)
            at += 1
        if c.rows > most_rows and c.low != c.high:
            again.add(c.cell)
        below += c.size
    return again


def histogram_sort_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002) -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard for every row.

    size: UTF-8 bytes plus 1 (null text: 1). Shard boundaries lie within ``tolerance`` of a shard's share of all bytes
    (or as near as one row allows); slots number a shard's rows from 0 in key order without a gap. A null identifier
    sorts below all others. Rows equal in text and identifier are interchangeable: they share a key, and get
    consecutive slots. Extra columns are ignored; an empty table gives an empty result. Each refinement step counts only the
    rows of the intervals in doubt; what the driver receives is bounded by the number of probes.
    """
    text = whole_text(text_col)
    least = -(2**63)
    first = 63 - FIRST_BITS
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("k"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(F.lit(2**63 - 1)).alias("h"),
    )
    rows = materialize(rows, "keys").withColumn("cell", F.shiftright("h", first).cast("long"))
    spark, next_cell = docs.sparkSession, 1 << FIRST_BITS
    cells = sorted((Cell((r.cell,), r.cell, r.rows, r["size"], tuple(r.low), tuple(r.high)) for r in _counts(rows)), key=lambda c: c.path)
    most = max(16, sum(c.rows for c in cells) // CELL_SHARE)
    for _ in range(MAX_LEVELS):
        again = _cut(cells, shards, tolerance, most)
        if not again:
            break
        probes, parents = [], {}
        for c in (c for c in cells if c.cell in again):
            by_id = c.low[0] == c.high[0]
            low, high = (c.low[1], c.high[1]) if by_id else (c.low[0], c.high[0])
            width = (high - low) // PROBES + 1
            probes.append((c.cell, by_id, low, width, next_cell))
            for i in range(PROBES):
                parents[next_cell + i] = (*c.path, i)
            next_cell += PROBES
        table = F.broadcast(local_table(spark, probes, "cell bigint, by_id boolean, low bigint, width decimal(20), base bigint"))
        at = F.when(F.col("by_id"), F.col("k")).otherwise(F.col("h")).cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)")
        rows = rows.join(table, "cell", "left").withColumn("cell", F.when(F.col("base").isNull(), F.col("cell")).otherwise(F.col("base") + F.floor(at / F.col("width")).cast("long"))).drop("by_id", "low", "width", "base")
        fresh = _counts(rows.filter(F.col("cell") >= next_cell - PROBES * len(probes)))
        cells = [c for c in cells if c.cell not in again] + [Cell(parents[r.cell], r.cell, r.rows, r["size"], tuple(r.low), tuple(r.high)) for r in fresh]
        cells.sort(key=lambda c: c.path)
    total, below, held, placed = sum(c.size for c in cells), 0, [0] * shards, []
    for c in cells:
        shard = min(shards - 1, int((below + c.size / 2) * shards / total))
        placed.append((c.cell, shard, held[shard]))
        held[shard] += c.rows
        below += c.size
    where = F.broadcast(local_table(spark, placed, "cell bigint, shard int, before bigint"))
    order = Window.partitionBy("cell").orderBy("h", "k")
    return rows.withColumn("rank", F.row_number().over(order)).join(where, "cell").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_histogram_sort(spark, sf_dir: str) -> DataFrame:
    return histogram_sort_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
