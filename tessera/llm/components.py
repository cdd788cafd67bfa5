"""Connected components of an edge table by alternating star steps; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize


def _pointed(pairs: DataFrame, rows: int) -> DataFrame:
    """Edges (u, v) with ``least``: the smallest of u and all its neighbours v; hot nodes are joined by broadcast."""
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg")).select("u", F.least("u", "m").alias("least"), "deg"), "least")
    return hot_join(pairs, least, "u", "deg", rows)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node of its component.

    Large-star links each larger neighbour to the smallest one seen; small-star does so for the smaller ones; both
    keep components as they are, and the edges become stars in a logarithmic number of rounds. Every round's edges
    are written to the shared folder, so no lineage grows. Labels that have not settled after ``most_rounds`` are an
    error, never a result.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if not seen.n or tuple(seen) == before:
            break
        before = tuple(seen)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pointed(both, 2 * seen.n).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = materialize(large.filter("u != v").distinct(), "large")
        small = _pointed(large, seen.n)
        small = small.select("v", F.col("least").alias("w")).unionByName(small.select(F.col("u").alias("v"), F.col("least").alias("w")))
        now = materialize(small.filter("v != w").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct(), "small")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
