"""Rasters, masks, point sets and file catalogues as DataFrames.

A raster has one row a pixel: (image_id, y, x, v); coordinates are 0-based. The builders here view the relational
test tables as rasters, so every operator can run on shared inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantity_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-numbered raster of at most 64 x 64: summed quantity by part and supplier number; missing cells are 0."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy((F.col("l_partkey") % 64).alias("y"), (F.col("l_suppkey") % 64).alias("x")).agg(F.sum("l_quantity").cast("long").alias("v"))
    extent = sums.agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    cells = extent.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("my").cast("long"))).alias("y"), "mx").select("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mx").cast("long"))).alias("x"))
    return cells.join(sums, ["y", "x"], "left").select(F.lit("q").alias("image_id"), "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def parts_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-numbered raster with a row of 64 pixels for each part number: summed quantity by supplier number mod 64.

    A row's sums meet as one map, and the row is spread into pixels last, so pixels never cross a shuffle here.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("y"), (F.col("l_suppkey") % 64).alias("x"), "l_quantity").filter("y is not null and x is not null")
    sums = lines.repartition("y").groupBy("y", "x").agg(F.sum("l_quantity").cast("long").alias("v"))
    rows = sums.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("x", "v"))).alias("m"))
    zero = F.lit(0).cast("long")
    block = parts_extents(spark, sf_dir).select("my", F.explode(F.sequence(zero, F.floor(F.col("my") / 4096))).alias("k"))
    every = block.select(F.explode(F.sequence(F.col("k") * 4096, F.least("my", F.col("k") * 4096 + 4095))).alias("y"))
    cells = every.join(rows, "y", "left").select("y", "m", F.explode(F.sequence(zero, F.lit(63).cast("long"))).alias("x"))
    return cells.select(F.lit("parts").alias("image_id"), "y", "x", F.coalesce(F.col("m")[F.col("x")], zero).alias("v"))


def parts_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, my, mx) of ``parts_raster``."""
    return table(spark, sf_dir, "lineitem").filter("l_suppkey is not null").agg(F.max("l_partkey").alias("my")).filter("my is not null").select(F.lit("parts").alias("image_id"), "my", F.lit(63).cast("long").alias("mx"))


def embedding_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real-valued raster: one row of pixels for each vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")).select(F.lit("e").alias("image_id"), F.col("y").cast("long"), F.col("x").cast("long"), F.col("v").cast("double"))


def rgb_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels of 21 columns each from the embedding raster, each min-max scaled to [0, 1]."""
    e = embedding_raster(spark, sf_dir).filter("x < 63")
    wide = e.groupBy("image_id", "y", (F.col("x") % 21).alias("x")).agg(*[F.max(F.when(F.floor(F.col("x") / 21) == k, F.col("v"))).alias(c) for k, c in enumerate("rgb")])
    ends = wide.agg(*[f(c).alias(f"{n}{c}") for c in "rgb" for n, f in (("lo", F.min), ("hi", F.max))])
    return wide.crossJoin(F.broadcast(ends)).select("image_id", "y", "x", *[((F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}"))).alias(c) for c in "rgb"])


def mask_of(raster: DataFrame, at_least: float) -> DataFrame:
    """The sparse mask (image_id, y, x) of pixels of at least a value."""
    return raster.filter(F.col("v") >= at_least).select("image_id", "y", "x")


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """Tiles or pixels that ``write_raster`` stored."""
    return spark.read.parquet(path)


def write_raster(raster: DataFrame, path: str, version: int = 1) -> None:
    """Store a raster or mask, partitioned by image and version, as a versioned artefact."""
    raster.withColumn("version", F.lit(version)).write.partitionBy("image_id", "version").mode("append").parquet(path)
