"""New catalogue files as a stream: parsed as they arrive, each newest version kept with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, arrived) from Parquet files that land in ``folder``."""
    return spark.readStream.schema("path string, arrived timestamp").parquet(folder)


def newest(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The highest version seen of every group, sample, stain and kind; state older than ``late`` is dropped by window."""
    timed = stream.withWatermark("arrived", late)
    name = F.regexp_replace("path", r"\.[A-Za-z]+$", "")
    part = F.split(name, "_")
    keyed = timed.select(F.window("arrived", "1 day").alias("day"), F.get(part, 0).alias("group_id"), F.get(part, 1).alias("sample_id"), F.get(part, 2).alias("stain_id"), F.get(part, 3).alias("kind"), F.regexp_extract(name, r"_v([0-9]+)$", 1).alias("v"))
    return keyed.groupBy("day", "group_id", "sample_id", "stain_id", "kind").agg(F.max(F.expr("try_cast(v as int)")).alias("version"))
