"""The file catalogue: names, versions, outputs and open work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parsed(paths: DataFrame) -> DataFrame:
    """(path, group_id, sample_id, stain_id, kind, version) from ``{group}_{sample}_{stain}_{extra}_v<digits>.ext``."""
    name = F.regexp_replace("path", r"\.[A-Za-z]+$", "")
    part = F.split(name, "_")
    version = F.regexp_extract(name, r"_v([0-9]+)$", 1)
    return paths.select("path", F.get(part, 0).alias("group_id"), F.get(part, 1).alias("sample_id"), F.get(part, 2).alias("stain_id"), F.get(part, 3).alias("kind"), F.when(version == "", 0).otherwise(F.expr("try_cast(regexp_extract(regexp_replace(path, '\\\\.[A-Za-z]+$', ''), '_v([0-9]+)$', 1) as int)")).alias("version"))


def latest(catalogue: DataFrame) -> DataFrame:
    """The newest version of every group, sample, stain and kind; of equals the least path."""
    w = Window.partitionBy("group_id", "sample_id", "stain_id", "kind").orderBy(F.desc("version"), "path")
    return catalogue.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def paired(newest: DataFrame, image: str, mask: str) -> DataFrame:
    """Each image with its mask's path (null where there is none yet)."""
    keys = ["group_id", "sample_id", "stain_id"]
    masks = newest.filter(F.col("kind") == mask).select(*keys, F.col("path").alias("mask_path"))
    return newest.filter(F.col("kind") == image).select(*keys, F.col("path").alias("image_path")).join(masks, keys, "left")


def open_work(pairs: DataFrame) -> DataFrame:
    """Images without a mask: the work that is still to do."""
    return pairs.filter(F.col("mask_path").isNull())


# the catalogue's rules: paths are plain columns, so a listing of any size is joined, not looped over


def base_name(path: Column) -> Column:
    """The file name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def listed(spark: SparkSession, folder: str, pattern: str = "*.{tif,tiff}") -> DataFrame:
    """(path, bytes, changed) of a folder's files, by extension; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def terms(paths: DataFrame) -> DataFrame:
    """``paths`` with what names a sample: terms, the first three parts of the name, the third up to its first dot."""
    part = F.split(F.regexp_extract("path", r"([^/]*)$", 1), "_")
    three = F.array(F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.split_part(F.get(part, F.lit(2)), F.lit("."), F.lit(1)))
    return paths.withColumn("terms", F.filter(three, lambda t: t.isNotNull() & (t != "")))


def containing(images: DataFrame, outputs: DataFrame, version: str | None = None) -> DataFrame:
    """(path, output): outputs whose name holds all of an image's terms (and the version without underscores), in any case.

    An image's longest term is looked up among the substrings of the output names that have the length of some term,
    so images and outputs meet by an equal key and never all with all.
    """
    asked = terms(images).withColumn("terms", F.transform("terms", lambda t: F.lower(t)))
    if version is not None:
        asked = asked.withColumn("terms", F.array_append("terms", F.lit(version.replace("_", "").lower())))
    asked = asked.withColumn("key", F.reduce("terms", F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))).select("path", "terms", "key")
    lengths = asked.agg(F.collect_set(F.length("key")).alias("lengths"))  # one row of a few numbers
    name = F.lower(F.regexp_extract("output", r"([^/]*)$", 1))
    named = outputs.select(F.col("path").alias("output")).withColumn("name", name).crossJoin(F.broadcast(lengths))
    parts = F.flatten(F.transform("lengths", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("name") - n + 1)), lambda i: F.substr("name", i, n))))
    held = named.withColumn("key", F.explode(F.array_distinct(parts))).select("output", "name", "key")
    return asked.join(held, "key").filter(F.forall("terms", lambda t: F.contains(F.col("name"), t))).select("path", "output").distinct()


def work_status(images: DataFrame, adjusted: DataFrame, masks: DataFrame, version: str | None = None) -> DataFrame:
    """(path, need_rgb, need_mask): which of its two outputs each image still lacks."""
    have = lambda outputs, n: containing(images, outputs, version).select("path").distinct().withColumn(n, F.lit(False))
    return images.select("path").join(have(adjusted, "need_rgb"), "path", "left").join(have(masks, "need_mask"), "path", "left").fillna(True, ["need_rgb", "need_mask"])


def checked_names(paths: DataFrame, strict: bool = False) -> DataFrame:
    """``paths`` with name and sound: names of four underscores pass, of five lose the third, others are not sound (strict: an error)."""
    name = base_name(F.col("path"))
    n = F.length(name) - F.length(F.replace(name, F.lit("_"), F.lit("")))
    fixed = F.when(n == 5, F.regexp_replace(name, r"^([^_]*_[^_]*_[^_]*)_", "$1")).otherwise(name)
    sound = n.isin(4, 5)
    if strict:
        fixed = F.when(sound, fixed).otherwise(F.raise_error(F.concat(F.lit("a name needs four underscores: "), F.col("path"))))
    return paths.withColumns({"name": fixed, "sound": sound})


def prefix(name: Column) -> Column:
    """The first three parts of a name, joined by underscores."""
    return F.regexp_extract(name, r"^([^_]*_[^_]*_[^_.]*)", 1)


def newest_by_prefix(paths: DataFrame) -> DataFrame:
    """(prefix, path, version): of each prefix the file of the highest ``_v<digits>``; of equals the least path."""
    name = base_name(F.col("path"))
    version = F.expr("coalesce(try_cast(regexp_extract(path, '_v([0-9]+)', 1) as int), 0)")
    best = F.min(F.struct((-version).alias("v"), F.col("path").alias("path")))
    return paths.groupBy(prefix(name).alias("prefix")).agg(best.alias("b")).select("prefix", "b.path", (-F.col("b.v")).alias("version"))


def best_masks(images: DataFrame, masks: DataFrame, scores: DataFrame) -> DataFrame:
    """(image_path, mask_path): per image the mask of its prefix with the highest version; of equals the best Dice, then the least path.

    ``scores`` (image_path, mask_path, dice) needs rows only for tied masks; a missing score counts as 0. Images
    without a mask keep a null.
    """
    key = lambda df, c: df.select(F.col("path").alias(c), prefix(base_name(F.col("path"))).alias("prefix"), F.expr("coalesce(try_cast(regexp_extract(path, '_v([0-9]+)', 1) as int), 0)").alias("version"))
    pairs = key(images, "image_path").drop("version").join(key(masks, "mask_path"), "prefix", "left")
    scored = pairs.join(scores, ["image_path", "mask_path"], "left")
    best = F.min(F.struct((-F.col("version")).alias("v"), (-F.coalesce("dice", F.lit(0.0))).alias("d"), "mask_path"))
    return scored.groupBy("image_path").agg(best.alias("b")).select("image_path", F.col("b.mask_path").alias("mask_path"))


def only_match(paths: DataFrame, sample: str, stain: str) -> DataFrame:
    """The one path whose name up to its first dot holds sample and stain, in any case; none or several are an error when read."""
    name = F.lower(F.split_part(F.regexp_extract("path", r"([^/]*)$", 1), F.lit("."), F.lit(1)))
    hit = paths.filter(F.contains(name, F.lit(sample.lower())) & F.contains(name, F.lit(stain.lower())))
    one = hit.agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    return one.select(F.when(F.col("n") == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("files that match: "), F.col("n").cast("string")))).alias("path"))


def by_base_name(paths: DataFrame, base: str) -> DataFrame:
    """The first path (by order) whose file is ``base`` with one extension; none is an error when read."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = paths.filter(F.startswith(name, F.lit(base + ".")) & F.substr(name, F.lit(len(base) + 2)).rlike(r"^\w+$")).agg(F.min("path").alias("path"))
    return found.select(F.coalesce("path", F.raise_error(F.lit(f"no file is named {base}"))).alias("path"))


def four_files(paths: DataFrame, sample: str, fixed: str, moving: str) -> DataFrame:
    """(fixed_mask, fixed_im, moving_mask, moving_im): of the paths that hold ``_sample_``, masks (png) and images (tiff) by stain."""
    of = paths.filter(F.contains("path", F.lit(f"_{sample}_")))
    one = lambda kind, stain: F.min(F.when(F.contains("path", F.lit(kind)) & F.contains("path", F.lit(stain)), F.col("path")))
    return of.agg(one("png", fixed).alias("fixed_mask"), one("tiff", fixed).alias("fixed_im"), one("png", moving).alias("moving_mask"), one("tiff", moving).alias("moving_im"))


def normal_folder(path: Column) -> Column:
    """A folder's path with one slash at its end and none doubled."""
    return F.regexp_replace(F.concat(path, F.lit("/")), "/+", "/")


def save_folder(raw: Column, save: Column) -> Column:
    """Where results go: the save folder, or ``savedOutput`` inside the raw one where both are the same."""
    return F.when(normal_folder(raw) == normal_folder(save), normal_folder(F.concat(raw, F.lit("/savedOutput")))).otherwise(normal_folder(save))


def sink_name(base: str, scale: float, kind: str, version: str = "", extension: str = ".tiff") -> str:
    """The name of a stored result: of kind ``ForegroundSegmented`` or ``adjustedRGBImage``, at a scale (1 / factor)."""
    return f"{base}scale_{scale:.4g}_{kind}{version}{extension}"
