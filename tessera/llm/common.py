"""Helpers shared by the corpus operators: the shared folder, written tables and skew-proof joins."""

from __future__ import annotations

import gc
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it owns at least one HOT_SHARE-th of the rows; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master; elsewhere an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors take nothing along."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``materialize``, in buckets by ``key``: joins on it move only the other side. The table is in the session's catalogue."""
    spark = df.sparkSession
    made = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{made}"
    df.write.format("parquet").bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(f"tessera_{made}")
    return spark.table(f"tessera_{made}")


def forget(*written: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in written:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when the driver collects its garbage, by itself every half hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def purge(spark: SparkSession) -> None:
    """Delete what ``materialize`` and ``bucketed`` wrote for this application, once its results have been read or stored."""
    for t in spark.catalog.listTables():
        if t.name.startswith("tessera_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    _delete(spark, f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole texts can hold."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def doc_key(id_col: str = "doc_id"):
    """The remainder key of the contracts: crc32 of the decimal identifier (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_text(text_col: str = "text"):
    return F.coalesce(F.col(text_col), F.lit(""))


def hot_join(big: DataFrame, small: DataFrame, key: str, size_col: str, rows: int, how: str = "inner") -> DataFrame:
    """Join ``big`` to ``small`` (one row a key, ``size_col`` = rows of the key in ``big``) without a skewed task.

    Keys holding at least ``rows / HOT_SHARE`` rows number at most HOT_SHARE, so that part is broadcast whatever the
    size of the data; all other keys are small enough for one shuffled join. ``small`` must be a written table.
    """
    limit = max(64, rows // HOT_SHARE)
    mark = free_name(big, "__hot")
    hot = small.filter(F.col(size_col) >= limit)
    cold = small.filter(F.col(size_col) < limit)
    marks = big.join(F.broadcast(hot.select(key, F.lit(True).alias(mark))), key, "left")
    first = big.join(F.broadcast(hot), key, "inner")
    rest = marks.filter(F.col(mark).isNull()).drop(mark).join(cold.hint("merge"), key, how)
    return first.unionByName(rest)


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small driver-side list as a DataFrame, by a JSON literal: no Python runs on executors."""
    names = [x.split()[0] for x in ddl.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f'{a}: {b}' for a, b in (x.split() for x in ddl.split(', ')))}>>")))


SLOTS = 1 << 22


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows (all, if there are fewer): those whose hash of ``key`` lies below a threshold set by the count.

    Unlike an ordered limit, no partition sends more than its share, however many partitions there are.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(41)), F.lit(1 << 40)) < (1 << 40) * rows // total)


def without(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` without the rows whose ``keys`` equal a row of ``dropped`` (null equals null).

    Rows whose slot (a hash of the keys, one of SLOTS) no dropped row uses pass without a shuffle; the broadcast set of slots is at
    most SLOTS numbers. Only the others are joined, so most texts do not move.
    """
    slot, mark = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)), free_name(docs, "__slot")
    used = F.broadcast(dropped.select(slot.alias(mark)).distinct())
    names = docs.columns
    docs = docs.withColumn(mark, slot)
    clean = docs.join(used, mark, "left_anti")
    some = docs.join(used, mark, "left_semi").alias("a")
    gone = dropped.select(keys).distinct().alias("b").hint("merge")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return clean.select(names).unionByName(some.join(gone, same, "left_anti").select(names))
