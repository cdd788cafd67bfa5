"""Threshold-scaled sketches (every shingle hash below a fixed fraction of the hash space), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import local_table, whole_text

WORDS, ONE_IN, CHUNK_ROWS = 5, 4, 512


def with_sketch(df: DataFrame, text: Column, name: str, words: int = WORDS, one_in: int = ONE_IN) -> DataFrame:
    """``df`` with column ``name``: sorted distinct hashes of ``words``-word shingles below 1/one_in of the hash space.

    Words are runs without white space. A text of fewer words has one shingle, of all its words; one without a word
    has none. The sketch follows the threshold alone, so a short text's can be empty; column ``name``_lone then holds its
    smallest hash (else null), apart from the sketch: it tells such texts apart but is never merged or counted.
    """
    hashes = F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.size("__w") - words, F.lit(0))), lambda i: F.xxhash64(*[F.coalesce(F.get("__w", i + j), F.lit(0).cast("long")) for j in range(words)]))
    limit = -(2**63) + 2**64 // one_in
    df = df.withColumn("__w", hashes).withColumn("__s", F.when(F.size("__w") > 0, every).otherwise(F.array().cast("array<long>")))
    kept = F.filter("__s", lambda h: h < limit)
    df = df.withColumn(name, F.array_sort(F.array_distinct(kept)))
    return df.withColumn(f"{name}_lone", F.when(F.size(name) == 0, F.array_min("__s"))).drop("__w", "__s")


def resemblance(a: Column, b: Column, a_lone: Column | None = None, b_lone: Column | None = None) -> Column:
    """Estimated Jaccard likeness of the shingle sets; an empty and a full sketch are unlike (0).

    Two empty ones are no evidence beyond their lone hashes: 1 where those are equal or not given, else 0.
    """
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    empty = F.lit(1.0) if a_lone is None else a_lone.eqNullSafe(b_lone).cast("double")
    return F.when(either == 0, empty).otherwise(both / either).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds too: for documents of very unequal length. Empty a: 1."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together: at one threshold, sketches unite as sets."""
    return F.array_sort(F.array_union(a, b))


def as_string(s: Column, lone: Column) -> Column:
    """The sketch's hashes in hexadecimal; of an empty sketch, its lone hash after a tilde."""
    text = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.when(lone.isNotNull(), F.concat(F.lit("~"), text(lone))).otherwise(F.array_join(F.transform(s, text), ""))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, one_in: int = ONE_IN) -> DataFrame:
    """Per document: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_next.

    The edited text has its last floor(n_chars/2) code points replaced by the first as many of the next document's
    (by identifier, then text; after the last comes the first; a null identifier comes first). Null texts are empty.
    A table of one row is its own next document. Rows repeated with the same identifier follow one another.
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("body"))
    n = base.count()
    parts = max(1, min(20_000, n // CHUNK_ROWS))
    cuts = []
    if parts > 1:
        found = base.filter("id is not null").select(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10_000)).first()[0]
        cuts = sorted(set(found or []))
    key = F.coalesce(F.col("id"), F.lit(-(2**63)))
    top = 2**63 - 1
    steps = [1 << i for i in reversed(range(max(1, len(cuts)).bit_length()))]
    bounds = F.lit([int(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # binary search: how many boundaries lie at or below the key
    chunk = F.aggregate(F.lit(steps), F.lit(0), lambda acc, step: F.when((acc + step <= len(cuts)) & (F.get(bounds, acc + step - 1) <= F.col("key")), acc + step).otherwise(acc))
    chunked = base.withColumn("key", key).withColumn("chunk", chunk)
    least = chunked.groupBy("chunk").agg(F.min("key").alias("key"))
    heads = sorted(r.chunk for r in least.select("chunk").collect())  # one number for each chunk
    firsts = chunked.join(F.broadcast(least), ["chunk", "key"]).groupBy("chunk", "key").agg(F.min("body").alias("body"))
    before = F.broadcast(local_table(spark, [(c, heads[i - 1]) for i, c in enumerate(heads)], "chunk int, to int"))
    last = heads[-1] if heads else 0
    guests = firsts.join(before, "chunk").select(F.lit(None).cast("long").alias("id"), "body", F.when(F.lit(len(heads) > 0) & (F.col("to") == last), F.lit(top)).otherwise(F.col("key")).alias("key"), F.col("to").alias("chunk"), F.lit(True).alias("guest"))
    both = chunked.withColumn("guest", F.lit(False)).unionByName(guests).repartition("chunk")
    own = with_sketch(both, F.col("body"), "s", words, one_in)
    order = Window.partitionBy("chunk").orderBy("guest", "key", "body")
    ahead = own.withColumn("next", F.lead(F.struct("body", "s", "s_lone")).over(order)).filter(~F.col("guest"))
    edited = F.concat(F.expr("substring(body, 1, cast(char_length(body) - floor(char_length(body) / 2) as int))"), F.expr("substring(next.body, 1, cast(floor(char_length(body) / 2) as int))"))
    done = with_sketch(ahead.withColumn("edited", edited), F.col("edited"), "es", words, one_in)
    return done.select(
        F.col("id").alias(id_col), F.char_length("body").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("s"), F.col("s_lone")).alias("fingerprint"), as_string(F.col("es"), F.col("es_lone")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("es"), F.col("s_lone"), F.col("es_lone")).alias("near_edited"),
        resemblance(F.col("s"), F.col("next.s"), F.col("s_lone"), F.col("next.s_lone")).alias("near_next"),
        containment(F.col("s"), F.col("next.s")).alias("contained_next"),
    )


def op9_scaled_sketch(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
