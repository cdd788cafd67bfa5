"""Exact deduplication by a log-structured merge index of text digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLOTS, free_name, hot_join, materialize, whole_text

BITS_PER_KEY, PROBES, RUN_ROWS, BUCKET_ROWS = 10, 7, 1 << 16, 1 << 14
SCHEMA = "run long, bucket int, digest binary, ident long, n long, bits binary"


def _lanes(digests: np.ndarray) -> np.ndarray:
    return digests.view(">u8").reshape(len(digests), -1).astype(np.uint64)


def _places(lanes: np.ndarray, size: int) -> np.ndarray:
    a, b = lanes[:, 0], lanes[:, -1] | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)


def bloom(lanes: np.ndarray) -> np.ndarray:
    """A Bloom filter over digests: BITS_PER_KEY bits a key, PROBES probes."""
    size = max(64, -(-len(lanes) * BITS_PER_KEY // 8) * 8)
    flags = np.zeros(size, np.uint8)
    flags[_places(lanes, size).ravel()] = 1
    return np.packbits(flags)


def maybe(bits: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Which digests the filter may hold; a False is certain."""
    places = _places(lanes, len(bits) * 8)
    return (bits[places >> np.uint64(3)] >> (np.uint64(7) - (places & np.uint64(7))).astype(np.uint8) & 1).all(axis=1)


def _fixed(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _merge(lanes: np.ndarray, ident: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by digest and fold equal ones: smallest identifier, summed count. Returns rows picked, identifiers, counts."""
    order = np.lexsort([ident, *lanes.T[::-1]])
    s = lanes[order]
    new = np.r_[True, (s[1:] != s[:-1]).any(axis=1)] if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return order[at], ident[order][at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _flusher(buckets: int, width: int, run_rows: int):
    """Fills a memtable with (digest, smallest identifier, count) and flushes it as a sorted run with its filters."""

    def flush(held: list, run: int):
        digests = np.concatenate([h[0] for h in held])
        ident = np.concatenate([h[1] for h in held])
        pick, ident, n = _merge(_lanes(digests), ident, np.ones(len(digests), np.int64))
        digests, lanes = digests[pick], _lanes(digests[pick])
        bucket = (lanes[:, 0] >> np.uint64(64 - 16)).astype(np.int64) * buckets >> 16
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        spans = list(zip(edges, np.r_[edges[1:], len(bucket)], strict=True))
        filters = [bloom(lanes[a:b]).tobytes() for a, b in spans]
        k, f = len(digests), len(spans)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(k + f, run, np.int64)),
                pa.array(np.r_[bucket, bucket[edges]].astype(np.int32)),
                pa.array([*(d.tobytes() for d in digests), *[None] * f], pa.binary()),
                pa.array(np.r_[ident, np.zeros(f, np.int64)]),
                pa.array(np.r_[n, np.zeros(f, np.int64)]),
                pa.array([*[None] * k, *filters], pa.binary()),
            ],
            names=["run", "bucket", "digest", "ident", "n", "bits"],
        )

    def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, rows, run = [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((_fixed(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)))
            rows += batch.num_rows
            if rows >= run_rows:
                yield from flush(held, run)
                held, rows, run = [], 0, run + 1
        if held:
            yield from flush(held, run)

    return memtables


def _compactor(width: int):
    """Merges the runs of each bucket. A row that no other run's filter may hold passes without a merge."""

    def finish(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        run = table["run"].to_numpy()
        is_filter = np.asarray(table["bits"].combine_chunks().is_valid())
        keys = table.filter(pa.array(~is_filter))
        filters = {}
        for r, bits in zip(run[is_filter], table["bits"].to_pylist() and table.filter(pa.array(is_filter))["bits"].to_pylist(), strict=True):
            filters[r] = np.frombuffer(bits, np.uint8)
        digests, run = _fixed(keys["digest"], width), run[~is_filter]
        ident, n, lanes = keys["ident"].to_numpy(), keys["n"].to_numpy(), _lanes(digests)
        hit = np.zeros(len(run), bool)
        for r, bits in filters.items():
            other = (run != r) & ~hit
            hit[other] = maybe(bits, lanes[other])
        alone, both = np.flatnonzero(~hit), np.flatnonzero(hit)
        pick, least, total = _merge(lanes[both], ident[both], n[both])
        chosen = np.r_[alone, both[pick]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([digests[i].tobytes() for i in chosen], pa.binary()), pa.array(np.r_[ident[alone], least]), pa.array(np.r_[n[alone], total])],
            names=["digest", "ident", "n"],
        )

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            bucket = batch.column(1).to_numpy()
            cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)] if len(bucket) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if now is not None and bucket[a] != now:
                    yield from finish(held)
                    held = []
                now = bucket[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from finish(held)

    return compact


def build_index(keyed: DataFrame, rows: int, width: int = 32, run_rows: int = RUN_ROWS) -> DataFrame:
    """``keyed`` has (digest binary, ident long). Returns the compacted level: digest, smallest ident, n."""
    buckets = 256
    while buckets < 65536 and buckets * BUCKET_ROWS < rows:
        buckets *= 2
    runs = materialize(keyed.select("digest", "ident").mapInArrow(_flusher(buckets, width, run_rows), SCHEMA), "runs")
    ordered = runs.repartition("bucket").sortWithinPartitions("bucket", "run", "digest")
    return materialize(ordered.mapInArrow(_compactor(width), "digest binary, ident long, n long"), "level")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", copies_a_salt: int = 32, digest_bytes: int = 32, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. ``keep``: ``max`` or ``min`` identifier stays
    (the index always keeps the smallest key; for ``max`` the key is the negated identifier). Every document that hits
    an entry of two or more rows is compared byte for byte with the text of the document that stays; those that
    differ (digest collisions) are grouped anew by their full text. Rows repeated with the same identifier all carry
    the same answer and count in group_size; ``kept`` is then true for each. A null identifier counts as lower than
    any other for ``max`` and higher for ``min``, so it stays only where all of a group's identifiers are null.
    Other columns are ignored; an empty table gives an empty result.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep must be max or min")
    none = 2**63 - 1
    ident = F.col(id_col).cast("long")
    key = F.coalesce(-ident if keep == "max" else ident, F.lit(none))
    back = F.when(F.col("ident") == none, F.lit(None).cast("long")).otherwise(-F.col("ident") if keep == "max" else F.col("ident"))
    text = whole_text(text_col)
    sha = F.sha2(text.cast("binary"), 256)
    base = docs.select(ident.alias("own"), key.alias("own_key"), sha.alias("sha"), text.alias("body")).withColumn("digest", F.substring(F.unhex("sha"), 1, digest_bytes))
    rows = docs.count()
    level = build_index(base.select("digest", F.col("own_key").alias("ident")), rows, digest_bytes, run_rows)
    many = level.filter("n > 1")
    light = base.select("own", "own_key", "sha", "digest")
    singles_and_hits = hot_join(light, many, "digest", "n", rows, "left")
    looked = materialize(singles_and_hits, "hits")
    alone = looked.filter("n is null").select(F.col("own").alias(id_col), F.col("own").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    # Byte verification: copies are spread over ceil(n / copies_a_salt) salts, and the kept text goes once to each.
    salts = F.ceil(F.col("n") / copies_a_salt).cast("int")
    # Before any text moves, a filter of at most SLOTS slots (32 MB) drops documents whose slot no shared digest uses.
    slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS))
    maybe_hit = base.join(F.broadcast(many.select(slot.alias("slot")).distinct()), slot == F.col("slot"), "left_semi")
    hits = materialize(hot_join(maybe_hit, many, "digest", "n", rows), "texts")
    copies = hits.withColumn("salt", F.pmod(F.xxhash64("own_key", "digest"), salts).cast("int")).withColumn("salt", F.when(F.col("n") <= copies_a_salt, 0).otherwise(F.col("salt")))
    kept = hits.filter(F.col("own_key") == F.col("ident")).dropDuplicates(["digest"]).select("digest", F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    checked = materialize(copies.join(kept.hint("merge"), ["digest", "salt"]).select("own", "own_key", "sha", "digest", "ident", F.col("body").eqNullSafe(F.col("kept_body")).alias("same"), F.when(F.col("body") != F.col("kept_body"), F.col("body")).alias("body")), "checked")
    same, other = checked.filter("same"), checked.filter("not same")
    sizes = materialize(same.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")), "sizes")
    right = hot_join(same.select("digest", "own", "own_key", "sha", "ident"), sizes.withColumn("n", F.col("group_size")), "digest", "n", rows)
    right = right.select(F.col("own").alias(id_col), back.alias("keep_id"), "group_size", (F.col("own_key") == F.col("ident")).alias("kept"), F.col("sha").alias("text_sha256"))
    again = other.groupBy("digest", "body").agg(F.min("own_key").alias("ident"), F.count(F.lit(1)).alias("group_size"))
    wrong = other.select("digest", "body", "own", "own_key", "sha").join(again, ["digest", "body"])
    wrong = wrong.select(F.col("own").alias(id_col), back.alias("keep_id"), "group_size", (F.col("own_key") == F.col("ident")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(right).unionByName(wrong)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` with one row of each text, the one that ``exact_dedup`` keeps; rows repeated with its identifier go too."""
    found = materialize(exact_dedup(docs, id_col, text_col, keep), "dedup").filter("group_size > 1")
    names = docs.columns
    sha, stays, copies, mark = (free_name(docs, n) for n in ("__sha", "__keep", "__n", "__slot"))
    docs = docs.withColumn(sha, F.sha2(whole_text(text_col).cast("binary"), 256))
    stay = found.filter("kept").groupBy(F.col("text_sha256").alias(sha)).agg(F.first("keep_id").alias(stays), F.first("group_size").alias(copies))
    stay = materialize(stay, "stay")
    slot = F.pmod(F.xxhash64(sha), F.lit(SLOTS))
    used = F.broadcast(stay.select(slot.alias(mark)).distinct())
    docs = docs.withColumn(mark, slot)
    alone = docs.join(used, mark, "left_anti")
    some = hot_join(docs.join(used, mark, "left_semi"), stay, sha, copies, docs.count(), "left")
    single = some.filter(F.col(copies).isNull())
    chosen = some.filter(F.col(copies).isNotNull() & F.col(id_col).cast("long").eqNullSafe(F.col(stays))).dropDuplicates([sha])
    return alone.select(names).unionByName(single.select(names)).unionByName(chosen.select(names))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
