"""n-gram Jaccard join: MinHash bands find candidate groups, full n-gram sets verify every pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .common import free_name, hot_join, materialize, small_batches, whole_text, without
from .components import components

SHINGLE, THRESHOLD, RECALL, ROWS, BLOCK, BLOCK_SHINGLES, SEED = 5, 0.8, 0.9999, 4, 320, 1 << 19, 17


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows so that a pair at the threshold shares a band with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _multipliers(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED).integers(1, 2**63, (2, bands * rows), np.uint64)
    return r[0] * np.uint64(2) + np.uint64(1), r[1]


def signatures(column: pa.Array, bands: int, rows: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: band hashes, the digest (2 x 64 bits) of its shingle set, and its number of distinct shingles."""
    a, b = _multipliers(bands, rows)
    all_bands, digest, many = [], [], []
    for _, _, data, offsets in bytescan.blocks(column, 1 << 20):
        starts, ends, at = bytescan.word_spans(data, offsets)
        h, at = bytescan.shingles(bytescan.word_hashes(data, starts, ends), at, size)
        n = len(at) - 1
        full = np.flatnonzero(np.diff(at))
        out = np.zeros((n, bands * rows), np.uint64)
        if len(full):
            for k in range(bands * rows):
                out[full, k] = np.minimum.reduceat((h ^ b[k]) * a[k], at[full])
        band = np.zeros((n, bands), np.uint64)
        for k in range(bands):
            v = np.full(n, k + 1, np.uint64)
            for r in range(rows):
                v = bytescan.mix(v ^ out[:, k * rows + r])
            band[:, k] = v
        sets, set_at = _sets(h, at)
        d = np.zeros((n, 2), np.uint64)
        some = np.flatnonzero(np.diff(set_at))
        if len(some):
            d[some, 0] = np.add.reduceat(bytescan.mix(sets), set_at[some])
            d[some, 1] = np.bitwise_xor.reduceat(bytescan.mix(sets + np.uint64(SEED)), set_at[some])
        all_bands.append(band)
        digest.append(d)
        many.append(np.diff(set_at))
    if not digest:
        return np.zeros((0, bands), np.uint64), np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
    return np.concatenate(all_bands), np.concatenate(digest), np.concatenate(many)


def _sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and offsets."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort([h, owner])
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], np.r_[0, np.cumsum(np.bincount(owner[new], minlength=len(at) - 1))]


def text_sets(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The full n-gram sets of texts."""
    sets, offsets = [], [np.zeros(1, np.int64)]
    for _, _, data, ends in bytescan.blocks(pa.array(texts, pa.string()), 1 << 20):
        starts, stops, at = bytescan.word_spans(data, ends)
        s, o = _sets(*bytescan.shingles(bytescan.word_hashes(data, starts, stops), at, size))
        sets.append(s)
        offsets.append(o[1:] + offsets[-1][-1])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(offsets)


def common_counts(sets: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j); many pairs of few texts go through one matrix product."""
    n = len(at) - 1
    out = np.zeros(len(i), np.int64)
    if len(i) > 4 * n:
        ids, place, often = np.unique(sets, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), np.diff(at))
        shared = often[place] > 1  # what one set alone holds is in no intersection
        number = np.cumsum(often > 1) - 1
        place, owner, ids = number[place[shared]], owner[shared], ids[often > 1]
        total = np.zeros((n, n), np.float32)
        for first in range(0, len(ids), 4096):
            part = (place >= first) & (place < first + 4096)
            x = np.zeros((n, min(4096, len(ids) - first)), np.float32)
            x[owner[part], place[part] - first] = 1
            total += x @ x.T
        return total[i, j].astype(np.int64)
    for k, (a, b) in enumerate(zip(i, j, strict=True)):
        x, y = sets[at[a] : at[a + 1]], sets[at[b] : at[b + 1]]
        if len(x) > len(y):
            x, y = y, x
        where = np.minimum(np.searchsorted(y, x), len(y) - 1)
        out[k] = np.count_nonzero(y[where] == x) if len(y) else 0
    return out


VERIFIED = "a long, b long, links long"


def _verifier(threshold: float, size: int):
    """Checks the candidate pairs of each (bucket, block pair). A pair counts in the first band it shares only."""

    def group(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        # each text once; a pair of different blocks is checked across, one of the same block within
        rep, block = rows["rep"].to_numpy(), rows["block"].to_numpy()
        n = len(rep)
        flat = rows["bands"].combine_chunks()
        bands = flat.flatten().to_numpy().reshape(n, -1)
        band, bi, bj = rows["band"][0].as_py(), rows["bi"][0].as_py(), rows["bj"][0].as_py()
        i, j = np.triu_indices(n, 1)
        if bi != bj:
            cross = block[i] != block[j]
            i, j = i[cross], j[cross]
        for k in range(band):  # pairs that met in an earlier band are gone after a look or two
            fresh = bands[i, k] != bands[j, k]
            i, j = i[fresh], j[fresh]
        count = rows["shingles"].to_numpy()
        low, high = np.minimum(count[i], count[j]), np.maximum(count[i], count[j])
        fresh = low >= threshold * high  # two sets of such sizes cannot be alike enough otherwise
        i, j = i[fresh], j[fresh]
        if not len(i):
            return
        used = np.unique(np.r_[i, j])
        short = np.full(n, -1)
        short[used] = np.arange(len(used))
        texts = rows["text"].take(pa.array(used)).to_pylist()
        sets, at = text_sets(texts, size)
        sizes = np.diff(at)
        both = common_counts(sets, at, short[i], short[j])
        alike = both >= threshold * (sizes[short[i]] + sizes[short[j]] - both) - 1e-9
        i, j = i[alike], j[alike]
        if not len(i):
            return
        links = np.bincount(np.r_[i, j], minlength=n)
        # a spanning forest stands for the links of the group: each text's first links, then those between what is still apart
        root = np.arange(n)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges, has = [], np.flatnonzero(links)
        while len(i):
            some = np.union1d(np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1])
            for x, y in zip(i[some].tolist(), j[some].tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    root[p] = q
                    edges.append((rep[x], rep[y]))
            top = np.array([find(x) for x in range(n)])
            apart = top[i] != top[j]
            i, j = i[apart], j[apart]
        e = np.array(edges, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[rep[has], e[:, 0]]), pa.array([*[None] * len(has), *e[:, 1].tolist()], pa.int64()), pa.array(np.r_[links[has], np.zeros(len(e), np.int64)])],
            names=["a", "b", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)] if len(keys) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[x])
                if now is not None and key != now:
                    yield from group(pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(x, y - x))
        if held:
            yield from group(pa.Table.from_batches(held))

    return run


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per document: id_col, class_id, set_id, n_copies, n_links, n_shingles, text_hash, kept.

    Texts are compared by their sets of ``size``-word shingles (words: runs without white space, A-Z folded; a text
    with fewer words has one shingle of all its words). set_id is the smallest identifier with the same shingle set,
    n_copies the rows with that set; n_links counts the other sets of Jaccard likeness at least ``threshold``;
    class_id is the smallest identifier connected by such links, kept whether the row is its class's first by
    identifier and text hash (rows repeated with both are all marked). Texts without a word (null, empty) are alike among
    themselves only. Bands and rows are chosen so that a pair at the threshold is a candidate with probability
    ``recall``; candidates are verified on full sets, so there are no false links.

    Buckets are cut into blocks of about ``block`` texts (fewer where they have more than BLOCK_SHINGLES shingles) and
    verified block against block, so a bucket of any size is spread over tasks, and no pair is ever a row: a task sends on each text's number of links and a spanning forest.
    A bucket with the same members as one of an earlier band is skipped. A null identifier counts as the least long; repeated rows each get a
    row; extra columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    bands = choose_bands(threshold, recall, rows)
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, digest, many = signatures(batch.column(1), bands, rows, size)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(many) * bands + 1, bands, dtype=np.int32)), pa.array(band.view(np.int64).ravel()))
            key = pa.array([d.tobytes() for d in np.ascontiguousarray(digest)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), key, pa.array(many.astype(np.int64)), flat], names=["id", "text_hash", "digest", "shingles", "bands"])

    texts = docs.select(ident.alias("id"), whole_text(text_col).alias("text"))
    signed = materialize(texts.select("id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sign, "id long, text_hash long, digest binary, shingles long, bands array<long>"), "signed")
    total = signed.count()
    # a set's number, not its smallest identifier, names it: identifiers can be null or stand on different texts
    sets = signed.groupBy("digest").agg(F.min(F.struct("id", "text_hash")).alias("least"), F.count(F.lit(1)).alias("n"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"))
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("rep"), "digest", F.col("least.id").alias("least_id"), F.col("least.text_hash").alias("least_hash"), "n", "shingles", "bands"), "sets")
    spread = sets.filter("shingles > 0").select("rep", "shingles", F.posexplode("bands").alias("band", "hash"))
    keyed = spread.withColumn("key", F.xxhash64("band", "hash"))
    member = F.xxhash64("rep")
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("size"), F.min("band").alias("band"), F.bit_xor(member).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).filter("n > 1")
    buckets = materialize(buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("one"), F.max("size").alias("size")).select("one.key", "one.band", "n", "size"), "buckets")
    members = hot_join(keyed.select("key", "rep"), buckets, "key", "n", total)
    blocks = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") / BLOCK_SHINGLES))).cast("int")
    members = members.select("key", "band", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("rep", F.lit(2)), blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = members.withColumn("other", other).select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "band", "block", "rep")
    # the texts of members only: whoever is the representative of a set in some bucket
    needed = materialize(members.select("rep").distinct(), "needed")
    bodies = materialize(needed.join(sets.select("rep", "least_id", "least_hash", "shingles", "bands"), "rep"), "bodies")
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << 22))
    maybe = texts.join(F.broadcast(bodies.select(F.pmod(F.xxhash64("least_id"), F.lit(1 << 22)).alias("slot")).distinct()), slot == F.col("slot"), "left_semi")
    found_texts = maybe.select(F.col("id").alias("least_id"), F.xxhash64("text").alias("least_hash"), "text")
    bodies = bodies.join(found_texts.hint("merge"), ["least_id", "least_hash"]).dropDuplicates(["rep"])
    bodies = materialize(bodies.select("rep", "shingles", "bands", "text"), "bodies")
    full = placed.join(bodies.hint("merge"), "rep").select("key", "bi", "bj", "band", "block", "rep", "shingles", "bands", "text")
    ordered = full.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    found = materialize(ordered.mapInArrow(_verifier(threshold, size), VERIFIED), "verified")
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("n_links")).withColumnRenamed("a", "rep")
    labels = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    linked = materialize(labels.join(sets.select("rep", F.struct("least_id", "least_hash").alias("least")), "rep"), "linked")
    least_ids = materialize(linked.groupBy("label").agg(F.min("least").alias("class"), F.count(F.lit(1)).alias("members")), "least")
    named = hot_join(linked.select("rep", "label"), least_ids, "label", "members", total).select("rep", "class")
    own = sets.select("rep", "least_id", F.struct("least_id", "least_hash").alias("least"), "digest", "n", "shingles")
    classes = own.join(links, "rep", "left").join(named, "rep", "left").withColumn("class", F.coalesce("class", "least")).drop("least")
    classes = materialize(classes, "classes")
    least = -(2**63)
    back = lambda c: F.when(F.col(c) != least, F.col(c))
    done = hot_join(signed.select("id", "text_hash", "digest"), classes, "digest", "n", total)
    kept = (F.col("id") == F.col("class.least_id")) & (F.col("text_hash") == F.col("class.least_hash"))
    return done.withColumn("kept", kept).withColumn("class", F.col("class.least_id")).select(
        back("id").alias(id_col), back("class").alias("class_id"), back("least_id").alias("set_id"), F.col("n").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("shingles").alias("n_shingles"), "text_hash", "kept",
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest identifier (then text hash), all columns unchanged."""
    keys, names = [free_name(docs, "__id"), free_name(docs, "__text")], docs.columns
    found = materialize(near_join(docs, id_col, text_col, **settings), "near").select(F.col(id_col).alias(keys[0]), F.col("text_hash").alias(keys[1]), "kept")
    docs = docs.withColumn(keys[0], F.col(id_col).cast("long")).withColumn(keys[1], F.xxhash64(whole_text(text_col)))
    again = materialize(found.filter("kept").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(keys), "again")
    left = without(docs, found.filter("not kept").select(keys).unionByName(again), keys)
    if not again.isEmpty():  # of rows repeated with identifier and text, one
        same = F.col(f"a.{keys[0]}").eqNullSafe(F.col(f"b.{keys[0]}")) & (F.col(f"a.{keys[1]}") == F.col(f"b.{keys[1]}"))
        left = left.unionByName(docs.alias("a").join(again.alias("b").hint("merge"), same, "left_semi").dropDuplicates(keys))
    return left.select(names)


def op8_minhash_join(spark, sf_dir: str) -> DataFrame:
    return near_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
