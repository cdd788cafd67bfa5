"""Shortest-pack-first histogram packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import local_table, materialize, small_batches, whole_text

LENGTH, END_ID, TOKENIZER = 2048, 1, "byte_bpe_50k.json"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_rank long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a byte-level BPE vocabulary file of the tokenizers library.

    The same merges run through the library's faster rank table where one lies beside the file; texts that contain a
    special token's string, and all texts where there is no such table, go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        self.fast = None
        try:
            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.removesuffix(".json") + ".tiktoken", "rb"))}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, OSError):
            pass

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as e:  # the rank table's regex can give up on a very long run of white space
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, seen[len(piece)]))
                    seen[len(piece)] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 5 else pa.int64()) for i, c in enumerate(columns)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Place lengths, longest first, each into the packs that are shortest so far (most room), by counts of equal packs.

    Returns segments (piece length, first rank, end rank, first sequence, offset): pieces of that length ranked from
    first to end go into consecutive sequences at one offset. Work depends on the number of lengths, not of pieces.
    """
    segments, next_sequence = [], 0
    packs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # filled tokens -> runs of sequences (first, count)
    filled = np.zeros(length + 1, bool)
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            least = np.flatnonzero(filled[: length - size + 1])
            if not len(least):
                segments.append((size, rank, rank + left, next_sequence, 0))
                packs[size].append((next_sequence, left))
                filled[size] = True
                next_sequence += left
                break
            at = int(least[0])
            first, count = packs[at].pop()
            used = min(count, left)
            if used < count:
                packs[at].append((first + used, count - used))
            filled[at] = bool(packs[at])
            segments.append((size, rank, rank + used, first, at))
            packs[at + size].append((first, used))
            filled[at + size] = True
            left, rank = left - used, rank + used
    return segments


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (null text: empty) and one end id are cut every ``length`` ids; pieces are packed by
    ``shortest_pack_first`` on the histogram of their lengths (at most ``length`` numbers reach the driver), and
    patterns join back by each piece's rank among pieces of its length: its rank within its input partition plus the
    count in the partitions before. Repeated rows are packed each for itself; a null identifier stays null; extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or tokenizer_path()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    pieces = materialize(texts.mapInArrow(_pieces(path, length, end_id), PIECES), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = shortest_pack_first(histogram, length)
    table = local_table(spark, segments, "length bigint, low bigint, high bigint, first bigint, offset bigint")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    # segments: bounded by the lengths there are, whatever the number of documents
    table = F.broadcast(table) if len(segments) <= 64 * length else table
    return ranked.join(table, (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        F.col("doc_id").alias(id_col), "start", ranked["length"], "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"
    )


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
