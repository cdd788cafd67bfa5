"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan over chunks.

The public model is a byte-pair one. A piece sequence is its encoding exactly when every two neighbours are what
the merges make of their joint text, so encoding is a best path with weights 0 (neighbours agree) and minus infinity.
The state at a chunk's boundary is the piece that ends at or crosses it. Each chunk yields a max-plus matrix from entry
to exit states; matrices combine associatively (runs of chunks, then documents); with its two boundary
states known, each chunk is traced back by itself.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, whole_text

MODEL, CHUNK, RUN, CACHE = "piece_bpe_32k.model", 65_536, 64, 350_000
_BLANK, _RAW = "▁", "\udc81"  # the model's blank mark; a blank mark that a text itself holds (never a piece)
NEVER = -np.inf


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Pieces, merge order and the unit cache of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        sizes: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                sizes.setdefault(p[-3:], set()).add(len(p))
        #: By its last three characters: the sizes a longer piece can have, and always two and one.
        self.sizes = {k: (*sorted(v, reverse=True), 2, 1) for k, v in sizes.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.out = [b""] * sp.get_piece_size()
        for p, i in self.ids.items():
            self.out[i] = p.replace(_BLANK, " ").encode()
        for b, i in enumerate(self.byte):
            self.out[i] = bytes([b])
        #: Neighbouring characters inside some piece; between any others no piece lies, and the path may be cut there.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        inner = any(_BLANK in p.lstrip(_BLANK) for p in self.ids) or any("\n" in p for p in self.ids)
        #: A first split at cuts that no piece spans: before a run of blanks, and around line feeds (where the model allows it).
        self.unit = re.compile(r"[\s\S]+") if inner else re.compile(f"{_BLANK}+[^{_BLANK}\n]*|[^{_BLANK}\n]+|\n")
        self.agree: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merges(self, s: str) -> list[str]:
        """The model's merges, plainly: the best-scored neighbours first, the leftmost of equals."""
        if len(s) > 64:
            return self.merges_by_heap(s)
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = self.score.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merges_by_heap(self, s: str) -> list[str]:
        """The same merges in n log n steps: neighbours wait in a heap by score and place, and are checked when their turn comes."""
        n = len(s)
        stop, before, score = list(range(1, n + 1)), list(range(-1, n - 1)), self.score
        heap = [(-v, i, i + 1, i + 2) for i in range(n - 1) if (v := score.get(s[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, a, b, c = heappop(heap)
            if stop[a] != b or b >= n or stop[b] != c:
                continue
            stop[a], stop[b] = c, -1
            if c < n:
                before[c] = a
                if (v := score.get(s[a : stop[c]])) is not None:
                    heappush(heap, (-v, a, c, stop[c]))
            if before[a] >= 0 and (v := score.get(s[before[a] : c])) is not None:
                heappush(heap, (-v, before[a], a, c))
        out, a = [], 0
        while a < n:
            out.append(s[a : stop[a]])
            a = stop[a]
        return out

    def neighbours(self, key: int, a: str, b: str) -> bool:
        """Whether the merges of the joint text leave these two pieces; remembered under both ids."""
        if len(self.agree) > CACHE:
            self.agree.clear()
        found = self.agree[key] = self.merges(a + b) == [a, b]
        return found

    def paths(self, s: str, begin: int, stop: int, entry: str | None) -> list[str | None]:
        """last[i - begin]: the last piece of the path from ``begin`` (after piece ``entry``) to i, or None where there is none."""
        last: list[str | None] = [entry if entry is not None else ""] + [None] * (stop - begin)
        of, sizes, agree, two = self.ids.get, self.sizes.get, self.agree, (2, 1)
        number = [of(last[0], -1)] + [-1] * (stop - begin)  # the last pieces' ids; -1: none to agree with
        for i in range(begin + 1, stop + 1):
            most = i - begin
            for size in sizes(s[i - 3 : i], two) if most > 2 else two:
                if size > most or last[most - size] is None:
                    continue
                p = s[i - size : i]
                k = of(p, -1)
                if k < 0:
                    if size > 1:
                        continue
                else:
                    j = number[most - size]
                    if j >= 0:
                        fits = agree.get(j << 20 | k)
                        if fits is None:
                            fits = self.neighbours(j << 20 | k, last[most - size], p)
                        if not fits:
                            continue
                last[most] = p
                number[most] = k
                break
        return last

    def trace(self, s: str, begin: int, stop: int, entry: str | None) -> list[str]:
        last, at, out = self.paths(s, begin, stop, entry), stop, []
        while at > begin:
            p = last[at - begin]
            out.append(p)
            at -= len(p)
        return out[::-1]

    def to_ids(self, parts: list[str]) -> bytes:
        out = [self.ids.get(p) for p in parts]
        if None not in out:
            return array("I", out).tobytes() if sys.byteorder == "little" else np.array(out, "<u4").tobytes()
        out = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in (_BLANK if p == _RAW else p).encode()]
        return np.array(out, "<u4").tobytes()

    def encode_unit(self, u: str) -> bytes:
        found = self.older.get(u)
        if found is not None:
            self.known[u] = found
            return found
        word = u[1:]
        if word.isascii() and word.isalpha():  # plain words have few cuts, and the path needs none
            found = self.to_ids(self.trace(u, 0, len(u), None))
            self.keep(u, found)
            return found
        inside, at, out, known = self.inside, 0, [], self.known
        for i in range(1, len(u) + 1):
            if i == len(u) or u[i - 1 : i + 1] not in inside:
                part = u[at:i]
                found = known.get(part)
                if found is None:
                    # pieces of blanks alone share one score, so a run of them is merged as the model does it, from the left
                    found = self.to_ids(self.merges(part) if part.startswith(_BLANK * 2) else self.trace(part, 0, len(part), None))
                    self.keep(part, found)
                out.append(found)
                at = i
        found = b"".join(out)
        self.keep(u, found)
        return found

    def keep(self, u: str, found: bytes) -> None:
        if len(self.known) > CACHE:  # two generations: what is still in use moves on to the next
            self.older = dict(self.known)
            self.known.clear()
        if len(u) <= 64:
            self.known[u] = found

    def encode(self, s: str) -> bytes:
        known, unit = self.known, self.encode_unit
        return b"".join([known.get(u) or unit(u) for u in self.unit.findall(s)])

    def decode(self, ids: bytes) -> bytes:
        out = self.out
        return b"".join([out[i] for i in np.frombuffer(ids, "<u4").tolist()])

    # the scan

    def states(self, s: str, at: int) -> list[tuple[int, int]]:
        """Boundary states at ``at``: (start, end) of every piece that starts before it and ends at or after it."""
        if at <= 0:
            return [(0, 0)]
        found = []
        for a in range(max(0, at - self.longest), at):
            for b in range(at, min(len(s), a + self.longest) + 1):
                if s[a:b] in self.ids or b - a == 1:
                    found.append((a, b))
        return found

    def cut(self, s: str, low: int, high: int, step: int = 1) -> int:
        """The first place from ``low`` to ``high`` (or, step -1, back from ``high`` to ``low``) that no piece spans, or -1."""
        for p in range(max(1, low), high + 1) if step > 0 else range(high, max(1, low) - 1, -1):
            if p >= len(s) or s[p - 1 : p + 1] not in self.inside:
                return p
        return -1

    def transfer(self, s: str, begin: int, end: int) -> np.ndarray:
        """Matrix from the states at ``begin`` to those at ``end``: 0 where a path leads, minus infinity elsewhere."""
        inward, outward = self.states(s, begin), self.states(s, end)
        out = np.full((len(inward), len(outward)), NEVER)
        far = max((b for _, b in inward), default=begin)
        joint = self.cut(s, far, end - 1)
        middle = None
        if joint >= 0:  # every path leads through the cuts, so only what follows the last one matters to the exit
            final = self.cut(s, joint, end - 1, -1)
            last = self.paths(s, final, min(len(s), end + self.longest), None)
            middle = [0.0 if a >= final and last[b - final] == s[a:b] else NEVER for a, b in outward]
        for k, (a, b) in enumerate(inward):
            entry = s[a:b] if b > a else None
            if b >= end:  # the piece covers the whole chunk
                out[k] = [0.0 if x == (a, b) else NEVER for x in outward]
                continue
            last = self.paths(s, b, joint if joint >= 0 else min(len(s), end + self.longest), entry)
            if joint >= 0:
                if last[-1] is not None:
                    out[k] = middle
            else:
                out[k] = [0.0 if (x >= b and last[y - b] == s[x:y]) or (x, y) == (a, b) else NEVER for x, y in outward]
        return out


def normal(text: str, first: bool) -> str:
    s = text.replace(_BLANK, _RAW).replace(" ", _BLANK) if _BLANK in text else text.replace(" ", _BLANK)
    return _BLANK + s if first else s


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices; associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def resolve(matrices: list[np.ndarray], entry: int, leave: int) -> list[tuple[int, int]]:
    """Entry and exit state of every chunk on the best path from state ``entry`` to state ``leave``."""
    ahead = [np.full(matrices[0].shape[0], NEVER)]
    ahead[0][entry] = 0
    for m in matrices:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    out, at = [], leave
    for m, v in zip(reversed(matrices), reversed(ahead[:-1]), strict=True):
        before = int((v + m[:, at]).argmax())
        out.append((before, at))
        at = before
    return out[::-1]


def _times(m: list[int], v: int) -> int:
    out = 0
    while v:
        low = v & -v
        out ^= m[low.bit_length() - 1]
        v ^= low
    return out


def _zero_bytes(most: int = 48) -> list[list[int]]:
    """Matrices in GF(2) that append 2 ** k zero bytes to a string under its crc32."""
    m, out = [0xEDB88320, *(1 << i for i in range(31))], []  # one zero bit
    for k in range(3 + most):
        if k >= 3:
            out.append(m)
        m = [_times(m, x) for x in m]
    return out


_ZEROS = _zero_bytes()


def crc32_combine(a: int, b: int, size: int) -> int:
    """crc32 of two joined strings from their crc32s and the second's length in bytes."""
    for k in range(size.bit_length()):
        if size >> k & 1:
            a = _times(_ZEROS[k], a)
    return a ^ b


_models: dict[str, Pieces] = {}


def _model(path: str) -> Pieces:
    return _models.get(path) or _models.setdefault(path, Pieces(path))


def _matrix(blob: bytes, inward: int) -> np.ndarray:
    return np.where(np.frombuffer(blob, np.uint8).reshape(inward, -1) > 0, 0.0, NEVER)


def _blob(m: np.ndarray) -> bytes:
    return (m == 0).astype(np.uint8).tobytes()


ENCODED = "uid long, id long, chunk long, ids binary"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(uid, id, chunk, ids): the ids of each chunk of each document as little-endian unsigned 32-bit numbers.

    A document of at most ``chunk`` code points is one chunk; longer ones are cut there and scanned. uid tells rows
    of the same identifier apart; it is null for documents of one chunk. A null text counts as empty and has no ids. A blank mark (U+2581) in a text is encoded by its bytes, so that
    decoding gives back every text exactly. Extra columns are ignored.
    """
    small_batches(docs.sparkSession, 500)
    path = model or model_path()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for batch in batches:
            ids = [m.encode(normal(t, True)) if t else b"" for t in batch.column(1).to_pylist()]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), batch.column(0), pa.array(np.zeros(n, np.int64)), pa.array(ids, pa.binary())], names=["uid", "id", "chunk", "ids"])

    return texts.filter(F.char_length("text") <= chunk).mapInArrow(whole, ENCODED).unionByName(_scanned(texts, path, chunk))


def _scanned(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """``encode`` for the texts (id, text) of more than ``chunk`` code points."""
    giants = texts.filter(F.char_length("text") > chunk).withColumn("uid", F.monotonically_increasing_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = _model(path).longest
        for batch in batches:
            for uid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                t = text.as_py()
                for first in range(0, len(t), chunk * RUN):
                    starts = range(first, min(len(t), first + chunk * RUN), chunk)
                    lows = [max(0, a - edge) for a in starts]
                    n = len(lows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([a // chunk for a in starts], pa.int64()), pa.array([a - b for a, b in zip(starts, lows, strict=True)], pa.int64()), pa.array([min(chunk, len(t) - a) for a in starts], pa.int64()), pa.array([t[b : min(len(t), a + chunk + edge)] for a, b in zip(starts, lows, strict=True)], pa.string())],
                        names=["uid", "id", "chunk", "lead", "size", "text"],
                    )

    chunks = materialize(giants.select("uid", "id", "text").mapInArrow(cut, "uid long, id long, chunk long, lead long, size long, text string").repartition("uid", "chunk"), "chunks")

    def bounds(k: int, lead: int, size: int, text: str) -> tuple[str, int, int]:
        s = normal(text, k == 0)
        begin = 0 if k == 0 else lead
        # the mark before a document's first word belongs to its first chunk; a later chunk's context may reach back to it
        return s, begin, (size + 1 if k == 0 else lead + size)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for batch in batches:
            rows = []
            for uid, k, lead, size, text in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                s, a, b = bounds(k, lead, size, text)
                x = m.transfer(s, a, b)
                rows.append((uid, k, k // RUN, x.shape[0], _blob(x)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(columns)], names=["uid", "chunk", "run", "inward", "m"])

    moves = materialize(chunks.select("uid", "chunk", "lead", "size", "text").mapInArrow(matrices, "uid long, chunk long, run long, inward long, m binary"), "transfers")

    def product(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(group.columns[1])
        total = None
        for inward, blob in zip(group.inward, group.m, strict=True):
            x = _matrix(blob, inward)
            total = x if total is None else combine(total, x)
        return pd.DataFrame({"uid": [group.uid.iloc[0]], "run": [group.run.iloc[0]], "inward": [total.shape[0]], "m": [_blob(total)]})

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("run")
        ms = [_matrix(b, i) for i, b in zip(group.inward, group.m, strict=True)]
        # the last boundary is the text's end: the state that a path reaches there
        v = ms[0][0]
        for x in ms[1:]:
            v = (v[:, None] + x).max(axis=0)
        way = resolve(ms, 0, int(v.argmax()))
        return pd.DataFrame({"uid": group.uid, "run": group.run, "a": [a for a, _ in way], "b": [b for _, b in way]})

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        way = resolve([_matrix(b, i) for i, b in zip(group.inward, group.m, strict=True)], int(group.a.iloc[0]), int(group.b.iloc[0]))
        return pd.DataFrame({"uid": group.uid, "chunk": group.chunk, "a": [a for a, _ in way], "b": [b for _, b in way]})

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # these rows are few bytes but much work
    runs = moves.repartition(parts, "uid", "run").groupBy("uid", "run").applyInPandas(product, "uid long, run long, inward long, m binary")
    edges = runs.repartition(parts, "uid").groupBy("uid").applyInPandas(ends, "uid long, run long, a long, b long")
    states = moves.join(edges, ["uid", "run"]).repartition(parts, "uid", "run").groupBy("uid", "run").applyInPandas(inside, "uid long, chunk long, a long, b long")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for batch in batches:
            rows = []
            for uid, doc, k, lead, size, text, a, b in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                s, begin, end = bounds(k, lead, size, text)
                x, y = m.states(s, begin)[a]
                stop = m.states(s, end)[b][1]
                parts: list[str] = []
                if stop > y:
                    joint = m.cut(s, y, end - 1)
                    if joint >= 0:
                        last = m.cut(s, joint, end - 1, -1)
                        head = m.trace(s, y, joint, s[x:y] or None)
                        ids = m.to_ids(head) + m.encode(s[joint:last]) + m.to_ids(m.trace(s, last, stop, None))
                    else:
                        ids = m.to_ids(m.trace(s, y, stop, s[x:y] or None))
                else:
                    ids = m.to_ids(parts)
                rows.append((uid, doc, k, ids))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns)], names=["uid", "id", "chunk", "ids"])

    return chunks.join(states, ["uid", "chunk"]).select("uid", "id", "chunk", "lead", "size", "text", "a", "b").mapInArrow(back, ENCODED)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` with column ``text`` added: each chunk's text; a document's text is its chunks' texts in order."""
    path = model or model_path()
    names = encoded.columns
    at, k = names.index("ids"), names.index("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for batch in batches:
            texts = [m.decode(i)[int(c == 0) :].decode() for i, c in zip(batch.column(at).to_pylist(), batch.column(k).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return encoded.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema) + ", text string")


def encoding_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Per document: id_col, n_tokens, ids_crc32 (of the ids' little-endian bytes), decoded_chars, decoded_crc32, chunks.

    decoded_* describe the text that decoding the ids gives back, in UTF-8. Chunks' checksums are combined, so no
    task holds a whole giant document's ids. Repeated rows are answered each; a null identifier stays null.
    """
    small_batches(docs.sparkSession, 500)
    path = model or model_path()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))

    def both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                ids = m.encode(normal(t, True)) if (t := t.as_py()) else b""
                back = m.decode(ids)[1:]
                rows.append((len(ids), zlib.crc32(ids), len(back.decode()), len(back), zlib.crc32(back)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), batch.column(0), pa.array([0] * n, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=digests)

    digests = ["uid", "id", "chunk", "size", "ids_crc32", "decoded_chars", "octets", "decoded_crc32"]
    # both ways in one Python process a task: a second one would hold the model once more
    short = texts.filter(F.char_length("text") <= chunk).mapInArrow(both_ways, ", ".join(f"{c} long" for c in digests))
    each = decode(_scanned(texts, path, chunk), model)
    each = each.select("uid", "id", "chunk", F.octet_length("ids").cast("long").alias("size"), F.crc32("ids").alias("ids_crc32"), F.char_length("text").cast("long").alias("decoded_chars"), F.octet_length("text").cast("long").alias("octets"), F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"))
    each = materialize(short.unionByName(each), "digests")
    schema = f"{id_col} long, n_tokens long, ids_crc32 long, decoded_chars long, decoded_crc32 long, chunks long"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = each.filter("uid is null").select(F.col("id").alias(id_col), (F.col("size") / 4).cast("long").alias("n_tokens"), "ids_crc32", "decoded_chars", "decoded_crc32", F.lit(1).cast("long").alias("chunks"))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        ids = text = 0
        for a, n, b, o in zip(group.ids_crc32, group["size"], group.decoded_crc32, group.octets, strict=True):
            ids, text = crc32_combine(ids, int(a), int(n)), crc32_combine(text, int(b), int(o))
        return pd.DataFrame({id_col: group.id.iloc[:1], "n_tokens": [group["size"].sum() // 4], "ids_crc32": [ids], "decoded_chars": [group.decoded_chars.sum()], "decoded_crc32": [text], "chunks": [len(group)]})

    return short.unionByName(each.filter("uid is not null").repartition(parts, "uid").groupBy("uid").applyInPandas(join, schema))


def op10_max_plus_pieces(spark, sf_dir: str) -> DataFrame:
    return encoding_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
