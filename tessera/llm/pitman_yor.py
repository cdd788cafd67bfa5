"""Language-model scores from a hierarchical Pitman-Yor model of a corpus.

Every word, and the end of a text, is a context restaurant over the next token; all context restaurants share one
parent over words, whose base is uniform over the known words and the event of a new word.

Words get numbers first: each block of texts sends its distinct word hashes to their homes (a hash of the word),
which number them, commonest first. From then on only numbers travel, packed. Blocks send their distinct pairs to
the part of the context (its home); there the restaurants are sampled where they lie. Contexts with at least 1/HOT of
the tokens (at most HOT) are spread over all parts, with a shared gamma variable. Parts and homes exchange the
parent's tables by word. Blocks and restaurants are stored in buckets, so that they never cross the network again:
what is sent to them is joined to them where they lie. Only the hot contexts' totals and a few sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .common import bucketed, doc_key, forget, materialize, release, small_batches, whole_text

HOT, BLOCK_BYTES, PART_TOKENS, LEAST_PARTS, ROUNDS, BURN_IN, SAMPLES, SEED = 1024, 8 << 20, 2_000_000, 24, 2, 8, 8, 3
END = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Up to LARGEST_COUNT customers and a mean of FEW_TABLES, table numbers are drawn from rows of Stirling numbers.
FEW_TABLES, ROW_TABLES, EXACT_COUNT, LARGEST_COUNT = 1024, 2048, 256, 16_384


# Gibbs sampling


def stirling_rows(discount: float, most: int = LARGEST_COUNT, tables: int = ROW_TABLES) -> tuple[np.ndarray, np.ndarray]:
    """log generalised Stirling numbers: (counts, rows); rows[i, t - 1] is for counts[i] customers at t tables.

    Every count up to EXACT_COUNT has a row, larger ones 16 rows an octave up to ``most``, where their shape over t
    hardly changes any more.
    """
    grid = sorted({*range(1, min(EXACT_COUNT, most) + 1), *(int(round(2 ** (k / 16))) for k in range(128, int(16 * np.log2(most)) + 1) if 2 ** (k / 16) <= most)})
    t = np.arange(1, tables + 1)
    row = np.full(tables, -np.inf)
    row[0] = 0.0
    rows, want = [], set(grid)
    for c in range(1, grid[-1] + 1):
        if c > 1:
            width = min(c, tables)
            stay = np.full(width, -np.inf)
            k = min(c - 1, tables)
            stay[:k] = row[:k] + np.log(c - 1 - discount * t[:k])
            new = np.full(width, -np.inf)
            new[1:] = row[: width - 1]
            row[:width] = np.logaddexp(stay, new)
        if c in want:
            rows.append(row.copy())
    return np.array(grid), np.array(rows)


def large_seating(count: np.ndarray, log_rate: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the number of tables, p(t) in proportion to S(count, t) exp(t log_rate), by its saddle point.

    S(c, t) is c! / t! times the coefficient of x^c in u(x)^t, u(x) = (1 - (1 - x)^d) / d. Tilted by the x = 1 - s at
    which the mean of c is right, (t, c) has Poisson moments; those of t given c follow.
    """
    low, high = np.full(len(count), -700.0), np.zeros(len(count))  # log s
    for _ in range(70):
        middle = (low + high) / 2
        more = log_rate + np.log1p(-np.exp(np.minimum(middle, -1e-300))) + (discount - 1) * middle > np.log(count)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    s = np.exp((low + high) / 2)
    x, rate = 1 - s, np.exp(log_rate)
    u = -np.expm1(discount * np.log(s)) / discount
    return rate * u, rate * np.maximum(u - x * s**discount / (s + x * (1 - discount)), 1e-12)


def sample_tables(count: np.ndarray, log_rate: np.ndarray, grid: np.ndarray, rows: np.ndarray, rng: np.random.Generator, cells: int = 1 << 21, discount: float = 0.5) -> np.ndarray:
    """Draw table numbers t with p(t) in proportion to S(count, t) exp(t log_rate), for each dish of each restaurant.

    Counts above the last row, and those whose mean is above FEW_TABLES, are drawn from the limit law at their own
    count and rate: one more than a Poisson number while few tables are likely, else a rounded normal.
    """
    at = np.minimum(np.searchsorted(grid, count), len(grid) - 1)
    lower = np.maximum(at - 1, 0)
    at = np.where((at > 0) & (count - grid[lower] < grid[at] - count), lower, at)
    out = np.ones(len(count), np.int64)
    large = np.flatnonzero((count > grid[-1]) | (count > FEW_TABLES) & (log_rate > np.log(FEW_TABLES * discount)))
    if len(large):
        mean, spread = large_seating(count[large].astype(float), log_rate[large], discount)
        big = (mean > FEW_TABLES) | (count[large] > grid[-1])
        large, mean, spread = large[big], mean[big], spread[big]
        normal = np.rint(mean + np.sqrt(spread) * rng.standard_normal(len(large)))
        out[large] = np.clip(np.where(mean < 50, 1 + rng.poisson(np.minimum(mean, 50)), normal), 1, count[large])
    rest = np.ones(len(count), bool)
    rest[large] = False
    order = np.argsort(at, kind="stable")
    order = order[(count[order] > 1) & rest[order]]
    edges = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0]) if len(order) else []
    for a, b in zip(edges, np.r_[edges[1:], len(order)].astype(int) if len(order) else [], strict=True):
        width = int(min(grid[at[order[a]]], rows.shape[1]))
        log_s, t = rows[at[order[a]], :width], np.arange(1, width + 1)
        for first in range(a, b, max(1, cells // width)):
            who = order[first : min(b, first + max(1, cells // width))]
            w = log_s + log_rate[who][:, None] * t
            w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[who] = 1 + (w < (rng.random(len(who)) * w[:, -1])[:, None]).sum(axis=1)
    return np.minimum(out, np.maximum(count, 1))


def discount_of(counts: np.ndarray, n: np.ndarray | None = None) -> float:
    """n1 / (n1 + 2 n2), kept away from 0 and 1."""
    one = (counts == 1).sum() if n is None else n[counts == 1].sum()
    two = (counts == 2).sum() if n is None else n[counts == 2].sum()
    return float(np.clip(one / max(1, one + 2 * two), 0.1, 0.9))


def gibbs(u: np.ndarray, w: np.ndarray, c: np.ndarray, classes: int, burn_in: int = BURN_IN, samples: int = SAMPLES, concentration: float = 1.0, seed: int = SEED) -> np.ndarray:
    """Averaged predictive probabilities, classes x classes, of the next class given a context.

    u, w, c: contexts, next classes and counts. Each sweep draws, per context, a gamma variable that makes its dishes
    independent given the parent's distribution; then all table numbers; then the parent's tables and a draw of its
    distribution (its tables being the contexts' customers). Predictions are averaged over sweeps after burn-in.
    """
    rng = np.random.default_rng(seed)
    order = np.lexsort([w, u])
    u, w, c = u[order], w[order], c[order].astype(np.int64)
    d, theta = discount_of(c), concentration
    d0, theta0 = 0.5, concentration
    base = np.full(classes, 1 / classes)
    grid, rows = stirling_rows(d)
    grid0, rows0 = stirling_rows(d0)
    total = np.bincount(u, c, classes)
    t, parent = np.ones(len(c), np.int64), np.full(classes, 1 / classes)
    mean = np.zeros((classes, classes))
    for sweep in range(burn_in + samples):
        g = rng.gamma(theta / d + np.bincount(u, t, classes))
        t = sample_tables(c, np.log(np.maximum(d * g[u] * parent[w], 1e-300)), grid, rows, rng, discount=d)
        customers = np.bincount(w, t, classes).astype(np.int64)
        have = np.flatnonzero(customers)
        t0 = np.zeros(classes, np.int64)
        g0 = rng.gamma(theta0 / d0 + max(1, len(have)))
        t0[have] = sample_tables(customers[have], np.log(d0 * g0 * base[have]), grid0, rows0, rng, discount=d0)
        draw = rng.gamma(np.r_[np.maximum(customers - d0 * t0, 1e-9), theta0 + d0 * t0.sum()])
        draw /= draw.sum()
        parent = draw[:-1] + draw[-1] * base
        if sweep >= burn_in:
            expected = (customers - d0 * t0 + (theta0 + d0 * t0.sum()) * base) / (theta0 + customers.sum())
            tables = np.bincount(u, t, classes)
            mean += ((theta + d * tables) / (theta + total))[:, None] * expected[None, :]
            np.add.at(mean, (u, w), (c - d * t) / (theta + total[u]))
    return mean / samples


# Corpus passes

BLOCKS = "block long, learnt long, tokens long, body array<binary>"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, up to about BLOCK_BYTES: fewer blocks ask for fewer words and pairs."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers: each block of texts has its distinct word hashes, commonest first, and an index per token."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in _gathered(batches):
        ids, held = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
        docs, nulls = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        column = batch.column(2)
        offsets = bytescan.buffers(column)[1]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
            tokens, sizes = [], []
            for _, _, data, off in bytescan.blocks(column.slice(at, end - at)):
                starts, ends, words = bytescan.word_spans(data, off)
                tokens.append(np.insert(bytescan.word_hashes(data, starts, ends), words[1:], END))
                sizes.append(np.diff(words) + 1)
            tokens, sizes = np.concatenate(tokens), np.concatenate(sizes)
            hashes, where, often = np.unique(tokens, return_inverse=True, return_counts=True)
            rank = np.argsort(-often, kind="stable")
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            where = place[where]
            learn = np.repeat(held[at:end] == 0, sizes)
            counts = np.bincount(where[learn], minlength=len(rank))
            body = [_packed(x) for x in (docs[at:end], nulls[at:end], held[at:end], np.cumsum(sizes), hashes[rank], counts, where.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(learn.sum())]), pa.array([len(tokens)]), pa.array([body], pa.list_(pa.binary()))], names=[x.split()[0] for x in BLOCKS.split(", ")])
            at, number = end, number + 1


#: What blocks, homes and parts send each other: packed arrays, and two numbers to sum.
MAIL = "dest long, kind int, src long, body array<binary>, a double, b double"
ASKED, NUMBERS, HOT_WORDS, PAIRS, TABLES, HOT_SUMS, STORE, WEIGHTS, CONTEXTS, CHANCES, FACTS = range(11)


def _packed(x: np.ndarray) -> bytes:
    """Bytes of equal place side by side, compressed; whole numbers in the least width that holds them."""
    if x.dtype.kind in "iu" and x.dtype.itemsize > 1 and len(x) and x.min() >= 0:
        x = x.astype(np.min_scalar_type(int(x.max())))
    head = f"{x.dtype.str} {len(x)} ".encode()
    return head + pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes(), "zstd", asbytes=True) if len(x) else head


def _unpacked(b: bytes) -> np.ndarray:
    kind, n, rest = b.split(b" ", 2)
    kind, n = np.dtype(kind.decode()), int(n)
    if not n:
        return np.zeros(0, kind)
    return np.frombuffer(np.frombuffer(pa.decompress(rest, n * kind.itemsize, "zstd", asbytes=True), np.uint8).reshape(kind.itemsize, n).T.tobytes(), kind)


def _whole(b: bytes) -> np.ndarray:
    return _unpacked(b).astype(np.int64)


def _signed(b: bytes) -> np.ndarray:
    return _unpacked(b).astype(np.int64)


def _steps(x: np.ndarray) -> bytes:
    """Rising numbers as their differences."""
    return _packed(np.diff(x, prepend=0))


def _rising(b: bytes) -> np.ndarray:
    return _whole(b).cumsum()


def _mail(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*r, 0.0, 0.0)[:6] for r in rows), strict=True), types, strict=True)], names=[x.split()[0] for x in MAIL.split(", ")])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, list[bytes]]]]]:
    now, held = None, []
    for batch in batches:
        dest, kind, src = (batch.column(c).to_pylist() for c in range(3))
        for i, d in enumerate(dest):
            if d != now and held:
                yield now, held
                held = []
            now = d
            held.append((kind[i], src[i], batch.column(3)[i].as_py()))
    if held:
        yield now, held


def _home(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (bytescan.mix(hashes) % np.uint64(parts)).astype(np.int64)


def _slices(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, first, end) of sorted part numbers."""
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return [(int(part[a]), int(a), int(b)) for a, b in zip(edges, np.r_[edges[1:], len(part)].astype(int), strict=True)] if len(edges) else []


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether each key is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _ask(parts: int):
    """Each block's distinct word hashes, with their counts in the training part, to the words' homes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes, counts = _unpacked(body[4].as_py()), _whole(body[5].as_py())
                home = _home(hashes, parts)
                order = np.lexsort([hashes, home])
                yield _mail([(p, ASKED, block, [_packed(hashes[order[a:b]]), _packed(counts[order[a:b]])]) for p, a, b in _slices(home[order])])

    return run


def _number(parts: int, tokens: int):
    """A home's words get numbers, commonest first; each block gets back its words' numbers and counts, the driver the hot words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, mails in _groups(batches):
            asked = [(src, _unpacked(body[0]), _whole(body[1])) for _, src, body in mails]
            words, where = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
            count = np.bincount(where, np.concatenate([x[2] for x in asked]), len(words)).astype(np.int64)
            order = np.argsort(-count, kind="stable")
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(len(words))
            hot = order[count[order] * HOT >= max(1, tokens)]
            yield _mail([(home, HOT_WORDS, home, [_packed(number[hot] * parts + home), _packed(count[hot])], float((count > 0).sum()))])
            first = 0
            for src, h, _ in asked:
                at = where[first : first + len(h)]
                yield _mail([(src, NUMBERS, home, [_packed(number[at]), _packed(count[at])])])
                first += len(h)

    return run


def _numbered(hashes: np.ndarray, mails: list[tuple[int, int, list[bytes]]], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers over all homes and counts of a block's words, from the homes' replies; and the order in which they were asked."""
    order = np.lexsort([hashes, _home(hashes, parts)])
    numbers, counts = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
    replies = sorted((src, body) for kind, src, body in mails if kind == NUMBERS)
    numbers[order] = np.concatenate([_whole(body[0]) * parts + src for src, body in replies])
    counts[order] = np.concatenate([_whole(body[1]) for _, body in replies])
    return numbers, counts, order


def _block_pairs(words: np.ndarray, start: int, ids: np.ndarray, parts: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs of a block by part, context and next word, both in the order of their numbers: indices, part, and the pair of each token."""
    by = np.argsort(words)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    token = rank[ids]
    code, where = np.unique(np.r_[rank[start], token[:-1]] * len(words) + token, return_inverse=True)
    u, w = by[code // len(words)], by[code % len(words)]
    spread = _find(hot, words)[1][u]
    part = words[u] % parts
    part[spread] = (bytescan.mix(bytescan.mix(words[u[spread]].astype(np.uint64)) + words[w[spread]].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return u[order], w[order], part[order], place[where]


def _pair_up(parts: int, hot: np.ndarray):
    """Each block's distinct pairs with their counts in the training part (0: in held-out texts only), to the context's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, body, mails in _with_mail(batches):
            held, ends, hashes, ids = _whole(body[2]), _whole(body[3]), _unpacked(body[4]), _whole(body[6])
            words, _, _ = _numbered(hashes, mails, parts)
            learn = np.repeat(held == 0, np.diff(np.r_[0, ends]))
            u, w, part, where = _block_pairs(words, int(np.flatnonzero(hashes == END)[0]), ids, parts, hot)
            n = np.bincount(where[learn], minlength=len(u))
            rows = []
            for p, a, b in _slices(part):
                firsts = np.flatnonzero(np.r_[True, u[a + 1 : b] != u[a : b - 1]])
                contexts = words[u[a:b][firsts]]
                rows.append((p, PAIRS, block, [_steps(contexts // parts), _packed(contexts % parts), _packed(np.diff(np.r_[firsts, b - a])), _packed(words[w[a:b]]), _packed(n[a:b])]))
            yield _mail(rows)

    return run


def _with_mail(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[tuple[int, int, list[bytes]]]]]:
    """(number, body, mails) of stored rows joined to what was sent to them."""
    for batch in batches:
        for i in range(batch.num_rows):
            mails = batch.column(2)[i].as_py() or []
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), [(m["kind"], m["src"], m["body"]) for m in mails]


def _tables_mail(part: int, words: np.ndarray, tables: np.ndarray, parts: int) -> list[tuple]:
    """A part's tables by word, to the words' homes; words are sorted by home and number."""
    return [(q, TABLES, part, [_steps(words[a:b] // parts), _packed(tables[a:b])]) for q, a, b in _slices(words % parts)]


SEATS = "dest long, body array<binary>, blocks array<long>, places array<binary>, one double, two double"


def _seat(parts: int):
    """A part's restaurants: pairs of all blocks added up; and for each block where its pairs are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, mails in _groups(batches):
            us, ws, ns, blocks = [], [], [], []
            for _, block, body in mails:
                u = _rising(body[0]) * parts + _whole(body[1])
                us.append(np.repeat(u, _whole(body[2])))
                ws.append(_whole(body[3]))
                ns.append(_whole(body[4]))
                blocks.append((block, len(ws[-1])))
            del mails
            contexts, u = np.unique(np.concatenate(us), return_inverse=True)
            words, w = np.unique(np.concatenate(ws), return_inverse=True)
            pairs, where = np.unique(u * len(words) + w, return_inverse=True)  # in the order of numbers, as each block's are
            c = np.bincount(where, np.concatenate(ns), len(pairs)).astype(np.int64)
            u, w = pairs // len(words), pairs % len(words)
            by_home = np.lexsort([words, words % parts])
            place = np.empty(len(words), np.int64)
            place[by_home] = np.arange(len(words))
            words, w = words[by_home], place[w]
            homes = np.bincount(words % parts, minlength=parts)
            body = [_steps(contexts // parts), _packed(contexts % parts), _packed(np.bincount(u, minlength=len(contexts))), _packed(homes), _packed(np.diff(words // parts, prepend=0)), _packed(w), _packed(c)]
            first, places = 0, []
            for _, n in blocks:
                places.append(_steps(where[first : first + n]))
                first += n
            columns = [[part], [body], [[b for b, _ in blocks]], [places], [float((c == 1).sum())], [float((c == 2).sum())]]
            types = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SEATS.split(", ")])

    return run


def _seated(body: list[bytes], parts: int) -> tuple[np.ndarray, ...]:
    """Contexts, words (by home and number), and each pair's context, word and count."""
    contexts = _rising(body[0]) * parts + _whole(body[1])
    homes = _whole(body[3])
    words = _signed(body[4]).cumsum() * parts + np.repeat(np.arange(parts), homes)
    return contexts, words, np.repeat(np.arange(len(contexts)), _whole(body[2])), _whole(body[5]), _whole(body[6])


def _first_tables(parts: int, hot: np.ndarray):
    """From each part, before any draw: one table a dish by word, and the hot contexts' customers and tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                contexts, words, u, w, c = _seated(body.as_py(), parts)
                rows = _tables_mail(part, words, np.bincount(w, c > 0, len(words)).astype(np.int64), parts)
                at, spread = _find(hot, contexts)
                if spread.any():
                    sums = [np.bincount(u, x, len(contexts))[spread].astype(np.int64) for x in (c, c > 0)]
                    rows.append((part, HOT_SUMS, -1, [_packed(x) for x in (at[spread], *sums)]))
                yield _mail(rows)

    return run


@dataclass(frozen=True)
class Sums:
    """What the driver knows: discounts, the hot contexts' customers and tables, and the parent's sums."""

    hot: np.ndarray
    hot_count: np.ndarray
    hot_tables: np.ndarray
    discount: float
    tokens: int = 0
    known: int = 0
    words: int = 0
    customers: float = 0.0
    tables: float = 0.0
    concentration: float = 1.0
    parent_discount: float = 0.5
    parent_concentration: float = 1.0

    def parent(self, weight: np.ndarray) -> np.ndarray:
        """The parent's probability of words with the given customers less discounts (0: of a new word)."""
        return (weight + (self.parent_concentration + self.parent_discount * self.tables) / (self.words + 1)) / (self.parent_concentration + self.customers)


def _parent(sums: Sums, stirling: tuple[np.ndarray, np.ndarray], number: int, parts: int):
    """The parent's customers by word, its tables drawn (in the first round one a dish), and both back to the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, mails in _groups(batches):
            asked = [(src, _rising(body[0]), _whole(body[1])) for _, src, body in mails]
            words, where = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
            customers = np.bincount(where, np.concatenate([x[2] for x in asked]), len(words)).astype(np.int64)
            tables = (customers > 0).astype(np.int64)
            if number:
                rng, shared = np.random.default_rng((SEED, 1, number, home)), np.random.default_rng((SEED, 2, number))
                g = shared.gamma(sums.parent_concentration / sums.parent_discount + sums.tables)
                have = np.flatnonzero(customers)
                rate = np.full(len(have), np.log(sums.parent_discount * g / (sums.words + 1)))
                tables[have] = sample_tables(customers[have], rate, *stirling, rng, discount=sums.parent_discount)
            yield _mail([(home, STORE, int((customers > 0).sum()), [_steps(words), _packed(customers), _packed(tables)], float(customers.sum()), float(tables.sum()))])
            first = 0
            for src, w, _ in asked:
                at = where[first : first + len(w)]
                yield _mail([(src, WEIGHTS, home, [_packed(customers[at]), _packed(tables[at])])])
                first += len(w)

    return run


def _sample(sums: Sums, stirling: tuple[np.ndarray, np.ndarray], number: int, last: bool, parts: int):
    """Sweeps over a part's restaurants given the parent; in the last round also each pair's customers and tables, to the blocks.

    Tables over the sweeps after burn-in are sent as sums, so all that travels is whole numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, theta = sums.discount, sums.concentration
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                contexts, words, u, w, c = _seated(batch.column(1)[i].as_py(), parts)
                mails = sorted((m["src"], m["body"]) for m in batch.column(2)[i].as_py())
                weight = np.concatenate([_whole(b[0]) - sums.parent_discount * _whole(b[1]) for _, b in mails])
                parent = sums.parent(weight)
                at, spread = _find(sums.hot, contexts)
                rng, shared = np.random.default_rng((SEED, 3, number, part)), np.random.default_rng((SEED, 4, number))
                t, many = np.minimum(c, 1), np.flatnonzero(c > 1)
                sum_t = np.zeros(len(c), np.int64)
                for sweep in range(BURN_IN + SAMPLES):
                    g = rng.gamma(theta / d + np.bincount(u, t, len(contexts)))
                    if len(sums.hot):
                        g = np.where(spread, shared.gamma(theta / d + sums.hot_tables)[at], g)
                    t[many] = sample_tables(c[many], np.log(np.maximum(d * g[u[many]] * parent[w[many]], 1e-300)), *stirling, rng, discount=d)
                    if sweep >= BURN_IN:
                        sum_t += t
                rows = _tables_mail(part, words, np.bincount(w, t, len(words)).astype(np.int64), parts)
                drawn = np.bincount(u, sum_t, len(contexts)).astype(np.int64)
                if spread.any():
                    rows.append((part, HOT_SUMS, -1, [_packed(x) for x in (at[spread], np.zeros(spread.sum(), np.int64), drawn[spread])]))
                if last:
                    rows.append((part, CONTEXTS, -1, [_steps(contexts[~spread] // parts), _packed(drawn[~spread])]))
                yield _mail(rows)
                if last:
                    more = sum_t - SAMPLES * np.minimum(c, 1)
                    for block, places in zip(batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), strict=True):
                        where = _rising(places)
                        yield _mail([(block, CHANCES, part, [_packed(c[where]), _packed(more[where])])])

    return run


def _facts(parts: int):
    """To each block, for its words: tables drawn in the word's restaurant, and the parent's customers and tables of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, mails in _groups(batches):
            tables = [(_rising(b[0]), (_whole(b[1]),)) for k, _, b in mails if k == CONTEXTS]
            parent = [(_rising(b[0]), (_whole(b[1]), _whole(b[2]))) for k, _, b in mails if k == STORE]
            for k, block, body in mails:
                if k == NUMBERS:
                    number = _whole(body[0])
                    out = [np.zeros(len(number), np.int64) for _ in range(3)]
                    for keys, values, to in [(*x, out[:1]) for x in tables] + [(*x, out[1:]) for x in parent]:
                        at, known = _find(keys, number)
                        for x, y in zip(to, values, strict=True):
                            x[known] = y[at[known]]
                    yield _mail([(block, FACTS, home, [_packed(x) for x in out])])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(sums: Sums, parts: int):
    def finish(body: list[bytes], mails: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
        docs, null, held, ends, hashes, ids = _unpacked(body[0]).astype(np.int64), _whole(body[1]), _whole(body[2]), _whole(body[3]), _unpacked(body[4]), _whole(body[6])
        begin = np.r_[0, ends[:-1]]
        words, total, order = _numbered(hashes, mails, parts)
        sent = lambda kind: sorted((src, b) for k, src, b in mails if k == kind)
        facts = [np.empty(len(words), np.int64) for _ in range(3)]
        for i in range(3):
            facts[i][order] = np.concatenate([_whole(b[i]) for _, b in sent(FACTS)])
        drawn, customers, tables = facts
        at, spread = _find(sums.hot, words)
        mean = np.where(spread, sums.hot_tables[at] if len(sums.hot) else 0.0, drawn / SAMPLES)
        back = (sums.concentration + sums.discount * mean) / (sums.concentration + total)
        parent = sums.parent(customers - sums.parent_discount * tables)
        u, w, _, where = _block_pairs(words, int(np.flatnonzero(hashes == END)[0]), ids, parts, sums.hot)
        c, more = (np.concatenate([_whole(b[i]) for _, b in sent(CHANCES)]) for i in range(2))
        own = (c - sums.discount * (np.minimum(c, 1) + more / SAMPLES)) / (sums.concentration + total[u])
        score = np.log10(own + back[u] * parent[w])[where]
        base = np.log10((total + 0.5) / (sums.tokens + 0.5 * (sums.known + 1)))
        add = lambda x: np.add.reduceat(x, begin)  # noqa: E731  every text has its end
        n = len(ends)
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, mask=null > 0), pa.array(held > 0), pa.array(ends - begin), pa.array(add((total > 0)[ids].astype(np.int64))), pa.array(np.full(n, sums.tokens)), pa.array(add(base[ids])), pa.array(add(score))],
            names=[x.split()[0] for x in SCORES.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, body, mails in _with_mail(batches):
            yield finish(body, mails)

    return run


def _hot_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column(0).to_pylist():
            n, c = map(_whole, body)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(c)], names=["word", "n"])


def _hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column(0).to_pylist():
            at, c, t = map(_whole, body)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c.astype(float)), pa.array(t.astype(float))], names=["at", "c", "t"])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(identifier as text) mod 5 is not 1 and scores all, whole. Tokens are words
    (A-Z folded) and one end for each text, so a null or empty text has one token. Words are told apart by 64-bit
    hashes. Scores are log10; ``score`` is the predictive probability of every token given the one before, from table
    numbers averaged over sweeps. The event of a new word has one probability, however many new words there are.
    perplexity is 10 ** (-score / n_tokens). Repeated rows count and are scored each; a null identifier is in the
    training part; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = doc_key(id_col) % 5 == 1
    texts = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), whole_text(text_col).alias("text"))
    buckets = max(LEAST_PARTS, texts.rdd.getNumPartitions())
    blocks = bucketed(texts.mapInArrow(_block_rows, BLOCKS), "blocks", "block", buckets)
    sizes = blocks.agg(F.sum("tokens").alias("n"), F.sum("learnt").alias("learnt")).first()
    counted = sizes.learnt or 0
    parts = max(LEAST_PARTS, int((sizes.n or 0) // PART_TOKENS))

    def dealt(mails: DataFrame) -> DataFrame:
        return mails.repartition(parts, "dest").sortWithinPartitions("dest", "kind", "src")

    def delivered(stored: DataFrame, key: str, columns: list[str], mails: DataFrame, n: int) -> DataFrame:
        """Stored rows with all that was sent to them; only the mail moves."""
        sent = mails.select("dest", F.struct("kind", "src", "body").alias("m")).repartition(n, "dest").groupBy("dest").agg(F.collect_list("m").alias("mails"))
        return stored.join(sent.hint("shuffle_hash"), stored[key] == sent["dest"], "left").select(stored[key], *[stored[c] for c in columns[:1]], "mails", *[stored[c] for c in columns[1:]])

    def kept(mails: DataFrame, name: str) -> DataFrame:
        done = materialize(mails, name)
        release(spark)
        return done

    numbers = kept(dealt(blocks.select("block", "body").mapInArrow(_ask(parts), MAIL)).mapInArrow(_number(parts, counted), MAIL), "numbers")
    known = numbers.filter(F.col("kind") == HOT_WORDS)
    hot_rows = sorted(tuple(r) for r in known.select("body").mapInArrow(_hot_words, "word long, n long").collect())  # at most HOT rows
    hot = np.array([w for w, _ in hot_rows], np.int64)
    sums = Sums(hot, np.array([n for _, n in hot_rows], float), np.zeros(len(hot)), 0.5, tokens=counted, known=int(known.agg(F.sum("a")).first()[0] or 0))
    numbers = numbers.filter(F.col("kind") == NUMBERS)

    def tables_of(mails: DataFrame) -> np.ndarray:
        out = np.zeros(len(hot))
        parted = mails.filter(F.col("kind") == HOT_SUMS).select("body").mapInArrow(_hot_sums, "at long, c double, t double")
        for r in parted.groupBy("at").agg(F.sum("t").alias("t")).collect():  # at most HOT rows
            out[r.at] = r.t
        return out

    pairs = delivered(blocks, "block", ["body"], numbers, buckets).mapInArrow(_pair_up(parts, hot), MAIL)
    seats = bucketed(dealt(pairs).mapInArrow(_seat(parts), SEATS), "seats", "dest", parts)
    release(spark)
    ones = seats.agg(F.sum("one").alias("one"), F.sum("two").alias("two")).first()
    now = kept(seats.select("dest", "body").mapInArrow(_first_tables(parts, hot), MAIL), "tables")
    sums = replace(sums, discount=discount_of(np.array([1, 2]), np.array([ones.one or 0, ones.two or 0])), hot_tables=tables_of(now))
    stirling, stirling0 = stirling_rows(sums.discount), stirling_rows(sums.parent_discount)
    for number in range(ROUNDS + 1):
        parent = kept(dealt(now.filter(F.col("kind") == TABLES)).mapInArrow(_parent(sums, stirling0, number, parts), MAIL), "parent")
        s = parent.filter(F.col("kind") == STORE).agg(F.sum("src").alias("v"), F.sum("a").alias("c"), F.sum("b").alias("t")).first()
        sums = replace(sums, words=s.v or 0, customers=s.c or 0.0, tables=s.t or 0.0)
        if number == ROUNDS:
            break
        last = number == ROUNDS - 1
        given = delivered(seats, "dest", ["body", "blocks", "places"] if last else ["body"], parent.filter(F.col("kind") == WEIGHTS), parts)
        before, now = now, kept(given.mapInArrow(_sample(sums, stirling, number, last, parts), MAIL), "sampled")
        forget(before, parent)
        sums = replace(sums, hot_tables=tables_of(now) / SAMPLES)
    store = parent.filter(F.col("kind") == STORE).unionByName(now.filter(F.col("kind") == CONTEXTS))
    asked = numbers.withColumns({"dest": F.col("src"), "src": F.col("dest")})
    facts = dealt(asked.unionByName(store)).mapInArrow(_facts(parts), MAIL)
    every = numbers.unionByName(facts).unionByName(now.filter(F.col("kind") == CHANCES))
    done = delivered(blocks, "block", ["body"], every, buckets).mapInArrow(_scorer(sums, parts), SCORES)
    return done.withColumnRenamed("doc_id", id_col)


def op1_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
