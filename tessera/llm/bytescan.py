"""Vectorised scans of a batch of texts as one byte buffer: words, word hashes and shingle hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column (null: empty); the bytes are followed by eight zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return np.concatenate([data, np.zeros(8, np.uint8)]), (offsets - offsets[0] if len(column) else np.zeros(1, np.int64))


def blocks(column: pa.Array, size: int = 1 << 21):
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``size`` bytes: bounds the working arrays."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end] + 8], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without white space), and n + 1 offsets of each text's words."""
    n = int(offsets[-1])
    word = ~_SPACE[data[:n]]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # texts border on one another without white space
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:n]
    final = word.copy()
    final[:-1] &= ~word[1:] | first[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(final) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words, A-Z folded to lower case if asked; read eight bytes at a time."""
    data = np.ascontiguousarray(_LOWER[data] if lower else data)
    lanes = np.lib.stride_tricks.as_strided(data[: len(data) - 7].view(np.uint8), (max(0, len(data) - 7), 8), (1, 1))
    sizes = ends - starts
    h = sizes.astype(np.uint64) * _M1
    left, at, who = sizes, starts, None
    while len(left):
        chunk = lanes[at].copy().view("<u8").ravel() & _KEEP[np.minimum(left, 8)]
        if who is None:
            h = mix(h ^ chunk)
        else:
            h[who] = mix(h[who] ^ chunk)
        more = np.flatnonzero(left > 8)
        who = more if who is None else who[more]
        left, at = left[more] - 8, at[more] + 8
    return h


def shingles(words: np.ndarray, word_offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's runs of ``size`` words, and their offsets. A text with fewer words has one, of them all."""
    counts = np.diff(word_offsets)
    out = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    at = np.r_[0, np.cumsum(out)]
    first = np.repeat(word_offsets[:-1] - at[:-1], out) + np.arange(at[-1])
    have = np.repeat(np.minimum(counts, size), out)
    padded = np.r_[words, np.zeros(size, np.uint64)]
    h = np.full(int(at[-1]), 0, np.uint64)
    for j in range(size):
        w = padded[first + j]
        h = mix((h + _M1) ^ np.where(have > j, w, np.uint64(0)))
    return h, at
