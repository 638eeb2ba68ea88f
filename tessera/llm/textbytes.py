"""Vectorised helpers over Arrow text columns: whole texts as one byte buffer.

Everything here works on one Arrow batch inside a task. Spark deals out the
rows; these functions only turn a batch into numpy arrays of hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 5
#: Bytes of text that are hashed at once; the arrays of a slice hold some eighty times as many.
SLICE = 1 << 18
_tables = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _grow(first: np.ndarray, base: int, n: int) -> np.ndarray:
    out = first
    while len(out) < n:
        step = np.uint64(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each at least."""
    if len(_tables["pow"]) < n:
        _tables["pow"] = _grow(_tables["pow"], _BASE, n)
        _tables["inv"] = _grow(_tables["inv"], pow(_BASE, -1, 1 << 64), n)
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each bit of the input over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column and the offsets of each; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE):
    """Ranges of rows with at most so many bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any substring in constant time, see span_hash."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), for spans of some 200 bytes at most: a sum of powers modulo 2**64 can't tell some spans of 1,024 apart."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


#: Bytes of a span that one sum of powers covers in long_hash.
_BLOCK = 32


def long_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of any length: each block of a span is finalised together with its place before blocks are summed."""
    size = end - start
    blocks = np.maximum(1, -(-size // _BLOCK))
    first = np.cumsum(blocks) - blocks
    span = np.repeat(np.arange(len(start)), blocks)
    place = np.arange(int(blocks.sum())) - first[span]
    begin = start[span] + _BLOCK * place
    each = span_hash(sums, begin, np.minimum(begin + _BLOCK, end[span]))
    each = mix(each + (place + 1).astype(np.uint64) * np.uint64(_BASE))
    return mix((np.add.reduceat(each, first) if len(first) else each) + size.astype(np.uint64))


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k bytes from each position."""
    _, down = powers(len(sums))
    n = max(0, len(sums) - k)
    return mix((sums[k:] - sums[:n]) * down[:n])


def sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """choose (np.minimum or np.maximum) over each run of width values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = choose(out[:-step] if step else out, out[step:])
        have += step
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return _LOWER[data]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than x20, x09-x0D) of lowered texts and the row of each."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edge[edge > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return long_hash(prefix_sums(data), start, end), row


def runs_of(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of n rows in a sorted list of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))
