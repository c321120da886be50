"""Text over Arrow columns as numpy arrays: words, spans, 64-bit hashes of spans, all texts of a chunk at once.

Texts are UTF-8 bytes. A word is a longest run of characters other than space, tab, newline, vertical tab, form feed
and carriage return; all of those are ASCII, so words can be found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; it bounds the memory of a task, a longer text makes a chunk of its own.
CHUNK = 1 << 20

U64 = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (or binaries) in a row, and n + 1 offsets. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `limit` bytes together."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, U64), np.full(n, inverse, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 21) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from prefix sums. It depends on the bytes only.

    Sums are made block by block, so that a long text takes little more memory than a block; a span that began in an
    earlier block goes on with the power of its distance.
    """
    out = np.zeros(len(starts), U64)
    for begin in range(0, len(data), block):
        part = data[begin : begin + block]
        up, down = _powers(1 << max(10, (len(part) - 1).bit_length()))
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        if len(part) == len(data):
            out = (total[ends] - total[starts]) * down[np.minimum(starts, len(down) - 1)]
            break
        met = np.flatnonzero((starts < begin + len(part)) & (ends > begin))
        first, last = np.maximum(starts[met] - begin, 0), np.minimum(ends[met] - begin, len(part))
        sums = (total[last] - total[first]) * down[first]
        earlier = np.flatnonzero(starts[met] < begin)
        sums[earlier] *= np.array([pow(_BASE, int(begin - x), 1 << 64) for x in starts[met[earlier]]], U64)
        out[met] += sums
    return mix(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """The words of a chunk: starts and ends in bytes; bounds[i]:bounds[i + 1] are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~BLANK[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        lengths = np.diff(offsets)
        full = lengths > 0
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        begins[first], stops[last] = inside[first], inside[last]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` neighbouring words of one text, and the places of their first words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    total = np.zeros(len(at), U64)
    for k in range(size):
        total = total * U64(0x9E3779B97F4A7C15) + hashes[at + k]
    return mix(total), at


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over each bounds[i]:bounds[i + 1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
