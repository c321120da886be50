"""MinHash signatures of whole batches of texts.

Spark lowers the texts and batches make all white space single blanks, so a shingle of three words is a slice of the text's bytes. Its
value is the first 32 bits of its MD5, which is worked out for many shingles at a time; the 128 coordinates of all texts of a chunk
are then made one coordinate at a time, as the minima of runs of values. A text is never spread over rows, and no shingle leaves the batch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .arrow import slices, text_bytes
from .json_values import SPACES
from .text import HASHES, PRIME, SHINGLE, coefficients

#: Texts of about so many bytes are signed at once, and so many shingles hashed, so that what is worked on stays in a core's cache.
SIGNED, HASHED = 1 << 18, 1 << 14
#: Bytes that fit one block of MD5 with its mark and length.
ONE_BLOCK = 55
#: White space by byte, and that of several bytes.
_BLANK = np.isin(np.arange(256), [ord(c) for c in SPACES if ord(c) < 128])
_WIDE = [np.frombuffer(c.encode(), np.uint8) for c in SPACES if ord(c) >= 128]
_P, _P32, _BITS = np.uint64(PRIME), np.uint32(PRIME), np.uint64(31)
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
# by how many bytes of a message are left for a word, from none with the mark before (-1) to four: what stays of the word, and the mark
_KEPT = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_MARK = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)


def _folded(v: np.ndarray) -> np.ndarray:
    """v modulo PRIME, which is 2 ** 31 - 1, for v below PRIME ** 2: high bits are added to low ones, which makes less than 2 * PRIME."""
    low = v.astype(np.uint32)
    low &= _P32
    low += (v >> _BITS).astype(np.uint32)
    return np.minimum(low, low - _P32)  # below PRIME the difference is negative, so it wraps and is larger


def _md5_heads(words: list[np.ndarray], length: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of messages of one block: their marked words, and their lengths in bytes."""
    words = dict(enumerate(words)) | {14: length.astype(np.uint32) << np.uint32(3)}
    a, b, c, d = (np.full(len(length), x) for x in _START)
    for i in range(61):  # the last three steps make the other bytes
        if i < 16:
            f, k = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, k = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, k = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, k = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _ADDED[i]
        if k in words:  # words that no message reaches are 0
            f += words[k]
        turn = _TURNS[i // 16][i % 4]
        high = f >> np.uint32(32 - turn)
        f <<= np.uint32(turn)
        f |= high
        f += b
        a, b, c, d = d, f, b, c
    return (b + _START[0]).byteswap()


def md5_heads(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of each run of bytes; those of one block are hashed many at a time."""
    length = last - first
    out = np.empty(len(first), np.uint32)
    longer = np.flatnonzero(length > ONE_BLOCK)
    raw = data.tobytes() if len(longer) else b""
    heads = [hashlib.md5(raw[a:b], usedforsecurity=False).digest()[:4] for a, b in zip(first[longer].tolist(), last[longer].tolist(), strict=True)]
    out[longer] = np.frombuffer(b"".join(heads), ">u4")
    padded = np.concatenate([data, np.zeros(ONE_BLOCK + 4, np.uint8)])
    word = padded[3:].astype(np.uint32)  # the four bytes from each place on
    for k in (2, 1, 0):
        word <<= np.uint32(8)
        word |= padded[k : len(padded) - 3 + k]
    rest = np.flatnonzero(length <= ONE_BLOCK)
    for at in range(0, len(rest), HASHED):
        own = rest[at : at + HASHED]
        begin, size, words = first[own], length[own], []
        for k in range(0, int(size.max()) + 1, 4):
            left = np.clip(size - (k - 1), 0, 5)
            words.append(word[begin + k] & _KEPT[left] | _MARK[left])
        out[own] = _md5_heads(words, size)
    return out


def single_blanks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 texts, given as by text_bytes, with a single blank for each run of white space."""
    blank = _BLANK[data]
    for space in _WIDE:
        if len(lead := np.flatnonzero(data[: len(data) - len(space) + 1] == space[0])):
            for k in range(1, len(space)):
                lead = lead[data[lead + k] == space[k]]
            for k in range(len(space)):
                blank[lead + k] = True
    out, kept = np.where(blank, np.uint8(32), data), ~blank
    kept[1:] |= ~blank[:-1]
    kept[:1] = True
    if kept.all():
        return out, at
    return out[kept], np.concatenate([[0], np.cumsum(kept)])[at]


def shingle_values(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all shingles of texts with single blanks between words, and the text that each is of."""
    word = data != 32
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = at[:-1][at[:-1] < at[1:]]
    begins[edge] = word[edge]
    edge = at[1:][at[:-1] < at[1:]] - 1
    ends[edge] = word[edge]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(at, first, "right") - 1
    n = max(0, len(first) - SHINGLE + 1)
    whole = np.flatnonzero(owner[:n] == owner[SHINGLE - 1 :]) if n else np.zeros(0, np.int64)
    return md5_heads(data, first[whole], last[whole + SHINGLE - 1]), owner[whole]


def signed(data: np.ndarray, at: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have a shingle, and their signatures as rows."""
    values, owner = shingle_values(data, at)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    out = np.empty((HASHES, len(starts)), np.int64)
    values = values.astype(np.uint64) % _P
    if len(starts):
        for k, (a, b) in enumerate(coefficients(seed)):
            v = values * np.uint64(a)
            v += np.uint64(b)
            out[k] = np.minimum.reduceat(_folded(v), starts)
    return owner[starts], np.ascontiguousarray(out.T)


def signatures(texts: DataFrame, id_column: str = "id", text_column: str = "text", seed: int = 0, every: bool = False) -> DataFrame:
    """(id, signature): MinHash of the shingles; ids without a shingle have none, or with `every` a null one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text"), SIGNED):
                rows, found = signed(*single_blanks(*text_bytes(batch.column("text").slice(i, j - i))), seed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * HASHES, pa.int32()), pa.array(found.reshape(-1)))
                ids = batch.column("id").slice(i, j - i)
                if every:
                    place = np.full(j - i, -1)
                    place[rows] = np.arange(len(rows))
                    lists = lists.take(pa.array(place, mask=place < 0))
                yield pa.RecordBatch.from_arrays([ids if every else ids.take(pa.array(rows)), lists], ["id", "signature"])

    # nulls go by the column as it is, as a filter on the lowered text would lower it once more
    plain = texts.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.lower(F.col(text_column)).alias("text"))
    return plain.mapInArrow(run, StructType([plain.schema["id"], StructField("signature", ArrayType(LongType()))]))
