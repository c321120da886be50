"""Quality rules on every whole text: word and line rules, then compression bands.

The bands: zstandard ratios (compressed by raw bytes) of the whole text and of its chunks of CHUNK bytes. Text that
repeats itself falls below the band of its length, text without structure rises above it. Short texts compress less,
so each length has limits of its own, and texts under the first length are not judged.

Edge cases: a null text has no words and is an empty one; it fails the base rule (n_words < 50). Rows are judged one by
one, so repeated doc_ids or texts each give a row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_batches
from .textkit import U64, Words, chunks, mix, per_text, repeated, span_hash, windows

#: (bytes at least, least ratio, greatest ratio) of a whole text.
WHOLE_BANDS = ((64, 0.35, 1.25), (256, 0.35, 0.90), (1024, 0.33, 0.72), (4096, 0.30, 0.68), (16384, 0.27, 0.66), (65536, 0.24, 0.65))
CHUNK = 4096
#: (bytes at least, least, greatest ratio) of a chunk; a last chunk under the first length is not judged.
CHUNK_BANDS = ((1024, 0.30, 0.75), (4096, 0.28, 0.72))
#: A text is rejected if more than this share of its judged chunks lies outside the bands.
BAD_CHUNKS = 0.34
LEVEL = 3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, whole_ratio double, min_chunk_ratio double, max_chunk_ratio double"
)


def _outside(ratios: np.ndarray, lengths: np.ndarray, bands: tuple) -> np.ndarray:
    at = np.searchsorted([b[0] for b in bands], lengths, "right") - 1
    low, high = np.array([b[1] for b in bands])[at], np.array([b[2] for b in bands])[at]
    return (at >= 0) & ((ratios < low) | (ratios > high))


def compression(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: ratio of the whole (0 if empty), least and greatest ratio of its chunks, and whether it lies in the bands."""
    z, raw, n = zstandard.ZstdCompressor(level=LEVEL), memoryview(data), len(offsets) - 1
    lengths = np.diff(offsets)
    whole = np.array([len(z.compress(raw[a:b])) / (b - a) if b > a else 0.0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    counts = np.maximum(1, -(-lengths // CHUNK))
    owner = np.repeat(np.arange(n), counts)
    starts = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * CHUNK
    ends = np.minimum(starts + CHUNK, offsets[1:][owner])
    alone = counts[owner] == 1
    ratios = np.array([whole[i] if one else len(z.compress(raw[a:b])) / (b - a) for i, one, a, b in zip(owner, alone, starts, ends, strict=True)])
    judged = ends - starts >= CHUNK_BANDS[0][0]
    bad = np.bincount(owner, _outside(ratios, ends - starts, CHUNK_BANDS), n) > BAD_CHUNKS * np.bincount(owner, judged, n)
    shown = judged | alone
    low, high = np.full(n, np.inf), np.zeros(n)
    np.minimum.at(low, owner[shown], ratios[shown])
    np.maximum.at(high, owner[shown], ratios[shown])
    return whole, np.where(np.isinf(low), 0, low), high, ~(_outside(whole, lengths, WHOLE_BANDS) | bad)


def line_repeats(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Per text: the lines with a word that equal an earlier line."""
    newlines, owner = np.flatnonzero(data == 10), words.owner()
    before = np.searchsorted(newlines, words.starts)
    first = np.ones(len(owner), bool)
    first[1:] = (before[1:] != before[:-1]) | (owner[1:] != owner[:-1])
    before, owner = before[first], owner[first]
    edges = np.concatenate([[-1], newlines, [len(data)]])
    starts, ends = np.maximum(edges[before] + 1, offsets[owner]), np.minimum(edges[before + 1], offsets[owner + 1])
    keys = span_hash(data, starts, ends) ^ mix(owner.astype(U64) + U64(1))
    order = np.argsort(keys, kind="stable")
    return np.bincount(owner[order[1:][keys[order[1:]] == keys[order[:-1]]]], minlength=len(offsets) - 1)


def _judge(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts = []
    for _, _, data, offsets in chunks(batch.column("text")):
        words = Words(data, offsets)
        owner, bounds = words.owner(), words.bounds
        hashes = span_hash(data, words.starts, words.ends) + mix(owner.astype(U64) + U64(7))
        keys, at = windows(hashes, owner, 3)
        marked = np.zeros(len(hashes), bool)
        for k in range(3):
            marked[at[repeated(keys)] + k] = True
        lead = words.inside & ((data & 0xC0) != 0x80)
        n_words, n_repeat = words.counts, per_text(marked, bounds)
        failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
        whole, low, high, inside = compression(data, offsets)
        parts.append(
            (n_words, per_text(lead, offsets), per_text(SYMBOLS[data], offsets), line_repeats(data, offsets, words), n_repeat, failed, ~failed & inside, whole, low, high)
        )
    columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row per document with its counts, the base rule's and the compression bands' verdicts, and the ratios."""
    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), _judge, SCHEMA)
