"""Arrow columns as numpy arrays, and runs of whole groups of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column one after another, and where each begins and the last ends. Nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def slices(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(first row, row behind the last) of runs of rows with about `limit` bytes of text."""
    at, start = text_bytes(column)[1], 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield start, stop
        start = stop


def starts_of(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows of a sorted batch at which a new group begins."""
    columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew, so that no group lies in two of them; the batches of one group wait until it ends."""
    waiting: list[pa.RecordBatch] = []
    for batch in (b for b in batches if b.num_rows):
        begin = starts_of(batch, keys)
        goes_on = bool(waiting) and all(waiting[-1].column(k)[-1] == batch.column(k)[0] for k in keys)
        if waiting and not goes_on:
            yield _joined(waiting)
            waiting = []
        if goes_on and len(begin) > 1:
            yield _joined([*waiting, batch.slice(0, int(begin[1]))])
            batch, waiting = batch.slice(int(begin[1])), []
            begin = begin[1:] - begin[1]
        if len(begin) > 1 and not waiting:
            yield batch.slice(0, int(begin[-1]))
            batch = batch.slice(int(begin[-1]))
        waiting.append(batch)
    if waiting:
        yield _joined(waiting)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def dealt(scan: DataFrame, key: str) -> DataFrame:
    """A plain scan; if it has fewer partitions than a shuffle of the session (one large row group, say), its rows dealt by a key.

    For work that takes longer than moving the rows. Not for a DataFrame with shuffles, which counting its partitions would run.
    """
    wanted = int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scan.repartition(wanted, key) if scan.rdd.getNumPartitions() < wanted else scan
