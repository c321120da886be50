"""Letters by script, each character looked up once in a table of code points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .arrow import slices
from .text import SCRIPTS

NAMES = (*SCRIPTS, "Other")


@lru_cache(maxsize=1)
def ranges() -> tuple[np.ndarray, np.ndarray]:
    """Starts of ranges of code points, in order, and the script (by its place in NAMES, -1: no letter) of each."""
    every = "".join(map(chr, range(0x110000)))
    kind = np.full(len(every), -1, np.int8)
    known = [(len(SCRIPTS), r"\p{L}+"), *((k, rf"[\p{{L}}&&\p{{Script={s}}}]+") for k, s in enumerate(SCRIPTS))]
    for k, pattern in known:
        for m in regex.finditer(pattern, every, flags=regex.V1):
            kind[m.start() : m.end()] = k
    starts = np.flatnonzero(np.diff(kind, prepend=np.int8(-2)))
    return starts, kind[starts]


def letters(texts: list[str]) -> np.ndarray:
    """A row for each text with the number of its letters of each script of NAMES."""
    starts, kinds = ranges()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    out = np.zeros((len(texts), len(NAMES)), np.int64)
    # ASCII letters are Latin ones; only what is left goes through the search
    plain = points < 128
    ascii_letters = ((points | 32) >= ord("a")) & ((points | 32) <= ord("z")) & plain
    out[:, NAMES.index("Latin")] = np.bincount(owner[ascii_letters], minlength=len(texts))
    rest, of = points[~plain], owner[~plain]
    kind = kinds[np.searchsorted(starts, rest, "right") - 1]
    found = np.bincount(of[kind >= 0] * len(NAMES) + kind[kind >= 0], minlength=out.size)
    return out + found.reshape(out.shape)


def script_counts(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, script, n): the letters of each row's text by script; scripts without letters are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("_text")):
                counts = letters(batch.column("_text").slice(i, j - i).fill_null("").to_pylist())
                row, script = np.nonzero(counts)
                own = [batch.column(k).slice(i, j - i).take(pa.array(row)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.array(NAMES, object)[script], pa.string()), pa.array(counts[row, script])], [*keys, "script", "n"])

    asked = rows.select(*keys, F.col(text).alias("_text"))
    schema = StructType([*(asked.schema[k] for k in keys), StructField("script", StringType()), StructField("n", LongType())])
    return asked.mapInArrow(run, schema)
