"""Parquet row groups from file footers; no row data is read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import ENDINGS, union
from .paths import groups, named, opened, reader, resolve

GROUPS = "path string, idx int, num_rows bigint, error string"


def read_row_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, idx, num_rows, error) of every row group of every file, of folders those of all their Parquet files.

    A file that is no Parquet has no row groups. A file that cannot be reached has one row with the error, and so has a
    given path that matches nothing.
    """
    found, lost = resolve(spark, paths)
    out = spark.createDataFrame([(p, None, None, "no such file") for p in lost], GROUPS)
    for group in groups(found):
        files = reader(spark, group, ENDINGS["parquet"]).format("binaryFile").load([x.given for x in group])
        listed = named(files.select(F.col("_metadata.file_path").alias("_uri"), F.col("path").alias("file")), "_uri", group)
        out = out.unionByName(listed.select("path", "file").mapInArrow(_footers, GROUPS))
    return out


def _footers(batches):
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for path, file in zip(*(batch.column(c).to_pylist() for c in ("path", "file")), strict=True):
            try:
                stream = opened(file)
            except (OSError, pa.ArrowException) as e:
                rows.append((path, None, None, str(e)[:200]))
                continue
            with stream:
                try:
                    meta = pq.ParquetFile(stream).metadata
                except (OSError, pa.ArrowException):
                    continue
                rows += [(path, i, meta.row_group(i).num_rows, None) for i in range(meta.num_row_groups)]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in GROUPS.split(", ")])
