"""JSON lines and tables as records: one row for each physical line, with the number of the line and the parsed value."""

from __future__ import annotations

from codecs import BOM_UTF8
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json_values import allow_duplicate_keys, once, tagged, trim, with_document
from .paths import Input, groups, named, opened, packed, reader, resolve

RECORD = ["path", "path_ord", "row", "line", "blank", "valid", "tag", "doc"]


ENDINGS = {"jsonl": ".jsonl", "python": ".py", "parquet": ".parquet"}


def kind_of(path: str) -> str:
    """jsonl, python, parquet or unknown, by the ending of the path (its case matters)."""
    return next((k for k, end in ENDINGS.items() if path.endswith(end)), "unknown")


def read_lines(spark: SparkSession, paths: list[str], ending: str | None = None) -> DataFrame:
    """(path, path_ord, row, line): lines end at a newline only, carriage returns at their ends go; rows count from 1.

    paths: files, folders or patterns, with or without a scheme; of a folder all files, or those with an ending at any
    depth. Row numbers need no global order: a file's splits count their lines, and a small table of these counts by
    split gives the number of lines before each split. A byte-order mark, which Spark's reader takes away, is put back before
    a file's first line (in file systems that pyarrow knows), so that such a line is no JSON value.
    """
    parts = [_lines(spark, group, ending) for group in groups(resolve(spark, paths)[0])]
    return union(parts) if parts else spark.createDataFrame([], "path string, path_ord int, row bigint, line string")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _lines(spark: SparkSession, group: list[Input], ending: str | None) -> DataFrame:
    raw = reader(spark, group, ending).option("lineSep", "\n").text([x.given for x in group])
    raw = packed(raw.select("value", F.col("_metadata.file_path").alias("_uri"), F.col("_metadata.file_block_start").alias("_block")))
    raw = raw.withColumn("_id", F.monotonically_increasing_id())
    blocks = raw.groupBy("_uri", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_uri").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_uri", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    marked = blocks.where("_block = 0").select("_uri").mapInArrow(_marks, "_uri string, _mark string")
    placed = named(raw.join(blocks.join(marked, "_uri", "left"), ["_uri", "_block"]), "_uri", group)
    row = F.col("_id") - F.col("_first") + F.col("_before") + 1
    line = F.concat(F.when(row == 1, F.coalesce("_mark", F.lit(""))).otherwise(""), F.regexp_replace("value", "[\\r\\n]+$", ""))
    return placed.select("path", "path_ord", row.alias("row"), line.alias("line"))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The byte-order mark of each file, or nothing."""
    for batch in batches:
        found = []
        for uri in batch.column("_uri").to_pylist():
            try:
                with opened(unquote(uri)) as stream:
                    found.append("\ufeff" if stream.read(3) == BOM_UTF8 else "")
            except (OSError, pa.ArrowException):  # a file system that only Spark knows
                found.append("")
        yield pa.RecordBatch.from_arrays([batch.column("_uri"), pa.array(found, pa.string())], ["_uri", "_mark"])


def records(lines: DataFrame) -> DataFrame:
    """lines with blank, valid, tag and doc."""
    allow_duplicate_keys(lines.sparkSession)
    parsed = with_document(lines.withColumn("blank", trim(F.col("line")) == ""))
    return parsed.withColumn("valid", F.col("valid") & ~F.col("blank")).select(*RECORD)


def read_jsonl(spark: SparkSession, paths: list[str], ending: str | None = ENDINGS["jsonl"]) -> DataFrame:
    return records(read_lines(spark, paths, ending))


def table_records(df: DataFrame, row: Column, path: str, *columns: str | Column) -> DataFrame:
    """A table's rows as records: path, row and an object of the given columns. Null columns are JSON nulls."""
    members = F.struct(*(columns or df.columns)).alias("_members")
    out = df.select(F.lit(path).alias("path"), F.lit(0).alias("path_ord"), row.cast("bigint").alias("row"), members)
    out = tagged(once(out, doc=F.to_variant_object("_members")))
    return out.select("path", "path_ord", "row", F.lit(None).cast("string").alias("line"), F.lit(False).alias("blank"), F.lit(True).alias("valid"), "tag", "doc")
