"""Fixes: line insertions that findings carry, applied to the files."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import batched
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import address
from .files import read, replace, replace_local

#: Files that the driver writes at once.
AT_ONCE = 16
#: Bytes that are no UTF-8 come back as they were.
AS_IS = ("utf-8", "surrogateescape")


@dataclass
class Applied:
    files: int = 0
    edits: int = 0


def edits_of(found: DataFrame) -> DataFrame:
    """(path, line, insert): different edits of all findings."""
    return found.where("fix IS NOT NULL").select("path", F.explode("fix.edits").alias("e")).select("path", "e.line", "e.insert").distinct()


def inserted(source: str, edits: list[tuple[int, str]]) -> str:
    """source with lines inserted before the given 1-based lines; behind the last line if there are fewer. All else stays."""
    new: dict[int, list[str]] = {}
    lines = source.split("\n")
    for line, text in sorted(edits):
        new.setdefault(min(max(line, 1), len(lines) + 1), []).append(text.rstrip("\n"))
    return "\n".join(x for n, old in enumerate([*lines, None], 1) for x in (*new.get(n, ()), *(() if old is None else (old,))))


def _fixed(content: bytes, edits: list[tuple[int, str]]) -> bytes:
    return inserted(content.decode(*AS_IS), edits).encode(*AS_IS)


def _contents(batches):
    """(local, content, edits): the files of the rows as they will be, and how many edits that takes. Nothing is written."""
    for batch in batches:
        names, edits, found = batch.column("local").to_pylist(), batch.column("edits").to_pylist(), []
        for name, own in zip(names, edits, strict=True):
            with open(name, "rb") as old:
                found.append(_fixed(old.read(), [(e["line"], e["insert"]) for e in own]))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found, pa.binary()), pa.array([len(e) for e in edits], pa.int64())], ["local", "content", "edits"])


def _written(batches):
    for batch in batches:
        for name, content in zip(batch.column("local").to_pylist(), batch.column("content").to_pylist(), strict=True):
            replace_local(name, content)
        yield pa.RecordBatch.from_arrays([batch.column("edits")], ["edits"])


def _local(spark: SparkSession) -> Column:
    """The full name of a path in the local file system, else null."""
    name, here = F.regexp_replace("path", "^file:/+", "/"), address(spark, ".")
    if not here.startswith("file:"):
        return F.when(F.col("path").startswith("file:"), name)
    here = "/" + here.removeprefix("file:").strip("/") + "/"
    return F.when(F.col("path").rlike("^(file:)?/"), name).when(~F.col("path").rlike("^[A-Za-z][A-Za-z0-9+.-]+:"), F.concat(F.lit(here), "path"))


def apply(found: DataFrame) -> Applied:
    """Writes the fixed files in place, in any file system that Spark reads, each of them whole.

    Local files, which all tasks see if Spark reads them, are written by tasks; others by the driver through Spark's file system, some
    at a time. Edits and new contents are kept before the first file is changed (if they are lost, the run fails), so a task that runs
    again writes the same once more and inserts nothing twice.
    """
    spark = found.sparkSession
    edits = edits_of(found).groupBy("path").agg(F.collect_list(F.struct("line", "insert")).alias("edits")).select("path", _local(spark).alias("local"), "edits").localCheckpoint()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that many small rows are not put together
    new = edits.where("local IS NOT NULL").select("local", "edits").repartition(tasks, "local").mapInArrow(_contents, "local string, content binary, edits long").localCheckpoint()
    n = new.mapInArrow(_written, "edits long").agg(F.count("*").alias("files"), F.coalesce(F.sum("edits"), F.lit(0)).alias("edits")).collect()[0]
    done = Applied(n.files, n.edits)
    with ThreadPool(AT_ONCE) as pool:
        for some in batched(edits.where("local IS NULL").toLocalIterator(), AT_ONCE):
            pool.map(lambda r: replace(spark, r.path, _fixed(read(spark, r.path), [(e.line, e.insert) for e in r.edits])), some)
            done.files, done.edits = done.files + len(some), done.edits + sum(len(r.edits) for r in some)
    return done
