"""Input paths: files, folders and patterns in any file system that Spark reads, resolved where Spark would look for them."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Partitions of a scan that become one at most.
PACK = 32


@dataclass(frozen=True)
class Input:
    """A given path, its place in the list, the full name as plain() has it, and whether it is one file."""

    given: str
    ord: int
    full: str
    file: bool


def resolve(spark: SparkSession, paths: list[str]) -> tuple[list[Input], list[str]]:
    """The inputs that are there, in order without repeats, and the given paths that match nothing."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found, lost = [], []
    for i, given in enumerate(dict.fromkeys(paths)):
        try:
            path = jvm.org.apache.hadoop.fs.Path(given)
            system = path.getFileSystem(conf)
            there = system.globStatus(path)
        except Py4JJavaError:
            there = None
        if not there:
            lost.append(given)
        elif there[0].isFile() and there[0].getPath().equals(system.makeQualified(path)):
            found.append(Input(given, i, _without_scheme(there[0].getPath().toString()), True))
        else:
            found.append(Input(given, i, given, False))
    return found, lost


def readable(spark: SparkSession, path: str) -> bool:
    """Whether the path matches something."""
    return bool(resolve(spark, [path])[0])


def _without_scheme(name: str) -> str:
    return "/" + name.removeprefix("file:").lstrip("/") if name.startswith("file:") else name


def plain(uri: Column) -> Column:
    """The name of a file from the address in Spark's metadata; local files without a scheme."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def named(read: DataFrame, uri: str, inputs: list[Input]) -> DataFrame:
    """read with path and path_ord in place of column `uri`: single files as they were given, files of a folder by their full names."""
    spark, files = read.sparkSession, [x for x in inputs if x.file]
    if not files:
        return read.select("*", plain(F.col(uri)).alias("path"), F.lit(inputs[0].ord).alias("path_ord")).drop(uri)
    given = spark.createDataFrame([(x.full, x.given, x.ord) for x in files], "_full string, path string, path_ord int")
    return read.withColumn("_full", plain(F.col(uri))).drop(uri).join(given, "_full").drop("_full")


def groups(inputs: list[Input]) -> list[list[Input]]:
    """Inputs that are read together: all single files, and each folder or pattern."""
    files = [x for x in inputs if x.file]
    return [files] * bool(files) + [[x] for x in inputs if not x.file]


def reader(spark: SparkSession, group: list[Input], ending: str | None):
    """A DataFrameReader for a group; in folders it takes the files with an ending, at any depth."""
    read = spark.read
    if not group[0].file and ending:
        read = read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}")
    return read


def packed(read: DataFrame) -> DataFrame:
    """A plain scan; very many partitions, as Spark makes of small files, are put together: up to PACK of them, down to those of a shuffle."""
    parts, least = read.rdd.getNumPartitions(), int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(least, -(-parts // PACK))
    return read.coalesce(wanted) if parts > wanted else read


def system_of(file: str):
    """pyarrow's file system of an address with a scheme, and the name there. OSError or ArrowException if pyarrow knows none."""
    from pyarrow import fs

    if file.startswith("file:"):
        return fs.LocalFileSystem(), "/" + file[5:].lstrip("/")
    return fs.FileSystem.from_uri(quote(file, safe=":/@"))


def opened(file: str):
    """A file by its address in Spark's metadata, opened in a task, where no Spark is. OSError or ArrowException if pyarrow cannot."""
    system, name = system_of(file)
    return system.open_input_file(name)


def address(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark would look for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
