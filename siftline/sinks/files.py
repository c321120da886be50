"""Small files: single ones in any file system that Spark reads, from the driver: read whole, written whole, replaced; many ones in tasks."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import system_of


def _at(spark: SparkSession, name: str):
    """The path and a file system of its own for it, which leaves no files of checksums beside what it writes."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(name)
    system = hadoop.FileSystem.newInstance(path.toUri(), spark._jsc.hadoopConfiguration())
    system.setWriteChecksum(False)
    return path, system


def read(spark: SparkSession, name: str) -> bytes:
    path, system = _at(spark, name)
    stream = system.open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()
        system.close()


def put(spark: SparkSession, name: str, content: bytes) -> None:
    path, system = _at(spark, name)
    out = system.create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
        system.close()


def replace(spark: SparkSession, name: str, content: bytes) -> None:
    """Puts content in the place of a file, whole or not at all: it is written beside it, with its permissions, and renamed over it.

    Where a file system does not rename over a file, the old one goes aside until the new one is in its place.
    """
    put(spark, f"{name}.fixed", content)
    path, system = _at(spark, name)
    new, aside = (spark._jvm.org.apache.hadoop.fs.Path(f"{name}{end}") for end in (".fixed", ".old"))
    system.setPermission(new, system.getFileStatus(path).getPermission())
    try:
        if not _renamed(system, new, path):
            if not (system.rename(path, aside) and system.rename(new, path)):
                raise OSError(f"cannot replace {name}; the fixed file is {name}.fixed")
            system.delete(aside, False)
    finally:
        system.close()


def _renamed(system, new, path) -> bool:
    try:
        return system.rename(new, path)
    except Py4JJavaError:  # FileAlreadyExistsException
        return False


def put_all(files: DataFrame, folder: str) -> None:
    """files: (name, content), the different names of files below a folder, given with its scheme, and their texts. Tasks write them.

    A file is written under a name that readers pass over, then renamed, so a task that is lost or run twice leaves whole files.
    OSError or ArrowException if pyarrow does not know the file system.
    """
    system_of(folder)

    def run(batches):
        (system, at), made = system_of(folder), set()
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                above, own = os.path.split(f"{at}/{name}")
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                new = f"{above}/.{own}.{uuid.uuid4().hex}"
                with system.open_output_stream(new) as out:
                    out.write(content.encode())
                system.move(new, f"{above}/{own}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def replace_local(name: str, content: bytes) -> None:
    """As replace, in a task, for a file of the local file system (or one that is mounted), without scheme."""
    above, own = os.path.split(name)
    new = f"{above}/.{own}.{uuid.uuid4().hex}"
    with open(new, "wb") as out:
        out.write(content)
    os.chmod(new, os.stat(name).st_mode & 0o7777)
    try:
        os.remove(f"{above}/.{own}.crc")  # Hadoop's checksums of the old file
    except FileNotFoundError:
        pass
    os.replace(new, name)
