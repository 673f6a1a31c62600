"""Small files in the shared folder that exactly one writer can create.

A marker appears at once and whole, or not at all: its content is written beside it and then
given its name by a step that never replaces a file. That is a rename on HDFS and a hard link on a local disk.
A store whose rename replaces files, as most object stores do, is refused.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

ATOMIC_RENAME = ("hdfs", "viewfs")


def _file_system(spark: SparkSession, path: str):
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), held


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` holding ``text``; false if it is there already."""
    jvm = spark.sparkContext._jvm
    fs, target = _file_system(spark, path)
    scheme = fs.getUri().getScheme()
    if scheme != "file" and scheme not in ATOMIC_RENAME:
        raise ValueError(f"markers need a file system whose rename replaces nothing, not {scheme}")
    if fs.exists(target):
        return False
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if scheme != "file":
            return fs.rename(draft, target)
        files = jvm.java.nio.file.Files
        place = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)]
        files.createLink(*place)
        return True
    except Py4JJavaError as failure:
        if failure.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    finally:
        fs.delete(draft, False)


def published(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The markers of a folder, by name."""
    fs, held = _file_system(spark, folder)
    if not fs.exists(held):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(held)]
    return sorted(n for n in found if not n.startswith("."))


def read_markers(spark: SparkSession, folder: str) -> DataFrame:
    """``value``: one row per line of the folder's markers."""
    if not names(spark, folder):
        return spark.createDataFrame([], "value string")
    return spark.read.text(folder)
