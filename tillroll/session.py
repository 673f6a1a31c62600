"""Session set-up and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tillroll", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Every join in the package is left to adaptive execution: it broadcasts a
    side only after measuring it, and splits a hot key of a shuffled join.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        # a text that gives a key twice is parsed in one go; elsewhere element by element
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tillroll-"))
    return sc.getCheckpointDir()


def staging_dir(spark: SparkSession) -> str:
    """The application's own folder below the shared one."""
    return f"{shared_dir(spark)}/tillroll-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's folder."""
    return f"{staging_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_staging(spark: SparkSession) -> None:
    """Delete all that the application has staged: the last step of a job, when every result
    that still reads a staged table, such as numbered rows, has been written."""
    delete_path(spark, staging_dir(spark))


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    The table stays until the application's folder is deleted; see ``staged``.
    """
    return _stage(df, fresh_path(df.sparkSession, label))


def _stage(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """A staged table for the duration of a ``with`` block, deleted behind it.

    What reads it has to be written, or collected, inside the block.
    """
    path = fresh_path(df.sparkSession, label)
    try:
        yield _stage(df, path)
    finally:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever that is."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)
