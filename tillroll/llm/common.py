"""What the operators share: table scans, byte views of texts, staged tables."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.columns import quoted
from tillroll.session import delete_path, fresh_path, stage_table

__all__ = [
    "Rounds", "body", "fresh_name", "hash_sample", "paired", "scan", "small_hash", "stage_table",
    "text_hash", "texts_of",
]


class Rounds:
    """Staged tables of a loop, of which only the last is kept."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self._spark, self._label, self._path = spark, label, None

    def stage(self, df: DataFrame) -> DataFrame:
        """Write the next round's table, and delete the last one's, which it was made from."""
        path = fresh_path(self._spark, self._label)
        df.write.parquet(path)
        self.clear()
        self._path = path
        return self._spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        if self._path:
            delete_path(self._spark, self._path)
            self._path = None


def _reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it;
    on a cluster it is passed along with ``--py-files`` or installed."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    held = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in held:
        environment["PYTHONPATH"] = os.pathsep.join([root, *held])


def scan(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """One of the given tables, whole."""
    _reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(text: Column | str = "text") -> Column:
    """The whole text; a null text is the empty text."""
    return F.coalesce(quoted(text) if isinstance(text, str) else text, F.lit(""))


def text_hash(text: Column | str = "text") -> Column:
    """64-bit hash of the text; with ``doc_id`` it names a row's content."""
    return F.xxhash64(body(text))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A batch's texts as UTF-8 bytes; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """``(doc_ids, texts)`` per batch of a ``doc_id, text`` frame."""
    for batch in batches:
        yield batch.column(batch.schema.get_field_index("doc_id")), texts_of(batch)


def hash_sample(df: DataFrame, by: Sequence[str], size: int, total: int) -> DataFrame:
    """The ``size`` rows of the smallest hash of the columns ``by``, or rarely some fewer.

    ``total`` is about how many rows there are. A bound on the hash leaves about four times
    the sample, so that the sort behind it does not gather ``size`` rows of every partition.
    """
    key = F.xxhash64(*[quoted(c) for c in by])
    return df.where(small_hash(by, size, total)).orderBy(key, *[quoted(c) for c in by]).limit(size)


def small_hash(by: Sequence[str], size: int, total: int) -> Column:
    """True for about ``4 * size`` of ``total`` rows, those of the smallest hashes."""
    bound = min((1 << 63) - 1, (4 * size << 64) // max(1, total) - (1 << 63))
    return F.xxhash64(*[quoted(c) for c in by]) <= F.lit(bound)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name
