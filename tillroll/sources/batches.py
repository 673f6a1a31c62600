"""Appends that may be repeated.

A table of batches holds each batch's rows in a partition ``batch=<id>`` and, beside
its data, one marker per finished batch, written last. What a failed attempt left behind has no marker and is not
read; the next attempt replaces it. A batch that has its marker is not written again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillroll.functions.columns import quoted
from tillroll.markers import publish, published, read_markers
from tillroll.sources.sinks import write_table

BATCH = "batch"


def _rows(path: str) -> str:
    return f"{path}/rows"


def _marker(path: str, batch: str) -> str:
    return f"{path}/finished/{batch}"


def check_batch_id(batch: str) -> str:
    """The id, which has to be a plain name: it is a folder and a file."""
    if not batch or not all(c.isascii() and (c.isalnum() or c in "-_") for c in batch):
        raise ValueError(f"a batch id is letters, digits, - and _: {batch!r}")
    return batch


def check_columns(df: DataFrame) -> None:
    if BATCH in map(str.lower, df.columns):
        raise ValueError(f"the column {BATCH} is the table's own")


def is_finished(spark: SparkSession, path: str, batch: str) -> bool:
    return published(spark, _marker(path, check_batch_id(batch)))


def write_batch(df: DataFrame, path: str, batch: str, partition_by: Sequence[str] = ()) -> None:
    """Write, or replace, the rows of a batch that is not finished."""
    check_columns(df)
    tagged = df.withColumn(BATCH, F.lit(check_batch_id(batch)))
    write_table(tagged, _rows(path), [BATCH, *partition_by], replace_partitions=True)


def finish_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Let the batch be read; false if another attempt has finished it."""
    text = json.dumps({BATCH: check_batch_id(batch), "columns": df.schema.json()})
    return publish(df.sparkSession, _marker(path, batch), text)


def append_batch(df: DataFrame, path: str, batch: str, partition_by: Sequence[str] = ()) -> bool:
    """Append a batch's rows once, however often it is tried; false if it was finished before.

    One attempt at a batch at a time; different batches may be appended side by side.
    Columns have to agree with the table's in name, type and order.
    """
    spark = df.sparkSession
    check_columns(df)
    if is_finished(spark, path, batch):
        return False
    held = columns_of(spark, path)
    if held is not None and _types(held) != _types(df.schema):
        raise ValueError(f"the table holds {_types(held)}, not {_types(df.schema)}")
    write_batch(df, path, batch, partition_by)
    return finish_batch(df, path, batch)


def _types(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


def columns_of(spark: SparkSession, path: str) -> StructType | None:
    """The table's columns, from one of its markers; none before the first batch."""
    first = read_markers(spark, f"{path}/finished").first()
    return first and StructType.fromJson(json.loads(json.loads(first["value"])["columns"]))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished batches, without the batch.

    The finished batches are a small table of their own, one row each, so only their partitions are
    read, however many there are.
    """
    columns = columns_of(spark, path)
    if columns is None:
        raise ValueError(f"no finished batch in {path}")
    # the types are given, as a folder's name may look like a number
    stored = StructType([*columns.fields, StructField(BATCH, StringType())])
    rows = spark.read.schema(stored).parquet(_rows(path))
    found = F.from_json("value", f"{BATCH} string")[BATCH]
    finished = read_markers(spark, f"{path}/finished").select(found.alias(BATCH)).distinct()
    return rows.join(finished, BATCH, "left_semi").select(*map(quoted, columns.names))
