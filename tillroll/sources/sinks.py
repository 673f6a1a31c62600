"""Sinks: CSV folders, Parquet tables, appends and report marts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import quoted


CSV_ROWS = 65_536
"""Rows in a CSV file at most: where cells may hold line breaks, a file is one task for its reader."""


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite a folder of CSV part files with header and no row index.

    A task that writes more than ``CSV_ROWS`` rows makes several files, in the order of their names.
    """
    (
        df.write.mode("overwrite")
        .options(
            header="true",
            maxRecordsPerFile=CSV_ROWS,
            quote='"',
            escape='"',
            timestampNTZFormat="yyyy-MM-dd HH:mm:ss",
            ignoreLeadingWhiteSpace="false",  # blanks at the ends are part of a name
            ignoreTrailingWhiteSpace="false",
        )
        .csv(path)
    )


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), replace_partitions: bool = False
) -> None:
    """Overwrite a Parquet table, or only the partitions present in ``df``."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if replace_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def partition_columns(df: DataFrame, path: str) -> list[str]:
    """The columns a stored table is partitioned by, from the folder of one of its files."""
    first = df.sparkSession.read.parquet(path).select("_metadata.file_path").limit(1).collect()
    if not first:
        return []
    folders = unquote(first[0][0]).rstrip("/").split("/")[:-1]
    named = [f.split("=", 1)[0] for f in folders if "=" in f]
    outer = [f.split("=", 1)[0] for f in path.rstrip("/").split("/") if "=" in f]
    return [unquote(n) for n in named[len(outer) :]]


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a Parquet table; columns of the table not in ``df`` become NULL.

    ``partition_by`` has to be how the table is stored: files beside the partition
    folders, or folders in a plain table, would not be read back.
    """
    stored = partition_columns(df, path)
    if stored and stored != list(partition_by):
        raise ValueError(f"the table is partitioned by {stored}, not by {list(partition_by)}")
    held = df.sparkSession.read.parquet(path)
    if not stored and partition_by and not held.isEmpty():
        raise ValueError(f"the table is not partitioned, not by {list(partition_by)}")
    held = held.schema
    unknown = set(df.columns) - set(held.names)
    if unknown:
        raise ValueError(f"not in the table: {sorted(unknown)}")
    cols = [
        (quoted(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in held
    ]
    df.select(*cols).write.mode("append").partitionBy(*partition_by).parquet(path)


def write_all(
    tables: Mapping[str, DataFrame],
    out: str,
    write: Callable[[DataFrame, str], None] = write_table,
) -> None:
    """Write each frame to ``out/<name>``; the writes run side by side."""
    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(lambda name: write(tables[name], f"{out}/{name}"), tables))


def write_marts(marts: Mapping[str, DataFrame], out: str) -> None:
    """Write each report's rows to ``out/<report>``, replacing the last refresh."""
    write_all(marts, out)
