"""Scans: CSV, Parquet tables, remote databases, and the typed load."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import quoted
from tillroll.functions.frames import null_tokens
from tillroll.operators.numbering import number_rows
from tillroll.schemas import EXPORT_COLUMNS, Table
from tillroll.sources.multiline import read_split_csv

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',  # quotes inside a quoted cell are doubled, not backslashed
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
}


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
    **options: Any,
) -> DataFrame:
    """CSV with a header row and doubled quotes; an empty cell is NULL.

    Without a schema every header column is text. Headers are checked against
    the schema, so files whose columns come in another order fail the run
    instead of shifting values. ``multi_line`` allows line breaks inside
    cells, but then a file is one task: keep it for exports of many files, and
    turn it off for huge files whose cells hold no line breaks; those are split. Huge files
    with such cells are for ``read_split_csv``.
    """
    reader = spark.read.options(
        **CSV_OPTIONS, enforceSchema="false", multiLine=str(multi_line).lower(), **options
    )
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_export(
    spark: SparkSession, path: str | list[str], multi_line: bool = True, split: bool = False
) -> DataFrame:
    """The raw order export as text columns plus ``seq``, its source order.

    Columns are taken by header name; others are not read. Missing-value
    tokens become NULL. ``seq`` compares by file, block and row within the
    block, so it does not depend on how Spark packs files into tasks and needs
    no numbering pass. Files compare by their path as text, so number them with
    leading zeros: ``export_10`` comes before ``export_2`` and decides what counts as first.

    ``split`` reads files with line breaks inside cells in as many tasks as they have blocks, at the
    price of a second pass over them.
    """
    if split:
        raw = read_split_csv(spark, path)
        cells = raw.select(*map(quoted, EXPORT_COLUMNS), "seq")
        return null_tokens(cells, EXPORT_COLUMNS)
    seq = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    raw = read_csv(spark, path, multi_line=multi_line)
    return null_tokens(
        raw.select(*map(quoted, EXPORT_COLUMNS), seq.alias("seq")), EXPORT_COLUMNS
    )


def table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalogue table by name, or Parquet files by path."""
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def file_batches(spark: SparkSession, path: str, size: int) -> list[list[str]]:
    """The Parquet files of a folder in groups of at most ``size`` bytes, or of one larger file."""
    files = spark.read.format("binaryFile").load(f"{path}/*.parquet").select("path", "length")
    batches: list[list[str]] = []
    room = 0
    for file, length in sorted(map(tuple, files.collect())):
        if not batches or length > room:
            batches.append([])
            room = size
        batches[-1].append(file)
        room -= length
    return batches


def jdbc_options(
    url: str,
    table_or_query: str,
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int = 8,
    **options: Any,
) -> dict[str, str]:
    """Options of a database scan; with a partition column it reads in parallel.

    A query is passed as a derived table, since Spark does not partition the
    ``query`` option.
    """
    text = table_or_query.strip().rstrip(";")
    is_query = text[:7].lower() in ("select ", "select\n", "select\t")
    built = {"url": url, "dbtable": f"({text}) src" if is_query else text, **options}
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs its lower and upper bound")
        built |= {
            "partitionColumn": partition_column,
            "lowerBound": bounds[0],
            "upperBound": bounds[1],
            "numPartitions": partitions,
        }
    return {k: str(v) for k, v in built.items()}


def read_jdbc(
    spark: SparkSession,
    url: str,
    table_or_query: str,
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int = 8,
    **options: Any,
) -> DataFrame:
    """Rows of a remote table or query; filters and projections are pushed down."""
    chosen = jdbc_options(url, table_or_query, partition_column, bounds, partitions, **options)
    return spark.read.format("jdbc").options(**chosen).load()


def load_table(df: DataFrame, target: Table, strict: bool = True) -> DataFrame:
    """Cast and rename cleaned columns into the target table's columns.

    Accepts the CSV header or the column name. Text over its length fails the
    run, or is left for ``check_length`` with ``strict=False``; a value that its
    type cannot hold fails the run whatever the session's ANSI setting. Amounts are
    rounded half up. A column the input lacks is NULL if the table allows that; a
    numbered one counts the rows from 1 in the order of the others.
    """
    cols = []
    for c in target.columns:
        if c.numbered:
            continue
        if not {c.header, c.name} & set(df.columns) and c.optional:
            cols.append(F.lit(None).cast(c.type).alias(c.name))
            continue
        held = quoted(c.header if c.header in df.columns else c.name)
        value = held.try_cast(c.type)
        unfit = F.concat(F.lit(f"{target.name}.{c.name} cannot hold "), held.cast("string"))
        value = F.coalesce(value, F.when(held.isNotNull(), F.raise_error(unfit).cast(c.type)))
        if strict and c.length:
            too_long = F.raise_error(F.lit(f"{target.name}.{c.name} exceeds {c.length} characters"))
            value = F.when(F.length(value) > c.length, too_long.cast("string")).otherwise(value)
        cols.append(value.alias(c.name))
    loaded = df.select(*cols)
    for c in target.columns:
        if c.numbered:
            loaded = number_rows(loaded, loaded.columns, c.name)
    return loaded.select(*[c.name for c in target.columns])
