"""Tables of the session's catalogue that keep to their definitions.

The columns have their declared types, texts as ``VARCHAR(n)``, so a write of too long a text or too
large an amount is refused by Spark. Parquet tables know no required columns;
``store_rows`` refuses a missing value as it writes. Tables may be laid out in buckets of a
key, sorted: joins on that key of tables with as many buckets need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.columns import quoted
from tillroll.schemas import Table
from tillroll.sources.readers import load_table


def declared_type(target: Table, name: str) -> str:
    column = next(c for c in target.columns if c.name == name)
    return f"varchar({column.length})" if column.length else column.type


def declare_table(
    spark: SparkSession,
    target: Table,
    name: str,
    path: str,
    bucket_by: str | None = None,
    buckets: int | None = None,
) -> None:
    """Create an empty table ``name`` at ``path`` with the columns of its definition.

    With ``bucket_by`` its files are bucketed and sorted by that column, by default
    in as many buckets as there are shuffle partitions.
    """
    columns = ", ".join(f"`{c.name}` {declared_type(target, c.name)}" for c in target.columns)
    layout = ""
    if bucket_by is not None:
        count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        layout = f"CLUSTERED BY (`{bucket_by}`) SORTED BY (`{bucket_by}`) INTO {count} BUCKETS"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet {layout} LOCATION '{place}'")


def _buckets(spark: SparkSession, name: str) -> tuple[str, int] | None:
    """Column and number of a table's buckets."""
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED `{name}`").collect()}
    if "Num Buckets" not in told:
        return None
    return told["Bucket Columns"].strip("[]`"), int(told["Num Buckets"])


def required_values(df: DataFrame, target: Table) -> DataFrame:
    """The rows, failing the run where a required value is missing."""
    cols = []
    for c in target.columns:
        held = quoted(c.name)
        if c.required:
            missing = F.raise_error(F.lit(f"{target.name}.{c.name} is missing")).cast(c.type)
            held = F.coalesce(held, missing)
        cols.append(held.alias(c.name))
    return df.select(*cols)


def store_rows(df: DataFrame, target: Table, name: str) -> None:
    """Append cleaned rows to a declared table.

    Headers and types are taken as in ``load_table``; lengths are left to the table. A bucketed table
    gets one file per bucket.
    """
    spark = df.sparkSession
    rows = required_values(load_table(df, target, strict=False), target)
    layout = _buckets(spark, name)
    if layout is not None:
        rows = rows.repartition(layout[1], quoted(layout[0]))
    rows.write.insertInto(name)
