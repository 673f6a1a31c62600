"""Duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import collated, quoted


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows of the frame, or of a projection of it."""
    return (df.select(*map(quoted, cols)) if cols else df).distinct()


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row per key in ``order_by`` order; NULL keys form one group.

    ``order_by`` has to be unique within a key. Spark limits each input
    partition to one row per key before the shuffle (WindowGroupLimit), so a
    key with very many rows arrives as one row per input partition.
    """
    first = Window.partitionBy(*map(quoted, keys)).orderBy(*map(quoted, order_by))
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def merge_spellings(
    df: DataFrame, col: str, total: str | None, collation: str | None
) -> DataFrame:
    """Merge rows whose ``col`` is equal under the collation, adding up ``total``.

    The smallest spelling is shown. A collated grouping cannot be hashed and
    has to sort, so pass rows that are grouped by exact spelling already.
    """
    if collation is None:
        return df
    sums = [F.sum(quoted(total)).alias(total)] if total else []
    return (
        df.groupBy(collated(col, collation).alias("_value"))
        .agg(F.min(quoted(col)).alias(col), *sums)
        .drop("_value")
    )
