"""Top-k, first match and share of total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import quoted


def top_k(df: DataFrame, value: str, tie_break: str, k: int = 5) -> DataFrame:
    """The ``k`` largest by ``value``; ties go to the smaller ``tie_break``."""
    return df.orderBy(
        quoted(value).desc_nulls_last(), quoted(tie_break).asc_nulls_last()
    ).limit(k)


def first_match(df: DataFrame, *order: str | Column) -> DataFrame:
    """The first row in a total order, or no row."""
    if not order:
        raise ValueError("a first row needs an order")
    return df.orderBy(*order).limit(1)


def with_share(df: DataFrame, value: str, share: str = "share", digits: int = 1) -> DataFrame:
    """Add each row's percentage of the column total; NULL for a zero total.

    The total is a scalar subquery, so no task sees all rows.
    """
    total = df.agg(F.sum(quoted(value))).scalar()
    percent = F.lit(100) * quoted(value) / F.nullif(total, F.lit(0))
    return df.withColumn(share, F.round(percent, digits))
