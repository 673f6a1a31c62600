"""Table rules as jobs that return the violating rows; empty means clean."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import quoted
from tillroll.operators.dedupe import merge_spellings
from tillroll.operators.joins import anti_join


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def check_pk(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once or contain a NULL, with their count."""
    cols = list(map(quoted, key))
    return (
        df.groupBy(*cols)
        .agg(F.count("*").alias("n"))
        .where((F.col("n") > 1) | _any([c.isNull() for c in cols]))
    )


def check_unique(df: DataFrame, col: str, collation: str | None = None) -> DataFrame:
    """Values held by several rows: first spelling and count; NULLs may repeat."""
    held = df.where(quoted(col).isNotNull())
    spellings = held.groupBy(quoted(col)).agg(F.count("*").alias("n"))
    return merge_spellings(spellings, col, "n", collation).where("n > 1")


def check_fk(
    child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None
) -> DataFrame:
    """Child rows whose key is no parent's key; a NULL key violates nothing."""
    return anti_join(child.where(quoted(key).isNotNull()), parent, key, parent_key)


def check_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.where(_any([quoted(c).isNull() for c in cols]))


def check_length(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Rows with a text longer than its column allows, counted in characters."""
    return df.where(_any([F.length(quoted(c)) > n for c, n in limits.items()]))


def check_decimal(
    df: DataFrame, col: str, precision: int, scale: int, exact: bool = False
) -> DataFrame:
    """Rows whose number leaves decimal(precision, scale).

    ``exact`` also reports digits that the scale would round away.
    """
    rounded = quoted(col).try_cast(f"decimal(38,{scale})")
    limit = F.lit(Decimal(10) ** (precision - scale))
    bad = rounded.isNull() | (F.abs(rounded) >= limit)
    if exact:
        # all digits a decimal has room for behind an amount in range
        finer = quoted(col).try_cast(f"decimal(38,{38 - precision + scale})")
        bad = bad | (finer != rounded.try_cast(f"decimal({precision},{scale})"))
    return df.where(quoted(col).isNotNull() & bad)
