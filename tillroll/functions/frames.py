"""Frame-level column work: fills and equality look-ups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import quoted
from tillroll.schemas import NULL_TOKENS


def _replace(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    unknown = set(new) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def null_tokens(
    df: DataFrame, cols: Iterable[str], tokens: Iterable[str] = NULL_TOKENS
) -> DataFrame:
    """Turn the tokens into NULL, in the named columns only."""
    tokens = list(tokens)
    return _replace(
        df, {c: F.when(~quoted(c).isin(tokens), quoted(c)) for c in cols}
    )


def fill_nulls(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Replace NULL per column; names may contain dots."""
    return _replace(df, {c: F.coalesce(quoted(c), F.lit(v)) for c, v in values.items()})


def lookup(df: DataFrame, **equals: Any) -> DataFrame:
    """Rows where every named column equals its value; values stay literals."""
    if not equals:
        raise ValueError("name at least one column")
    return df.where(reduce(lambda a, b: a & b, [quoted(c) == F.lit(v) for c, v in equals.items()]))
