"""The rules of the table definitions, run over loaded tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import quoted
from tillroll.operators.integrity import (
    check_decimal,
    check_fk,
    check_length,
    check_not_null,
    check_pk,
)
from tillroll.schemas import TABLES, Table


def check_table(target: Table, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Violations of one table: ``table, rule, column, value, n``; empty means clean.

    A key, a reference, a missing value, a text over its length, and an amount out of
    range are each a rule. ``n`` is how often a key value occurs, else 1.
    """
    df = tables[target.name]
    found: list[tuple[str, str, DataFrame]] = []
    for column, (parent, key) in target.references.items():
        found.append(("reference", column, check_fk(df, tables[parent], column, key)))
    for column in target.required:
        found.append(("required", column, check_not_null(df, [column])))
    for column, limit in target.lengths.items():
        found.append(("length", column, check_length(df, {column: limit})))
    for column, (precision, scale) in target.amounts.items():
        found.append(("range", column, check_decimal(df, column, precision, scale)))
    keys = check_pk(df, target.key).select(
        F.lit(target.name).alias("table"),
        F.lit("key").alias("rule"),
        F.lit(", ".join(target.key)).alias("column"),
        F.concat_ws(", ", *[quoted(c).cast("string") for c in target.key]).alias("value"),
        "n",
    )
    rows = [
        bad.select(
            F.lit(target.name).alias("table"),
            F.lit(rule).alias("rule"),
            F.lit(column).alias("column"),
            quoted(column).cast("string").alias("value"),
            F.lit(1).cast("bigint").alias("n"),
        )
        for rule, column, bad in found
    ]
    return reduce(DataFrame.unionByName, rows, keys)


def check_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Violations of all given tables."""
    return reduce(DataFrame.unionByName, [check_table(TABLES[name], tables) for name in tables])
