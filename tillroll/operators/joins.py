"""The joins of the shop schema.

None of them carries a broadcast hint: adaptive execution measures the smaller
side and broadcasts it only below the session's threshold, and otherwise splits
the partitions of a hot key in the shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillroll.functions.columns import quoted


def join_orders_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their customer; orders without a known customer drop out."""
    return orders.join(customers, "customer_id", "inner")


def join_items_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with their product; items of unknown products drop out."""
    return items.join(products, "product_id", "inner")


def key_set(df: DataFrame, key: str, name: str = "_key") -> DataFrame:
    """The distinct keys of a table.

    Keys are combined before the shuffle, so a key with very many rows is one
    row per input partition. The shuffle serves the following join as well.
    """
    return df.select(quoted(key).alias(name)).distinct()


def semi_join(df: DataFrame, other: DataFrame, key: str, null_safe: bool = False) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``.

    ``null_safe`` lets a missing key match a missing key, as a membership test
    on data frames does; SQL's IN never matches NULL.
    """
    mine, theirs = quoted(key), quoted("_key")
    match = mine.eqNullSafe(theirs) if null_safe else mine == theirs
    return df.join(key_set(other, key), match, "left_semi")


def anti_join(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``; NULL occurs nowhere."""
    known = key_set(other, other_key or key)
    return df.join(known, quoted(key) == quoted("_key"), "left_anti")
