"""Reports that are refreshed by month.

Beside the reports lie sums per month that can be merged: orders and sales per day, revenue per
customer, units and revenue per product. They are stored in one partition per month. A late batch
changes the partitions of its own months only, and the reports are made from the sums, never from the orders again.

A batch counts once, however often it is tried. Its new partitions are written to a folder of their
own first, and a marker says when they are whole; from there they replace the old ones, which may
be repeated, and a last marker says that they have. One batch at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillroll.functions.columns import day_key, display_name, month_key
from tillroll.markers import publish, published, read_markers
from tillroll.operators.joins import join_items_products, join_orders_customers
from tillroll.operators.ranking import top_k, with_share
from tillroll.plans.reports import MART_NAMES
from tillroll.session import delete_path
from tillroll.sources.batches import check_batch_id
from tillroll.sources.sinks import write_all, write_table

MONTH = "month"
UNDATED = "undated"
"""The month of orders without a date, as a folder's name."""

KEYS = {"days": "order_date", "buyers": "customer_id", "sold": "product_id"}
SUMS = {"days": ("orders", "total_sales"), "buyers": ("revenue",), "sold": ("units", "revenue")}
WIDE = "decimal(38,6)"
"""Sums keep one type, however often they are merged."""


def _merged(parts: DataFrame, name: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in parts.schema}
    return parts.groupBy(MONTH, KEYS[name]).agg(
        *[F.sum(c).cast(kinds[c]).alias(c) for c in SUMS[name]]
    )


def monthly_sums(orders: DataFrame, items: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """The three sums of orders and items. An item's month is its order's among the ``known``
    orders, by default the given ones; items of unknown orders are undated."""
    dated = orders.withColumn(MONTH, F.coalesce(month_key("order_date"), F.lit(UNDATED)))
    price = F.col("total_price").cast(WIDE)
    months = (orders if known is None else known).select(
        "order_id", F.coalesce(month_key("order_date"), F.lit(UNDATED)).alias(MONTH)
    )
    # an order's products hardly repeat, so sums per order and product would hold the items themselves in
    # memory; adaptive execution splits a hot order
    sold = items.join(months, "order_id", "left").withColumn(MONTH, F.coalesce(MONTH, F.lit(UNDATED)))
    return {
        "days": dated.groupBy(MONTH, day_key("order_date").alias("order_date")).agg(
            F.count("*").alias("orders"), F.sum(price).cast(WIDE).alias("total_sales")
        ),
        "buyers": dated.groupBy(MONTH, "customer_id").agg(F.sum(price).cast(WIDE).alias("revenue")),
        "sold": sold.groupBy(MONTH, "product_id").agg(
            F.sum("quantity").alias("units"), F.sum(F.col("quantity") * F.col("price")).cast(WIDE).alias("revenue")
        ),
    }


def _write_months(df: DataFrame, path: str, replace: bool = False) -> None:
    """One folder per month; a large month is several files, small ones share a task."""
    write_table(df.hint("rebalance", MONTH), path, [MONTH], replace_partitions=replace)


def _read(spark: SparkSession, state: str, name: str, path: str) -> DataFrame:
    """Stored sums; a folder without a month has no rows."""
    held = read_markers(spark, f"{state}/schema/{name}").first()["value"]
    return spark.read.schema(StructType.fromJson(json.loads(held))).parquet(path)


def start(orders: DataFrame, items: DataFrame, state: str) -> None:
    """Write the sums of all orders so far, replacing the state."""
    spark = orders.sparkSession
    delete_path(spark, state)
    sums = monthly_sums(orders, items)
    for name, df in sums.items():
        publish(spark, f"{state}/schema/{name}/columns", df.schema.json())
    write_all(sums, f"{state}/sums", _write_months)


def apply_batch(
    orders: DataFrame, items: DataFrame, state: str, batch: str, known: DataFrame | None = None
) -> bool:
    """Add a late batch to the sums of its months; false if it was added before.

    ``known`` are orders that the batch's items may belong to. The months a batch touches are
    listed on the driver: a few hundred at most, as there are months.
    """
    spark = orders.sparkSession
    check_batch_id(batch)
    if published(spark, f"{state}/applied/{batch}"):
        return False
    pending = f"{state}/pending/{batch}"
    if not published(spark, f"{state}/prepared/{batch}"):
        known = orders if known is None else known
        write_all(monthly_sums(orders, items, known), f"{pending}/own", _write_months)
        whole = {n: _with_old(spark, n, state, f"{pending}/own/{n}") for n in KEYS}
        write_all(whole, f"{pending}/whole", _write_months)
        publish(spark, f"{state}/prepared/{batch}", batch)
    for name in KEYS:
        new = _read(spark, state, name, f"{pending}/whole/{name}")
        if not new.isEmpty():
            _write_months(new, f"{state}/sums/{name}", replace=True)
    publish(spark, f"{state}/applied/{batch}", batch)
    delete_path(spark, pending)
    return True


def _with_old(spark: SparkSession, name: str, state: str, own: str) -> DataFrame:
    """The months of a batch as they are with it."""
    new = _read(spark, state, name, own)
    touched = [r[0] for r in new.select(MONTH).distinct().collect()]
    old = _read(spark, state, name, f"{state}/sums/{name}").where(F.col(MONTH).isin(touched))
    return _merged(old.select(*new.columns).unionByName(new), name)


def reports(spark: SparkSession, state: str, customers: DataFrame, products: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """The five reports from the sums."""
    sums = {n: _read(spark, state, n, f"{state}/sums/{n}") for n in KEYS}
    revenue = sums["buyers"].groupBy("customer_id").agg(F.sum("revenue").alias("revenue"))
    best = top_k(
        revenue.join(customers.select("customer_id"), "customer_id", "left_semi"), "revenue", "customer_id", k
    )
    named = join_orders_customers(best, customers).select(
        "customer_id", display_name("first_name", "last_name").alias("customer_name"), "revenue"
    )
    sold = sums["sold"].groupBy("product_id").agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    sales = join_items_products(sold, products.select("product_id", "category", "name"))
    month = F.when(F.col(MONTH) != UNDATED, F.col(MONTH)).alias(MONTH)
    units = sales.groupBy(F.col("name").alias("product_name")).agg(F.sum("units").alias("total_quantity"))
    return {
        "monthly_orders": sums["days"].groupBy(MONTH).agg(F.sum("orders").alias("orders")).select(month, "orders"),
        "top_customers": top_k(named, "revenue", "customer_id", k),
        "category_revenue": with_share(sales.groupBy("category").agg(F.sum("revenue").alias("revenue")), "revenue"),
        "top_products": top_k(units, "total_quantity", "product_name", k),
        "daily_sales": sums["days"].select("order_date", "total_sales"),
    }


def refresh(spark: SparkSession, state: str, customers: DataFrame, products: DataFrame, out: str, k: int = 5) -> dict[str, str]:
    """Write the five reports from the sums; returns name -> path."""
    write_all(reports(spark, state, customers, products, k), out)
    return {name: f"{out}/{name}" for name in MART_NAMES}
