"""The five sales reports and their refresh.

Facts meet a shuffled join only as sums per join key, so a product or a customer
with very many rows is a single row there. Names compare
exactly; a ``collation`` such as ``UNICODE_CI_AI`` merges those that differ only
in case and accents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import day_key, display_name, month_key
from tillroll.operators.dedupe import merge_spellings
from tillroll.operators.joins import join_items_products, join_orders_customers
from tillroll.operators.ranking import top_k, with_share
from tillroll.sources.sinks import write_marts

MART_NAMES = (
    "monthly_orders",
    "top_customers",
    "category_revenue",
    "top_products",
    "daily_sales",
)

def monthly_orders(orders: DataFrame) -> DataFrame:
    """Orders per month; orders without a date form one group.

    Grouped by the month's first day; only the result rows are formatted.
    Unsorted, as ``daily_sales``: the marts put both in time order as they are written.
    """
    return (
        orders.groupBy(F.trunc("order_date", "month").alias("month"))
        .agg(F.count("*").alias("orders"))
        .select(month_key("month").alias("month"), "orders")
    )


def daily_sales(orders: DataFrame) -> DataFrame:
    """Sales per day."""
    return orders.groupBy(day_key("order_date").alias("order_date")).agg(
        F.sum("total_price").alias("total_sales")
    )


def customer_revenue(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue per customer id with the customer's display name."""
    revenue = orders.groupBy("customer_id").agg(F.sum("total_price").alias("revenue"))
    return join_orders_customers(revenue, customers).select(
        "customer_id", display_name("first_name", "last_name").alias("customer_name"), "revenue"
    )


def top_customers(orders: DataFrame, customers: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` customers with most revenue; ties go to the smaller id.

    Only the ids decide, so only ``k`` rows meet the names.
    """
    revenue = orders.groupBy("customer_id").agg(F.sum("total_price").alias("revenue"))
    known = revenue.join(customers.select("customer_id"), "customer_id", "left_semi")
    best = top_k(known, "revenue", "customer_id", k)
    named = join_orders_customers(best, customers).select(
        "customer_id", display_name("first_name", "last_name").alias("customer_name"), "revenue"
    )
    return top_k(named, "revenue", "customer_id", k)


def product_sales(items: DataFrame, products: DataFrame, by: Sequence[str]) -> DataFrame:
    """Units and revenue per product column(s) ``by``, such as name or category.

    Items are summed per product id, combined before the shuffle, and only the sums are
    joined: a product with very many items is one row there, and adaptive
    execution chooses the join by what it has measured.
    """
    sold = items.groupBy("product_id").agg(
        F.sum("quantity").alias("units"),
        F.sum(F.col("quantity") * F.col("price")).alias("revenue"),
    )
    return (
        join_items_products(sold, products.select("product_id", *by))
        .groupBy(*by)
        .agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    )


def _category_revenue(sales: DataFrame, collation: str | None = None) -> DataFrame:
    revenue = sales.select("category", "revenue")
    return merge_spellings(revenue, "category", "revenue", collation)


def _product_units(sales: DataFrame, collation: str | None = None) -> DataFrame:
    units = sales.select(
        F.col("name").alias("product_name"), F.col("units").alias("total_quantity")
    )
    return merge_spellings(units, "product_name", "total_quantity", collation)


def category_revenue(
    items: DataFrame, products: DataFrame, collation: str | None = None
) -> DataFrame:
    """Revenue per category; items of unknown products drop out."""
    return _category_revenue(product_sales(items, products, ["category"]), collation)


def category_share(
    items: DataFrame, products: DataFrame, collation: str | None = None
) -> DataFrame:
    """Revenue per category with its percentage of the total."""
    return with_share(category_revenue(items, products, collation), "revenue")


def product_units(items: DataFrame, products: DataFrame, collation: str | None = None) -> DataFrame:
    """Units per product name; products of one name count together."""
    return _product_units(product_sales(items, products, ["name"]), collation)


def top_products(
    items: DataFrame, products: DataFrame, k: int = 5, collation: str | None = None
) -> DataFrame:
    """The ``k`` names with most units; ties go to the smaller name."""
    return top_k(product_units(items, products, collation), "total_quantity", "product_name", k)


def refresh_marts(tables: Mapping[str, DataFrame], out: str, k: int = 5) -> dict[str, str]:
    """Compute and write all five reports; returns name -> path.

    Orders are scanned twice (by day, by customer) and items once: the month
    counts come from the day rows, and both product reports from the sales per
    category and name. These two bases are kept for the duration of the writes.
    """
    orders, customers = tables["orders"], tables["customers"]
    days = (
        orders.groupBy(day_key("order_date").alias("order_date"))
        .agg(F.count("*").alias("orders"), F.sum("total_price").alias("total_sales"))
        .persist()
    )
    sales = product_sales(tables["order_items"], tables["products"], ["category", "name"]).persist()
    by_category = sales.groupBy("category").agg(F.sum("revenue").alias("revenue"))
    by_name = sales.groupBy("name").agg(F.sum("units").alias("units"))
    marts = {
        "monthly_orders": days.groupBy(month_key("order_date").alias("month"))
        .agg(F.sum("orders").alias("orders"))
        .orderBy("month"),
        "top_customers": top_customers(orders, customers, k),
        "category_revenue": with_share(by_category, "revenue"),
        "top_products": top_k(_product_units(by_name), "total_quantity", "product_name", k),
        "daily_sales": days.select("order_date", "total_sales").orderBy("order_date"),
    }
    try:
        write_marts(marts, out)
    finally:
        days.unpersist()
        sales.unpersist()
    return {name: f"{out}/{name}" for name in MART_NAMES}
