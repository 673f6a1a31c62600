"""Report queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from query_set import bindings as b
from tillroll.operators.joins import anti_join, semi_join
from tillroll.plans import periods
from tillroll.plans import reports as r
from tillroll.session import fresh_path


def as_double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def monthly_orders(spark: SparkSession, sf: str) -> DataFrame:
    return r.monthly_orders(b.orders(spark, sf))


def daily_sales(spark: SparkSession, sf: str) -> DataFrame:
    sales = as_double(r.daily_sales(b.orders(spark, sf)), "total_sales")
    return sales.withColumn("order_date", F.col("order_date").cast("string"))


def customer_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(r.customer_revenue(b.orders(spark, sf), b.customers(spark, sf)), "revenue")


def top_customers(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(r.top_customers(b.orders(spark, sf), b.customers(spark, sf)), "revenue")


def category_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(r.category_revenue(b.order_items(spark, sf), b.products(spark, sf)), "revenue")


def category_share(spark: SparkSession, sf: str) -> DataFrame:
    shares = r.category_share(b.order_items(spark, sf), b.products(spark, sf))
    return as_double(shares, "revenue", "share")


def product_units(spark: SparkSession, sf: str) -> DataFrame:
    return r.product_units(b.order_items(spark, sf), b.products(spark, sf))


def top_products(spark: SparkSession, sf: str) -> DataFrame:
    return r.top_products(b.order_items(spark, sf), b.products(spark, sf))


def _mixed_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products whose names and categories vary in case and accents, by size."""
    size = F.col("p_size")

    def mixed(col: str):
        return (
            F.when(size > 35, F.upper(col))
            .when(size > 20, F.translate(F.lower(col), "eo", "éö"))
            .otherwise(F.col(col))
        )

    return b.source(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"),
        mixed("p_name").alias("name"),
        mixed("p_type").alias("category"),
    )


def category_revenue_collated(spark: SparkSession, sf: str) -> DataFrame:
    args = b.order_items(spark, sf), _mixed_products(spark, sf)
    return as_double(r.category_revenue(*args, collation="UNICODE_CI_AI"), "revenue")


def product_units_collated(spark: SparkSession, sf: str) -> DataFrame:
    args = b.order_items(spark, sf), _mixed_products(spark, sf)
    return r.product_units(*args, collation="UNICODE_CI_AI")


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "orders": b.orders(spark, sf),
        "customers": b.customers(spark, sf),
        "order_items": b.order_items(spark, sf),
        "products": b.products(spark, sf),
    }


def _mart(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One written mart; all five are written once per application."""
    paths = b.once(spark, sf, "refreshed", lambda path: r.refresh_marts(_tables(spark, sf), path))
    return spark.read.parquet(paths[name])


def mart_monthly_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _mart(spark, sf, "monthly_orders")


def mart_top_customers(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(_mart(spark, sf, "top_customers"), "revenue")


def mart_category_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(_mart(spark, sf, "category_revenue"), "revenue", "share")


def mart_top_products(spark: SparkSession, sf: str) -> DataFrame:
    return _mart(spark, sf, "top_products")


def mart_daily_sales(spark: SparkSession, sf: str) -> DataFrame:
    days = as_double(_mart(spark, sf, "daily_sales"), "total_sales")
    return days.withColumn("order_date", F.col("order_date").cast("string"))


def refresh_marts(spark: SparkSession, sf: str) -> DataFrame:
    """Write the five marts and read them back: rows and total of each."""
    paths = r.refresh_marts(_tables(spark, sf), fresh_path(spark, "marts"))
    measures = {
        "monthly_orders": "orders",
        "top_customers": "revenue",
        "category_revenue": "revenue",
        "top_products": "total_quantity",
        "daily_sales": "total_sales",
    }
    parts = [
        spark.read.parquet(paths[name]).agg(
            F.lit(name).alias("mart"),
            F.count("*").alias("n_rows"),
            F.sum(measure).cast("double").alias("total"),
        )
        for name, measure in measures.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _late(df: DataFrame, late: bool) -> DataFrame:
    """The orders of February with priority 3, which come late, or all others."""
    came_late = (F.month("order_date") == 2) & (F.col("total_quantity") == 3)
    return df.where(came_late if late else ~F.coalesce(came_late, F.lit(False)))


def refresh_late_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the five reports, kept by month: one batch came late and was sent three times."""
    state = fresh_path(spark, "months")
    tables = _tables(spark, sf)
    orders, items = tables["orders"], tables["order_items"]
    early, late = _late(orders, False), _late(orders, True)
    periods.start(early, anti_join(items, late, "order_id"), state)
    for _ in range(3):
        periods.apply_batch(late, semi_join(items, late, "order_id"), state, "february")
    paths = periods.refresh(spark, state, tables["customers"], tables["products"], fresh_path(spark, "late-marts"))
    columns = {
        "monthly_orders": ("month", "orders"),
        "top_customers": ("customer_name", "revenue"),
        "category_revenue": ("category", "revenue"),
        "top_products": ("product_name", "total_quantity"),
        "daily_sales": ("order_date", "total_sales"),
    }
    parts = [
        spark.read.parquet(paths[name]).select(
            F.lit(name).alias("mart"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value")
        )
        for name, (key, value) in columns.items()
    ]
    return reduce(DataFrame.unionByName, parts)


_MONTHS = "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders FROM orders GROUP BY 1"

_DAYS = """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS order_date,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total_sales
FROM orders GROUP BY 1
"""

_CUSTOMERS = """
SELECT c_custkey AS customer_id, any_value(c_name || ' ' || c_mktsegment) AS customer_name,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey
"""

_CATEGORIES = """
SELECT p_type AS category,
       sum(CAST(l_quantity AS BIGINT) * CAST(l_extendedprice AS DECIMAL(12,2))) AS r
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
"""

_MIXED = """
SELECT p_partkey AS product_id,
       CASE WHEN p_size > 35 THEN upper(p_name)
            WHEN p_size > 20 THEN translate(lower(p_name), 'eo', 'éö') ELSE p_name END AS name,
       CASE WHEN p_size > 35 THEN upper(p_type)
            WHEN p_size > 20 THEN translate(lower(p_type), 'eo', 'éö') ELSE p_type END AS category
FROM part
"""

_UNITS = """
SELECT p_name AS product_name, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_quantity
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
"""

_TOP_CUSTOMERS = f"{_CUSTOMERS} ORDER BY revenue DESC NULLS LAST, customer_id LIMIT 5"
_TOP_PRODUCTS = f"{_UNITS} ORDER BY total_quantity DESC NULLS LAST, product_name LIMIT 5"

_SHARES = f"""
SELECT category, CAST(r AS DOUBLE) AS revenue,
       CAST(round(100.0 * r / sum(r) OVER (), 1) AS DOUBLE) AS share
FROM ({_CATEGORIES})
"""

QUERIES = {
    "mart_monthly_orders": (mart_monthly_orders, _MONTHS),
    "mart_daily_sales": (mart_daily_sales, _DAYS),
    "mart_top_customers": (mart_top_customers, _TOP_CUSTOMERS),
    "mart_category_revenue": (mart_category_revenue, _SHARES),
    "mart_top_products": (mart_top_products, _TOP_PRODUCTS),
    "monthly_orders": (monthly_orders, _MONTHS),
    "daily_sales": (daily_sales, _DAYS),
    "customer_revenue": (customer_revenue, _CUSTOMERS),
    "top_customers": (top_customers, _TOP_CUSTOMERS),
    "category_revenue": (
        category_revenue,
        f"SELECT category, CAST(r AS DOUBLE) AS revenue FROM ({_CATEGORIES})",
    ),
    "category_share": (category_share, _SHARES),
    "product_units": (product_units, _UNITS),
    "top_products": (top_products, _TOP_PRODUCTS),
    "category_revenue_collated": (
        category_revenue_collated,
        f"""SELECT min(category) AS category,
                   CAST(sum(CAST(l_quantity AS BIGINT) * CAST(l_extendedprice AS DECIMAL(12,2)))
                        AS DOUBLE) AS revenue
            FROM lineitem JOIN ({_MIXED}) ON l_partkey = product_id
            GROUP BY lower(strip_accents(category))""",
    ),
    "product_units_collated": (
        product_units_collated,
        f"""SELECT min(name) AS product_name,
                   CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_quantity
            FROM lineitem JOIN ({_MIXED}) ON l_partkey = product_id
            GROUP BY lower(strip_accents(name))""",
    ),
    "refresh_late_batch": (
        refresh_late_batch,
        f"""
        SELECT 'monthly_orders' AS mart, month AS key, CAST(orders AS DOUBLE) AS value FROM ({_MONTHS})
        UNION ALL SELECT 'daily_sales', order_date, total_sales FROM ({_DAYS})
        UNION ALL SELECT 'top_customers', customer_name, revenue FROM ({_TOP_CUSTOMERS})
        UNION ALL SELECT 'category_revenue', category, revenue FROM ({_SHARES})
        UNION ALL SELECT 'top_products', product_name, CAST(total_quantity AS DOUBLE)
        FROM ({_TOP_PRODUCTS})
        """,
    ),
    "refresh_marts": (
        refresh_marts,
        f"""
        SELECT 'monthly_orders' AS mart, count(*) AS n_rows, CAST(sum(orders) AS DOUBLE) AS total
        FROM ({_MONTHS})
        UNION ALL SELECT 'top_customers', count(*),
               CAST(sum(CAST(revenue AS DECIMAL(22,2))) AS DOUBLE) FROM ({_TOP_CUSTOMERS})
        UNION ALL SELECT 'category_revenue', count(*), CAST(sum(r) AS DOUBLE) FROM ({_CATEGORIES})
        UNION ALL SELECT 'top_products', count(*), CAST(sum(total_quantity) AS DOUBLE)
        FROM ({_TOP_PRODUCTS})
        UNION ALL SELECT 'daily_sales', count(*),
               CAST(sum(CAST(total_sales AS DECIMAL(22,2))) AS DOUBLE) FROM ({_DAYS})
        """,
    ),
}
