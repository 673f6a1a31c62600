"""Queries over the raw order export, and over JSON and text columns."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from query_set import bindings as b
from query_set.reports import as_double
from tillroll.functions import columns as c
from tillroll.functions.nested import get_item, has_key
from tillroll.operators.dedupe import distinct_rows, keep_first
from tillroll.operators.joins import semi_join
from tillroll.plans import normalise as n
from tillroll.plans.reports import refresh_marts
from tillroll.schemas import TABLES
from tillroll.session import delete_path, fresh_path, stage_table
from tillroll.sources.readers import load_table, read_export, table
from tillroll.sources.sinks import write_csv


def raw_customers(spark: SparkSession, sf: str) -> DataFrame:
    return n.build_customers(b.raw_export(spark, sf))


def raw_orders(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(n.build_orders(b.raw_export(spark, sf)), "total_price")


def raw_order_items(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(n.build_order_items(b.raw_export(spark, sf)), "price")


def raw_items_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the export, kept where their order is among the finished ones."""
    finished = b.orders(spark, sf).where("status = 'F'")
    return as_double(n.build_order_items(b.raw_export(spark, sf), finished), "price")


def raw_items_each(spark: SparkSession, sf: str) -> DataFrame:
    """The variant that keeps good elements behind a bad one."""
    return as_double(n.build_order_items(b.raw_export(spark, sf), each=True), "price")


def raw_products(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(n.build_products(b.raw_export(spark, sf)), "price")


def _from_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The raw export through CSV files: what the clean-up job reads in practice."""
    path = fresh_path(spark, "csv-export")
    write_csv(b.raw_export(spark, sf).drop("seq"), path)
    return read_export(spark, path)


def csv_export_orders(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(n.build_orders(_from_csv(spark, sf)), "total_price")


def _accepted(raw: DataFrame) -> DataFrame:
    """Accepted elements per order, with decimal prices."""
    elements = n.parse_export(raw, ["items"])
    return (
        elements.where("pos < items_prefix")
        .groupBy("order_id")
        .agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.sum("price").alias("price"))
    )


def csv_export_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted elements per order, read back from CSV."""
    return as_double(_accepted(_from_csv(spark, sf)), "price")


BATCH = 1 << 30
"""Bytes of the export's files that are written as CSV at a time; as text they are some five times as many."""


def csv_split_elements(spark: SparkSession, sf: str) -> DataFrame:
    """The same from files whose cells have a line break between elements, read block by block.

    The whole export as text would be the most by far that the query keeps on disk. It is written batch by
    batch, two at a time, and a batch's text is deleted when its sums are staged.
    """
    broken = F.replace("products", F.lit("},{"), F.lit("},\n{"))

    def summed(raw: DataFrame) -> DataFrame:
        path = fresh_path(spark, "csv-lines")
        try:
            write_csv(raw.drop("seq").withColumn("products", broken), path)
            return stage_table(_accepted(read_export(spark, path, split=True)), "elements")
        finally:
            delete_path(spark, path)

    with ThreadPoolExecutor(2) as pool:
        parts = list(pool.map(summed, b.raw_batches(spark, sf, BATCH)))
    sums = [F.sum(c).alias(c) for c in ("n", "quantity", "price")]
    return as_double(reduce(DataFrame.unionByName, parts).groupBy("order_id").agg(*sums), "price")


def wide_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Items with very large and very fine prices, none of them lost or rounded."""
    return as_double(n.build_order_items(b.wide_export(spark, sf)), "price")


def _clean(spark: SparkSession, sf: str) -> dict[str, str]:
    """The clean-up job over the whole export, run once per application."""
    return b.once(spark, sf, "clean", lambda path: n.normalise(b.raw_export(spark, sf), path))


def normalise_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The whole clean-up job: rows and a total of each written table."""
    paths = n.normalise(b.raw_export(spark, sf), fresh_path(spark, "clean"))
    measures = {
        "customers": "customer_id",
        "orders": "total_price",
        "order_items": "price",
        "products": "price",
    }
    parts = [
        table(spark, paths[name]).agg(
            F.lit(name).alias("name"),
            F.count("*").alias("n_rows"),
            F.sum(col).cast("double").alias("total"),
        )
        for name, col in measures.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def clean_customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, _clean(spark, sf)["customers"])


def clean_orders(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(table(spark, _clean(spark, sf)["orders"]), "total_price")


def clean_order_items(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(table(spark, _clean(spark, sf)["order_items"]), "price")


def clean_products(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(table(spark, _clean(spark, sf)["products"]), "price")


def clean_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What the job wrote as lost, by every pass, dates included."""
    return table(spark, _clean(spark, sf)["rejects"]).select(
        "pass",
        "order_id",
        F.regexp_extract("seq", r", (\d+)\}", 1).cast("bigint").alias("copy"),
        F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"),
        "reason",
    )


def _load(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    return {name: load_table(table(spark, paths[name]), TABLES[name]) for name in TABLES}


def _marts(spark: SparkSession, sf: str) -> dict[str, str]:
    """From the clean tables to the written reports, once per application."""
    loaded = lambda: _load(spark, _clean(spark, sf))
    return b.once(spark, sf, "marts", lambda path: refresh_marts(loaded(), path))


def export_reports(spark: SparkSession, sf: str) -> DataFrame:
    """From the raw export to a report: clean-up, typed load, refresh."""
    paths = n.normalise(b.raw_export(spark, sf), fresh_path(spark, "clean"))
    marts = refresh_marts(_load(spark, paths), fresh_path(spark, "marts"))
    return as_double(table(spark, marts["category_revenue"]), "revenue", "share")


def export_monthly_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, _marts(spark, sf)["monthly_orders"])


def export_daily_sales(spark: SparkSession, sf: str) -> DataFrame:
    days = as_double(table(spark, _marts(spark, sf)["daily_sales"]), "total_sales")
    return days.withColumn("order_date", F.col("order_date").cast("string"))


def export_top_customers(spark: SparkSession, sf: str) -> DataFrame:
    return as_double(table(spark, _marts(spark, sf)["top_customers"]), "revenue")


def export_top_products(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, _marts(spark, sf)["top_products"])


def flat_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _rejected(spark, sf, "flat")


def flat_items(spark: SparkSession, sf: str) -> DataFrame:
    flat = n.build_flat_items(b.raw_export(spark, sf))
    return flat.select(
        "order_id",
        "customer_id",
        F.col("product_id").cast("bigint").alias("product_id"),
        "product_name",
        "category",
        F.col("price").startswith("$").alias("has_sign"),
        c.parse_money("price", strip="$").cast("double").alias("amount"),
        "quantity",
        "order_date",
    )


def flat_customers(spark: SparkSession, sf: str) -> DataFrame:
    return n.flat_customers(b.raw_export(spark, sf))


def flat_orders(spark: SparkSession, sf: str) -> DataFrame:
    return n.flat_orders(b.raw_export(spark, sf)).withColumns(
        {
            "order_id": F.col("order_id").cast("bigint"),
            "customer_id": F.col("customer_id").cast("bigint"),
            "total_price": c.parse_money("total_price", strip="$,").cast("double"),
        }
    )


def _rejected(spark: SparkSession, sf: str, target: str) -> DataFrame:
    return n.rejects(b.raw_export(spark, sf), target).select(
        "order_id",
        F.col("seq.copy").cast("bigint").alias("copy"),
        F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"),
        "reason",
    )


def item_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _rejected(spark, sf, "items")


def product_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _rejected(spark, sf, "products")


def props_key(spark: SparkSession, sf: str) -> DataFrame:
    """Key access on a JSON object: present, typed, and missing."""
    item = F.try_parse_json("props")
    return b.source(spark, sf, "events").select(
        "event_id",
        get_item(item, "k", "bigint").alias("k"),
        has_key(item, "k").alias("has_k"),
        has_key(item, "price").alias("has_price"),
    )


def money_parse(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("$"), F.format_number("total_price", 2))
    return (
        b.orders(spark, sf)
        .select("order_id", text.alias("total"))
        .select("order_id", c.parse_money("total", strict=True).cast("double").alias("total"))
    )


def coerce_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written as text, with text that is no date on pending orders."""
    text = F.when(F.col("status") == "P", F.lit("soon")).otherwise(
        F.date_format("order_date", "yyyy-MM-dd HH:mm:ss")
    )
    return b.orders(spark, sf).select(
        "order_id",
        c.coerce_timestamp(text).alias("order_date"),
        c.month_key("order_date").alias("month"),
        c.day_key("order_date").cast("string").alias("day"),
    )


def dedupe_items(spark: SparkSession, sf: str) -> DataFrame:
    items = b.order_items(spark, sf)
    order = ["line_number", "supplier_id", "price", "quantity"]
    first = keep_first(items, ["order_id", "product_id"], order)
    return as_double(first.select("order_id", "product_id", *order), "price")


def distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct rows of a projection."""
    return distinct_rows(b.order_items(spark, sf), ["product_id", "supplier_id"])


def items_semi_orders(spark: SparkSession, sf: str) -> DataFrame:
    items = b.order_items(spark, sf).select("order_id", "product_id", "quantity", "price")
    finished = b.orders(spark, sf).where("status = 'F'")
    return as_double(semi_join(items, finished, "order_id"), "price")


# Lines as the export holds them: one document per order, lines in sorted order,
# with what each pass rejects, and what is lost as a whole document.
_LINES = """
WITH numbered AS (
  SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price, p_type, p_brand,
         CASE WHEN p_brand = 'Brand#22' THEN NULL WHEN p_brand = 'Brand#17' THEN ''
              ELSE p_name END AS name,
         p_brand = 'Brand#13' OR (p_brand = 'Brand#7' AND l_extendedprice >= 1000) AS price_bad,
         row_number() OVER (ORDER BY l_orderkey, l_partkey, l_extendedprice, l_quantity) - 1 AS line_at
  FROM lineitem JOIN part ON l_partkey = p_partkey
), documents AS (
  SELECT n.*, o.o_custkey, o.o_orderdate, o.o_orderpriority, o.o_orderstatus,
         (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
         OR (o_orderstatus = 'O' AND o_orderpriority = '2-HIGH')
         OR (o_orderstatus = 'F' AND o_orderpriority IN ('4-NOT SPECIFIED', '2-HIGH'))
         OR (o_orderstatus = 'F'
             AND bool_or(coalesce(name = '', false)) OVER (PARTITION BY l_orderkey))
         AS lost,
         price_bad OR p_brand = 'Brand#9' AS item_bad,
         price_bad OR p_brand = 'Brand#21' AS product_bad,
         p_brand = 'Brand#21' AS flat_bad
  FROM numbered n JOIN orders o ON l_orderkey = o_orderkey
), lines AS (
  SELECT *, bool_or(item_bad) OVER w AS item_lost, bool_or(product_bad) OVER w AS product_lost,
         bool_or(flat_bad) OVER w AS flat_lost,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY line_at) - 1 AS pos
  FROM documents
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY line_at
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), exported AS (
  SELECT orders.*, customer.*, copy,
         CASE WHEN c_mktsegment IN ('FURNITURE', 'BUILDING') THEN 'N/A'
              ELSE c_nationkey || '-' || o_orderkey || '-' || copy END AS phone,
         CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN NULL
              ELSE o_orderdate END AS placed
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN (SELECT 0 AS copy UNION ALL SELECT 1) ON copy = 0 OR o_orderpriority = '1-URGENT'
)
"""

_FIRST_ITEMS = """
  SELECT l_orderkey AS order_id, l_partkey AS product_id, quantity, CAST(price AS DOUBLE) AS price
  FROM lines WHERE NOT lost AND NOT {bad}
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY line_at) = 1
"""

_FIRST_PRODUCTS = """
  SELECT l_partkey AS product_id, name AS product_name, p_type AS category,
         CAST(price AS DOUBLE) AS price
  FROM lines WHERE NOT lost AND NOT product_lost
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, line_at) = 1
"""

_CLEAN_ORDERS = """
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, placed AS order_date,
         CAST(left(o_orderpriority, 1) AS BIGINT) AS total_quantity,
         CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total_price
  FROM exported WHERE copy = 0
"""

_CUSTOMER_CELLS = """
  c_custkey {cast} AS customer_id, c_name AS customer_first_name,
  c_mktsegment AS customer_last_name,
  CASE WHEN c_nationkey < 12 THEN 'FEMALE' ELSE 'MALE' END AS customer_gender,
  lower(c_name) || '@shop.test' AS email, phone AS customer_phone
"""

_CLEAN_CUSTOMERS = f"""
  SELECT {_CUSTOMER_CELLS.format(cast='')} FROM exported
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey, copy) = 1
"""


def _rejected_rows(bad: str, lost: str) -> str:
    return f"""
SELECT l_orderkey AS order_id, CAST(copy AS BIGINT) AS copy, pos,
       CASE WHEN {bad} THEN 'bad element' ELSE 'after bad element' END AS reason
FROM lines JOIN exported ON l_orderkey = o_orderkey WHERE NOT lost AND {lost}
UNION ALL
SELECT DISTINCT l_orderkey, CAST(copy AS BIGINT), CAST(-1 AS BIGINT), 'no JSON array'
FROM lines JOIN exported ON l_orderkey = o_orderkey WHERE lost
UNION ALL
SELECT o_orderkey, CAST(copy AS BIGINT), CAST(-1 AS BIGINT), 'missing text'
FROM exported WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
"""


def _rejects_sql(bad: str, lost: str) -> str:
    return _LINES + _rejected_rows(bad, lost)


_ALL_REJECTS = f"""
SELECT 'items' AS pass, * FROM ({_rejected_rows("item_bad", "item_lost")})
UNION ALL SELECT 'products', * FROM ({_rejected_rows("product_bad", "product_lost")})
UNION ALL SELECT 'flat', * FROM ({_rejected_rows("flat_bad", "flat_lost")})
UNION ALL SELECT 'orders', o_orderkey, CAST(copy AS BIGINT), CAST(-1 AS BIGINT), 'bad date'
FROM exported WHERE placed IS NULL
"""

_CATEGORY_SHARES = f"""
  SELECT category, CAST(r AS DOUBLE) AS revenue,
         CAST(round(100.0 * r / sum(r) OVER (), 1) AS DOUBLE) AS share
  FROM (SELECT category, sum(quantity * CAST(i.price AS DECIMAL(12,2))) AS r
        FROM ({_FIRST_ITEMS.format(bad="item_lost")}) i
        JOIN ({_FIRST_PRODUCTS}) p ON i.product_id = p.product_id
        GROUP BY 1)
"""

_ELEMENTS = f"""{_LINES}
        SELECT l_orderkey AS order_id, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity,
               CAST(sum(price) AS DOUBLE) AS price
        FROM lines JOIN exported ON l_orderkey = o_orderkey
        WHERE NOT lost AND NOT item_lost GROUP BY 1"""


QUERIES = {
    "raw_customers": (raw_customers, _LINES + _CLEAN_CUSTOMERS),
    "raw_orders": (raw_orders, _LINES + _CLEAN_ORDERS),
    "raw_order_items": (raw_order_items, _LINES + _FIRST_ITEMS.format(bad="item_lost")),
    "raw_items_checked": (
        raw_items_checked,
        f"""{_LINES} SELECT * FROM ({_FIRST_ITEMS.format(bad="item_lost")})
            WHERE order_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    ),
    "raw_items_each": (raw_items_each, _LINES + _FIRST_ITEMS.format(bad="item_bad")),
    "raw_products": (raw_products, _LINES + _FIRST_PRODUCTS),
    "csv_export_orders": (csv_export_orders, _LINES + _CLEAN_ORDERS),
    "csv_export_elements": (
        csv_export_elements,
        _ELEMENTS,
    ),
    "csv_split_elements": (csv_split_elements, _ELEMENTS),
    "normalise_tables": (
        normalise_tables,
        f"""{_LINES}
        SELECT 'customers' AS name, count(*) AS n_rows, CAST(sum(customer_id) AS DOUBLE) AS total
        FROM ({_CLEAN_CUSTOMERS})
        UNION ALL SELECT 'orders', count(*),
               CAST(sum(CAST(total_price AS DECIMAL(12,2))) AS DOUBLE) FROM ({_CLEAN_ORDERS})
        UNION ALL SELECT 'order_items', count(*),
               CAST(sum(CAST(price AS DECIMAL(12,2))) AS DOUBLE)
        FROM ({_FIRST_ITEMS.format(bad="item_lost")})
        UNION ALL SELECT 'products', count(*),
               CAST(sum(CAST(price AS DECIMAL(12,2))) AS DOUBLE) FROM ({_FIRST_PRODUCTS})""",
    ),
    "clean_customers": (clean_customers, _LINES + _CLEAN_CUSTOMERS),
    "clean_orders": (clean_orders, _LINES + _CLEAN_ORDERS),
    "clean_order_items": (clean_order_items, _LINES + _FIRST_ITEMS.format(bad="item_lost")),
    "clean_products": (clean_products, _LINES + _FIRST_PRODUCTS),
    "clean_rejects": (clean_rejects, _LINES + _ALL_REJECTS),
    "wide_prices": (
        wide_prices,
        """SELECT l_orderkey AS order_id, l_partkey AS product_id,
                  CAST(l_quantity AS BIGINT) AS quantity,
                  CAST(CAST(CASE WHEN l_linenumber % 2 = 0
                                 THEN CAST(l_extendedprice AS DECIMAL(12,2)) + 1000000000000
                                 ELSE CAST(l_extendedprice AS DECIMAL(12,2)) + 0.00000001 END
                            AS DECIMAL(38,12)) AS DOUBLE) AS price
           FROM lineitem
           QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey
                                      ORDER BY l_extendedprice, l_quantity,
                                               CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END) = 1
        """,
    ),
    "export_reports": (export_reports, _LINES + _CATEGORY_SHARES),
    "export_monthly_orders": (
        export_monthly_orders,
        f"""{_LINES} SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS orders
            FROM ({_CLEAN_ORDERS}) GROUP BY 1""",
    ),
    "export_daily_sales": (
        export_daily_sales,
        f"""{_LINES} SELECT strftime(order_date, '%Y-%m-%d') AS order_date,
                   CAST(sum(CAST(total_price AS DECIMAL(12,2))) AS DOUBLE) AS total_sales
            FROM ({_CLEAN_ORDERS}) GROUP BY 1""",
    ),
    "export_top_customers": (
        export_top_customers,
        f"""{_LINES} SELECT customer_id, any_value(customer_first_name || ' '
                                                   || customer_last_name) AS customer_name,
                   CAST(sum(CAST(total_price AS DECIMAL(12,2))) AS DOUBLE) AS revenue
            FROM ({_CLEAN_ORDERS}) JOIN ({_CLEAN_CUSTOMERS}) USING (customer_id) GROUP BY 1
            ORDER BY revenue DESC, customer_id LIMIT 5""",
    ),
    "export_top_products": (
        export_top_products,
        f"""{_LINES} SELECT product_name, CAST(sum(quantity) AS BIGINT) AS total_quantity
            FROM ({_FIRST_ITEMS.format(bad="item_lost")}) i
            JOIN ({_FIRST_PRODUCTS}) p ON i.product_id = p.product_id GROUP BY 1
            ORDER BY total_quantity DESC, product_name NULLS FIRST LIMIT 5""",
    ),
    "flat_rejects": (flat_rejects, _rejects_sql("flat_bad", "flat_lost")),
    "flat_items": (
        flat_items,
        f"""{_LINES}
        SELECT l_orderkey AS order_id, lines.o_custkey AS customer_id, l_partkey AS product_id,
               name AS product_name, p_type AS category,
               p_brand NOT IN ('Brand#13')
               AND (p_type <> 'PROMO' OR p_brand IN ('Brand#7', 'Brand#22', 'Brand#5')) AS has_sign,
               CASE WHEN NOT price_bad THEN CAST(price AS DOUBLE) END AS amount,
               CASE WHEN p_brand = 'Brand#9' THEN '2.5' ELSE CAST(quantity AS VARCHAR) END
               AS quantity,
               placed AS order_date
        FROM lines JOIN exported ON l_orderkey = o_orderkey
        WHERE NOT lost AND NOT flat_lost
          AND (copy = 0 OR c_mktsegment NOT IN ('FURNITURE', 'BUILDING'))""",
    ),
    "flat_customers": (
        flat_customers,
        f"{_LINES} SELECT DISTINCT {_CUSTOMER_CELLS.format(cast='::VARCHAR')} FROM exported",
    ),
    "flat_orders": (
        flat_orders,
        _LINES
        + _CLEAN_ORDERS.replace(
            "CAST(left(o_orderpriority, 1) AS BIGINT)", "left(o_orderpriority, 1)"
        ),
    ),
    "item_rejects": (item_rejects, _rejects_sql("item_bad", "item_lost")),
    "product_rejects": (product_rejects, _rejects_sql("product_bad", "product_lost")),
    "props_key": (
        props_key,
        """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                  json_exists(props, '$.k') AS has_k, json_exists(props, '$.price') AS has_price
           FROM events""",
    ),
    "money_parse": (
        money_parse,
        """SELECT o_orderkey AS order_id,
                  CAST(CAST(regexp_replace(printf('$%,.2f', CAST(o_totalprice AS DECIMAL(12,2))),
                                           '[$,]', '', 'g') AS DECIMAL(18,6)) AS DOUBLE) AS total
           FROM orders""",
    ),
    "coerce_dates": (
        coerce_dates,
        """SELECT o_orderkey AS order_id,
                  try_cast(CASE WHEN o_orderstatus = 'P' THEN 'soon'
                                ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP)
                  AS order_date,
                  strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day
           FROM orders""",
    ),
    "dedupe_items": (
        dedupe_items,
        """SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line_number,
                  l_suppkey AS supplier_id,
                  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS price,
                  CAST(l_quantity AS BIGINT) AS quantity
           FROM lineitem
           QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey
             ORDER BY l_linenumber, l_suppkey, l_extendedprice, l_quantity) = 1""",
    ),
    "distinct_pairs": (
        distinct_pairs,
        "SELECT DISTINCT l_partkey AS product_id, l_suppkey AS supplier_id FROM lineitem",
    ),
    "items_semi_orders": (
        items_semi_orders,
        """SELECT l_orderkey AS order_id, l_partkey AS product_id,
                  CAST(l_quantity AS BIGINT) AS quantity,
                  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS price
           FROM lineitem
           WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    ),
}
