"""Catalogue, integrity, numbering, source and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from query_set import bindings as b
from query_set.reports import as_double
from tillroll.functions import columns as c
from tillroll.functions.frames import lookup
from tillroll.operators import integrity as i
from tillroll.operators.dedupe import keep_first
from tillroll.operators.numbering import assign_ids, assign_reserved_ids, max_id, number_rows
from tillroll.operators.joins import semi_join
from tillroll.operators.ranking import first_match
from tillroll.plans import catalogue as cat
from tillroll.plans.checks import check_tables
from tillroll.schemas import CUSTOMERS, ORDER_ITEMS, ORDERS, PRODUCTS, Table
from tillroll.session import fresh_path
from tillroll.sources.batches import append_batch, read_batches, write_batch
from tillroll.sources.readers import load_table, read_csv, table
from tillroll.sources.sinks import append_rows, write_csv, write_table
from tillroll.sources.stored import declare_table, store_rows

# --- catalogue --------------------------------------------------------------


def _gappy_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products whose category is NULL or empty where the type says so."""
    gaps = (
        F.when(F.col("category") == "SMALL", F.lit(None))
        .when(F.col("category") == "LARGE", F.lit(""))
        .otherwise(F.col("category"))
    )
    return b.products(spark, sf).withColumn("category", gaps)


def categories(spark: SparkSession, sf: str) -> DataFrame:
    return cat.categories(_gappy_products(spark, sf))


def categories_collated(spark: SparkSession, sf: str) -> DataFrame:
    held = _gappy_products(spark, sf)
    mixed = F.when(F.col("price") > 1000, F.lower("category")).otherwise(F.col("category"))
    return cat.categories(held.withColumn("category", mixed), collation="UNICODE_CI_AI")


def default_category(spark: SparkSession, sf: str) -> DataFrame:
    return _gappy_products(spark, sf).select(
        "product_id", c.default_if_empty("category").alias("category")
    )


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return cat.catalogue(_gappy_products(spark, sf))


def catalogue_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = cat.catalogue_pages(_gappy_products(spark, sf), page_size=25)
    line = lambda p: F.concat_ws("|", p["product_id"], p["name"], p["price"])
    return pages.select(
        "category",
        "first_seen",
        "page",
        F.size("products").cast("bigint").alias("n"),
        F.array_join(F.transform("products", line), ";").alias("products"),
    )


def catalogue_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The listing as it is read back from its folders."""
    path = fresh_path(spark, "catalogue")
    cat.write_catalogue(_gappy_products(spark, sf), path, rows_per_file=5000)
    return cat.read_catalogue(spark, path).select("category", "first_seen", "product_id", "name", "price")


def catalogue_shelf(spark: SparkSession, sf: str) -> DataFrame:
    """One category of the stored listing: that of products without one."""
    path = fresh_path(spark, "catalogue")
    cat.write_catalogue(_gappy_products(spark, sf), path)
    return cat.read_catalogue(spark, path, "Uncategorized").select("product_id", "name", "price")


def customer_display(spark: SparkSession, sf: str) -> DataFrame:
    """Display name and balance; a missing part makes the name NULL."""
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return b.source(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        c.display_name(F.col("c_name"), segment).alias("customer_name"),
        c.price_label("c_acctbal").alias("balance"),
    )


def lookup_customer(spark: SparkSession, sf: str) -> DataFrame:
    found = lookup(b.source(spark, sf, "customer"), c_mktsegment="BUILDING", c_nationkey=7)
    return first_match(found.select("*"), "c_custkey")


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    """One offered product per supplier: its name, balance and a category.

    Some have no name, a price off the grid, or a category not in use.
    """
    nation = F.col("s_nationkey")
    return b.source(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("offer"),
        F.when(nation == 3, F.lit("")).otherwise(F.col("s_name")).alias("name"),
        F.when(nation == 5, F.lit("free"))
        .when(nation == 6, F.lit("1.005"))
        .otherwise(F.col("s_acctbal").cast(b.PRICE).cast("string"))
        .alias("price"),
        F.when(nation < 10, F.lit("SMALL"))
        .when(nation < 20, F.lit("PROMO"))
        .otherwise(F.lit("GARDEN"))
        .alias("category"),
    )


def append_products(spark: SparkSession, sf: str) -> DataFrame:
    existing = b.products(spark, sf).withColumn("image_path", F.lit(None).cast("string"))
    return as_double(cat.append_products(existing, _batch(spark, sf), ["offer"])[0], "price")


def append_rejects(spark: SparkSession, sf: str) -> DataFrame:
    tested = cat.validate_products(b.products(spark, sf), _batch(spark, sf))
    return tested.where("reason IS NOT NULL")


def append_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Append to a partitioned table that has one column more: old and new rows."""
    path = fresh_path(spark, "products")
    existing = b.products(spark, sf).withColumn("image_path", F.lit("shelf.png"))
    write_table(existing, path, partition_by=["category"])
    stored = table(spark, path)
    new = b.products(spark, sf).select("product_id", "name", "category", "price")
    numbered = assign_ids(stored, new.withColumnRenamed("product_id", "old"), "product_id", ["old"])
    append_rows(numbered.drop("old"), path, partition_by=["category"])
    return as_double(table(spark, path), "price")


def append_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Orders appended by status: one batch twice, and one that failed half-way and came again."""
    path = fresh_path(spark, "order-batches")
    orders = b.orders(spark, sf)
    of = lambda status: orders.where(F.col("status") == status)
    for _ in range(2):
        append_batch(of("F"), path, "finished")
    write_batch(of("O").where("order_id % 2 = 0"), path, "open")  # and then the writer died
    append_batch(of("O"), path, "open")
    write_batch(of("F"), path, "never-finished")
    append_batch(of("P"), path, "pending")
    return as_double(read_batches(spark, path), "total_price")


def append_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """Two writers number their products while neither has written: ids behind the largest one."""
    ledger = fresh_path(spark, "id-ledger")
    existing, offers = b.products(spark, sf), _batch(spark, sf)
    batches = {"even": offers.where("offer % 2 = 0"), "odd": offers.where("offer % 2 = 1")}
    named = {
        name: assign_reserved_ids(existing, batch, "product_id", ["offer"], ledger, name)
        for name, batch in batches.items()
    }
    again = assign_reserved_ids(existing, batches["even"], "product_id", ["offer"], ledger, "even")
    both = named["odd"].unionByName(again)
    return both.select("product_id", "offer", "name")


def next_product_id(spark: SparkSession, sf: str) -> DataFrame:
    products = b.products(spark, sf)
    return max_id(products, "product_id").select(
        "max_id", (F.col("max_id") + F.lit(1)).alias("next_id")
    )


# --- numbering --------------------------------------------------------------


def assign_row_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids for the de-duplicated order items, from 5 on."""
    items = b.order_items(spark, sf)
    first = keep_first(
        items, ["order_id", "product_id"], ["line_number", "supplier_id", "price", "quantity"]
    )
    return number_rows(first.select("order_id", "product_id"), ["order_id", "product_id"], start=5)


# --- integrity --------------------------------------------------------------


def pk_violations(spark: SparkSession, sf: str) -> DataFrame:
    return i.check_pk(b.order_items(spark, sf), ["order_id", "line_number"])


def pk_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """A key that is NULL on some rows and unique on the others."""
    key = F.when(F.col("status") != "P", F.col("order_id"))
    found = i.check_pk(b.orders(spark, sf).select(key.alias("order_id")), ["order_id"])
    return found.select(F.col("order_id").isNull().alias("is_null"), "n")


def _stored(spark: SparkSession, df: DataFrame, target: Table, buckets: int | None = None) -> DataFrame:
    """Rows behind a write to a declared table, by order in buckets if a number is given."""
    name = f"{target.name}_{uuid.uuid4().hex}"
    key = "order_id" if buckets else None
    declare_table(spark, target, name, fresh_path(spark, name), key, buckets)
    store_rows(df, target, name)
    return table(spark, name)


def _stored_orders_and_items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both tables by order; returned open lines point to unknown orders."""
    strayed = (F.col("return_flag") == "R") & (F.col("line_status") == "O")
    order_id = F.when(strayed, -F.col("order_id") - 1).otherwise(F.col("order_id"))
    lines = b.order_items(spark, sf).select(
        order_id.alias("order_id"), "product_id", "quantity", "price"
    )
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = b.orders(spark, sf).drop("status")
    return _stored(spark, orders, ORDERS, buckets), _stored(spark, lines, ORDER_ITEMS, buckets)


def fk_items_orders_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of unknown orders, from tables that are laid out by order."""
    orders, items = _stored_orders_and_items(spark, sf)
    found = i.check_fk(items, orders, "order_id")
    return as_double(found.select("order_id", "product_id", "quantity", "price"), "price")


def items_semi_orders_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the orders since 1996, from tables that are laid out by order."""
    orders, items = _stored_orders_and_items(spark, sf)
    late = orders.where("order_date >= TIMESTAMP_NTZ '1996-01-01 00:00:00'")
    kept = semi_join(items, late, "order_id")
    return as_double(kept.select("order_id", "product_id", "quantity", "price"), "price")


def _mixed_names(spark: SparkSession, sf: str) -> DataFrame:
    """Product names in mixed case and with accents, by size."""
    size = F.col("p_size")
    name = (
        F.when(size > 35, F.upper("p_name"))
        .when(size > 20, F.translate("p_name", "eo", "éö"))
        .otherwise(F.col("p_name"))
    )
    return b.source(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), name.alias("name")
    )


def unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    return i.check_unique(_mixed_names(spark, sf), "name", "UNICODE_CI_AI")


def unique_violations_binary(spark: SparkSession, sf: str) -> DataFrame:
    return i.check_unique(_mixed_names(spark, sf), "name")


def collated_names(spark: SparkSession, sf: str) -> DataFrame:
    """Products whose name equals a text up to case and accents."""
    names = _mixed_names(spark, sf)
    return names.where(c.collated("name") == F.lit("RED WIDGET"))


def fk_orders_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of one priority point to unknown customers, those of another to none."""
    priority = F.col("total_quantity")
    customer = (
        F.when(priority == 4, -F.col("customer_id") - 1)
        .when(priority == 5, F.lit(None))
        .otherwise(F.col("customer_id"))
    )
    orders = b.orders(spark, sf).select("order_id", customer.alias("customer_id"))
    return i.check_fk(orders, b.customers(spark, sf), "customer_id")


def fk_items_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Returned open lines point to unknown orders."""
    strayed = (F.col("return_flag") == "R") & (F.col("line_status") == "O")
    order_id = F.when(strayed, -F.col("order_id") - 1).otherwise(F.col("order_id"))
    items = b.order_items(spark, sf).select(
        order_id.alias("order_id"), "product_id", "line_number", "quantity"
    )
    return i.check_fk(items, b.orders(spark, sf), "order_id")


def orders_without_items(spark: SparkSession, sf: str) -> DataFrame:
    orders = b.orders(spark, sf).select("order_id", "customer_id")
    return i.check_fk(orders, b.order_items(spark, sf), "order_id")


def null_violations(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.when(F.col("last_name") != "BUILDING", F.col("last_name"))
    held = b.customers(spark, sf).withColumn("last_name", segment)
    return i.check_not_null(held, ["customer_id", "last_name"])


def length_violations(spark: SparkSession, sf: str) -> DataFrame:
    limits = {"name": 10, "category": 7}
    return i.check_length(b.products(spark, sf).select("product_id", "name", "category"), limits)


def decimal_violations(spark: SparkSession, sf: str) -> DataFrame:
    held = b.source(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return i.check_decimal(held, "o_totalprice", 7, 2)


def scale_violations(spark: SparkSession, sf: str) -> DataFrame:
    held = b.source(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return i.check_decimal(held, "o_totalprice", 12, 1, exact=True)


# --- sources and sinks ------------------------------------------------------


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    orders = b.orders(spark, sf)
    write_csv(orders, path)
    return as_double(read_csv(spark, path, orders.schema), "total_price")


def csv_quoting(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with quotes, commas, line breaks and blanks at the ends."""
    path = fresh_path(spark, "csv")
    note = F.concat(
        F.lit(' "'), F.col("p_name"), F.lit('", \\'), F.col("p_brand"), F.lit("\n ")
    )
    held = b.source(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), note.alias("note")
    )
    write_csv(held, path)
    return read_csv(spark, path, "product_id bigint, note string")


def _cleaned_csv(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    path = fresh_path(spark, "cleaned")
    write_csv(df, path)
    return read_csv(spark, path)


def typed_load(spark: SparkSession, sf: str) -> DataFrame:
    """Orders from cleaned CSV text into the typed table."""
    orders = b.orders(spark, sf).drop("status")
    return as_double(load_table(_cleaned_csv(spark, sf, orders), ORDERS), "total_price")


def stored_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers from cleaned CSV text, through a table that enforces their definition."""
    return _stored(spark, _cleaned_csv(spark, sf, _customer_cells(spark, sf)), CUSTOMERS)


def stored_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products from cleaned CSV text, through a table that enforces their definition."""
    held = b.products(spark, sf).withColumnRenamed("name", "product_name")
    return as_double(_stored(spark, _cleaned_csv(spark, sf, held), PRODUCTS), "price")


def typed_load_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products with the file's headers; prices with three decimals are rounded."""
    tenths = (F.col("price") + F.lit("0.005").cast("decimal(4,3)")).cast("decimal(13,3)")
    held = b.products(spark, sf).select(
        "product_id", F.col("name").alias("product_name"), "category", tenths.alias("price")
    )
    return as_double(load_table(_cleaned_csv(spark, sf, held), PRODUCTS), "price")


def _customer_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the file's headers."""
    return b.source(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_first_name"),
        F.col("c_mktsegment").alias("customer_last_name"),
        F.when(F.col("c_nationkey") < 12, "FEMALE").otherwise("MALE").alias("customer_gender"),
        F.concat(F.lower("c_name"), F.lit("@shop.test")).alias("email"),
        F.col("c_nationkey").alias("customer_phone"),
    )


def typed_load_customers(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(_cleaned_csv(spark, sf, _customer_cells(spark, sf)), CUSTOMERS)


def typed_load_items(spark: SparkSession, sf: str) -> DataFrame:
    """Order items from cleaned CSV text, numbered on load."""
    held = b.order_items(spark, sf).select("order_id", "product_id", "quantity", "price")
    return as_double(load_table(_cleaned_csv(spark, sf, held), ORDER_ITEMS), "price")


def table_violations(spark: SparkSession, sf: str) -> DataFrame:
    """All rules of two tables, over rows that break each kind of them.

    Customers of one segment lose their id, those of another have too long a name;
    orders of one priority point to nobody, those of another cost too much.
    """
    segment, priority = F.col("last_name"), F.col("total_quantity")
    customer_id = F.when(segment != "BUILDING", F.col("customer_id"))
    last_name = F.when(segment == "MACHINERY", F.repeat(segment, 6)).otherwise(segment)
    held = {
        "customers": b.customers(spark, sf).select(
            customer_id.alias("customer_id"),
            "first_name",
            last_name.alias("last_name"),
            *[F.lit(None).cast("string").alias(n) for n in ("gender", "email", "phone")],
        ),
        "orders": b.orders(spark, sf).select(
            "order_id",
            F.when(priority == 4, -F.col("customer_id")).otherwise(F.col("customer_id")).alias(
                "customer_id"
            ),
            "order_date",
            "total_quantity",
            F.when(priority == 5, F.col("total_price") + 100_000_000)
            .otherwise(F.col("total_price"))
            .cast("decimal(12,2)")
            .alias("total_price"),
        ),
    }
    return check_tables(held)


_PERTURBED = """
WITH held_customers AS (
  SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS customer_id,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN repeat(c_mktsegment, 6) ELSE c_mktsegment END
         AS last_name
  FROM customer
), held_orders AS (
  SELECT CASE WHEN left(o_orderpriority, 1) = '4' THEN -o_custkey ELSE o_custkey END AS customer_id,
         CAST(CAST(o_totalprice AS DECIMAL(12,2))
              + CASE WHEN left(o_orderpriority, 1) = '5' THEN 100000000 ELSE 0 END
              AS DECIMAL(12,2)) AS total_price
  FROM orders
)
"""

_GAPPY = """
SELECT p_partkey AS product_id, p_name AS name,
       coalesce(nullif(CASE p_type WHEN 'SMALL' THEN NULL WHEN 'LARGE' THEN '' ELSE p_type END, ''),
                'Uncategorized') AS category,
       CAST(p_retailprice AS DECIMAL(12,2)) AS price
FROM part
"""

_SHOWN = f"""
SELECT category, min(product_id) OVER (PARTITION BY category) AS first_seen, product_id, name,
       '$' || price AS price
FROM ({_GAPPY})
"""

_OFFERS = """
SELECT s_suppkey AS offer, CASE WHEN s_nationkey = 3 THEN '' ELSE s_name END AS name,
       CASE s_nationkey WHEN 5 THEN 'free' WHEN 6 THEN '1.005'
            ELSE CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR) END AS price,
       CASE WHEN s_nationkey < 10 THEN 'SMALL' WHEN s_nationkey < 20 THEN 'PROMO'
            ELSE 'GARDEN' END AS category,
       CASE WHEN s_nationkey = 3 THEN 'name missing'
            WHEN s_nationkey = 5 THEN 'price is no amount'
            WHEN s_nationkey = 6 THEN 'price off the 0.01 grid'
            WHEN s_nationkey >= 20 THEN 'unknown category' END AS reason
FROM supplier
"""

_CUSTOMER_TABLE = """SELECT c_custkey AS customer_id, c_name AS first_name, c_mktsegment AS last_name,
                  CASE WHEN c_nationkey < 12 THEN 'FEMALE' ELSE 'MALE' END AS gender,
                  lower(c_name) || '@shop.test' AS email,
                  CAST(c_nationkey AS VARCHAR) AS phone
           FROM customer"""

_STRAYED = """
SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN -l_orderkey - 1 ELSE l_orderkey END
       AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
       CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS price
FROM lineitem
"""

_NAMES = """
SELECT p_partkey AS product_id,
       CASE WHEN p_size > 35 THEN upper(p_name) WHEN p_size > 20 THEN translate(p_name, 'eo', 'éö')
            ELSE p_name END AS name
FROM part
"""

QUERIES = {
    "categories": (
        categories,
        "SELECT DISTINCT p_type AS category FROM part WHERE p_type NOT IN ('SMALL', 'LARGE')",
    ),
    "categories_collated": (
        categories_collated,
        """SELECT min(category) AS category
           FROM (SELECT CASE WHEN CAST(p_retailprice AS DECIMAL(12,2)) > 1000 THEN lower(p_type)
                             ELSE p_type END AS category
                 FROM part WHERE p_type NOT IN ('SMALL', 'LARGE'))
           GROUP BY lower(category)""",
    ),
    "default_category": (default_category, f"SELECT product_id, category FROM ({_GAPPY})"),
    "catalogue": (catalogue, _SHOWN),
    "catalogue_stored": (catalogue_stored, _SHOWN),
    "catalogue_shelf": (
        catalogue_shelf,
        f"SELECT product_id, name, price FROM ({_SHOWN}) WHERE category = 'Uncategorized'",
    ),
    "catalogue_pages": (
        catalogue_pages,
        f"""SELECT category, first_seen, page, count(*) AS n,
                   string_agg(product_id || '|' || name || '|' || price, ';' ORDER BY product_id)
                   AS products
            FROM (SELECT *, (row_number() OVER (PARTITION BY category ORDER BY product_id) - 1)
                         // 25 + 1 AS page
                  FROM ({_SHOWN}))
            GROUP BY 1, 2, 3""",
    ),
    "customer_display": (
        customer_display,
        """SELECT c_custkey AS customer_id,
                  c_name || ' ' || CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END
                  AS customer_name,
                  '$' || CAST(c_acctbal AS DECIMAL(12,2)) AS balance
           FROM customer""",
    ),
    "lookup_customer": (
        lookup_customer,
        """SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7
           ORDER BY c_custkey LIMIT 1""",
    ),
    "append_products": (
        append_products,
        f"""SELECT p_partkey AS product_id, p_name AS name, p_type AS category,
                   CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price,
                   CAST(NULL AS VARCHAR) AS image_path FROM part
            UNION ALL
            SELECT (SELECT coalesce(max(p_partkey), 0) FROM part)
                   + row_number() OVER (ORDER BY offer), name, category,
                   CAST(CAST(price AS DECIMAL(12,2)) AS DOUBLE), NULL
            FROM ({_OFFERS}) WHERE reason IS NULL""",
    ),
    "append_rejects": (append_rejects, f"SELECT * FROM ({_OFFERS}) WHERE reason IS NOT NULL"),
    "append_sink": (
        append_sink,
        """SELECT p_partkey AS product_id, p_name AS name, p_type AS category,
                  CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price,
                  'shelf.png' AS image_path FROM part
           UNION ALL
           SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY p_partkey),
                  p_name, p_type, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE), NULL
           FROM part""",
    ),
    "append_batches": (
        append_batches,
        """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
                  CAST(left(o_orderpriority, 1) AS BIGINT) AS total_quantity,
                  CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total_price,
                  o_orderstatus AS status
           FROM orders""",
    ),
    "append_side_by_side": (
        append_side_by_side,
        f"""WITH offers AS ({_OFFERS})
            SELECT (SELECT max(p_partkey) FROM part)
                   + row_number() OVER (ORDER BY offer % 2, offer) AS product_id, offer, name
            FROM offers""",
    ),
    "stored_products": (
        stored_products,
        """SELECT p_partkey AS product_id, p_name AS name, p_type AS category,
                  CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS price,
                  CAST(NULL AS VARCHAR) AS image_path
           FROM part""",
    ),
    "stored_customers": (stored_customers, _CUSTOMER_TABLE),
    "fk_items_orders_stored": (
        fk_items_orders_stored,
        f"SELECT * FROM ({_STRAYED}) i WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = i.order_id)",
    ),
    "items_semi_orders_stored": (
        items_semi_orders_stored,
        f"""SELECT * FROM ({_STRAYED}) WHERE order_id IN
            (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')""",
    ),
    "next_product_id": (
        next_product_id,
        """SELECT coalesce(max(p_partkey), 0) AS max_id, coalesce(max(p_partkey), 0) + 1 AS next_id
           FROM part""",
    ),
    "assign_row_ids": (
        assign_row_ids,
        """SELECT order_id, product_id, row_number() OVER (ORDER BY order_id, product_id) + 4 AS id
           FROM (SELECT DISTINCT l_orderkey AS order_id, l_partkey AS product_id FROM lineitem)""",
    ),
    "pk_violations": (
        pk_violations,
        """SELECT l_orderkey AS order_id, l_linenumber AS line_number, count(*) AS n
           FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    ),
    "pk_nulls": (
        pk_nulls,
        """SELECT true AS is_null, count(*) AS n FROM orders
           WHERE o_orderstatus = 'P'""",
    ),
    "unique_violations": (
        unique_violations,
        f"""SELECT min(name) AS name, count(*) AS n FROM ({_NAMES})
            GROUP BY lower(strip_accents(name)) HAVING count(*) > 1""",
    ),
    "unique_violations_binary": (
        unique_violations_binary,
        f"SELECT name, count(*) AS n FROM ({_NAMES}) GROUP BY name HAVING count(*) > 1",
    ),
    "collated_names": (
        collated_names,
        f"SELECT * FROM ({_NAMES}) WHERE lower(strip_accents(name)) = 'red widget'",
    ),
    "fk_orders_customers": (
        fk_orders_customers,
        """SELECT o_orderkey AS order_id, -o_custkey - 1 AS customer_id FROM orders
           WHERE -o_custkey - 1 NOT IN (SELECT c_custkey FROM customer)
             AND o_orderpriority = '4-NOT SPECIFIED'""",
    ),
    "fk_items_orders": (
        fk_items_orders,
        """SELECT order_id, product_id, line_number, quantity FROM (
             SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN -l_orderkey - 1
                         ELSE l_orderkey END AS order_id, l_partkey AS product_id,
                    l_linenumber AS line_number, CAST(l_quantity AS BIGINT) AS quantity
             FROM lineitem) i
           WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = i.order_id)""",
    ),
    "orders_without_items": (
        orders_without_items,
        """SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders
           WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    ),
    "null_violations": (
        null_violations,
        """SELECT c_custkey AS customer_id, c_name AS first_name, CAST(NULL AS VARCHAR) AS last_name
           FROM customer WHERE c_mktsegment = 'BUILDING'""",
    ),
    "length_violations": (
        length_violations,
        """SELECT p_partkey AS product_id, p_name AS name, p_type AS category FROM part
           WHERE length(p_name) > 10 OR length(p_type) > 7""",
    ),
    "decimal_violations": (
        decimal_violations,
        """SELECT o_orderkey, o_totalprice FROM orders
           WHERE try_cast(o_totalprice AS DECIMAL(7,2)) IS NULL""",
    ),
    "scale_violations": (
        scale_violations,
        """SELECT o_orderkey, o_totalprice FROM orders
           WHERE CAST(o_totalprice AS DECIMAL(12,1)) <> CAST(o_totalprice AS DECIMAL(14,2))""",
    ),
    "csv_roundtrip": (
        csv_roundtrip,
        """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
                  CAST(left(o_orderpriority, 1) AS BIGINT) AS total_quantity,
                  CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total_price,
                  o_orderstatus AS status
           FROM orders""",
    ),
    "csv_quoting": (
        csv_quoting,
        r"""SELECT p_partkey AS product_id,
                   ' "' || p_name || '", \' || p_brand || chr(10) || ' ' AS note
            FROM part""",
    ),
    "typed_load": (
        typed_load,
        """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
                  CAST(left(o_orderpriority, 1) AS BIGINT) AS total_quantity,
                  CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE) AS total_price
           FROM orders""",
    ),
    "typed_load_products": (
        typed_load_products,
        """SELECT p_partkey AS product_id, p_name AS name, p_type AS category,
                  CAST(CAST(p_retailprice AS DECIMAL(10,2)) + CAST(0.01 AS DECIMAL(10,2)) AS DOUBLE)
                  AS price, CAST(NULL AS VARCHAR) AS image_path
           FROM part""",
    ),
    "typed_load_customers": (
        typed_load_customers,
        _CUSTOMER_TABLE,
    ),
    "typed_load_items": (
        typed_load_items,
        """SELECT row_number() OVER (ORDER BY order_id, product_id, quantity, price) AS id, *
           FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id,
                        CAST(l_quantity AS BIGINT) AS quantity,
                        CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS price
                 FROM lineitem)""",
    ),
    "table_violations": (
        table_violations,
        f"""{_PERTURBED}
            SELECT 'customers' AS "table", 'key' AS rule, 'customer_id' AS "column",
                   coalesce(CAST(customer_id AS VARCHAR), '') AS value, count(*) AS n
            FROM held_customers GROUP BY customer_id
            HAVING count(*) > 1 OR customer_id IS NULL
            UNION ALL SELECT 'customers', 'required', 'customer_id', NULL, 1
            FROM held_customers WHERE customer_id IS NULL
            UNION ALL SELECT 'customers', 'length', 'last_name', last_name, 1
            FROM held_customers WHERE length(last_name) > 50
            UNION ALL SELECT 'orders', 'reference', 'customer_id', CAST(customer_id AS VARCHAR), 1
            FROM held_orders o WHERE customer_id IS NOT NULL
              AND NOT EXISTS (SELECT 1 FROM held_customers c WHERE c.customer_id = o.customer_id)
            UNION ALL SELECT 'orders', 'range', 'total_price', CAST(total_price AS VARCHAR), 1
            FROM held_orders WHERE abs(total_price) >= 100000000""",
    ),
}
