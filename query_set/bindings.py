"""The shop's tables over the given test tables, and a raw export built from them.

Money is cast to decimal on entry. Columns the test tables lack are derived
from others: the last name is the market segment, the total quantity the digit
of the order priority, the category the part type.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillroll.functions.frames import null_tokens
from tillroll.markers import published
from tillroll.schemas import EXPORT_COLUMNS
from tillroll.session import fresh_path
from tillroll.sources.readers import file_batches

PRICE = "decimal(12,2)"


_schemas: dict[str, StructType] = {}


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once, which is a job of its own."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return source(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
    )


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return source(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.left("o_orderpriority", F.lit(1)).cast("bigint").alias("total_quantity"),
        F.col("o_totalprice").cast(PRICE).alias("total_price"),
        F.col("o_orderstatus").alias("status"),
    )


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    return source(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").cast(PRICE).alias("price"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    return source(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast(PRICE).alias("price"),
    )


# --- raw export -------------------------------------------------------------


def _element() -> Column:
    """JSON text of one line, with the defects its product's brand stands for."""
    brand = F.col("p_brand")
    amount = F.col("l_extendedprice").cast(PRICE)
    price = (
        F.when(brand == "Brand#13", F.lit("oops"))
        .when(brand == "Brand#7", F.concat(F.lit("$"), F.format_number(amount, 2)))
        .otherwise(F.concat(F.lit("$"), amount.cast("string")))
    )
    quantity = F.when(brand == "Brand#9", F.lit("2.5")).otherwise(
        F.col("l_quantity").cast("bigint").cast("string")
    )
    name = F.when(brand == "Brand#17", F.lit("")).otherwise(F.col("p_name"))
    category = F.when(brand != "Brand#21", F.col("p_type"))
    head = F.col("l_partkey").alias("product_id")
    tail = [category.alias("category"), quantity.alias("quantity")]
    named = F.to_json(F.struct(head, name.alias("product_name"), price.alias("price"), *tail))
    # a number in place of a text, and a JSON null in place of a name
    plain = F.to_json(F.struct(head, name.alias("product_name"), amount.alias("price"), *tail))
    unnamed = F.to_json(
        F.struct(
            head, F.lit(None).cast("string").alias("product_name"), price.alias("price"), *tail
        ),
        {"ignoreNullFields": "false"},
    )
    # a key given twice, of which the last value counts
    twice = F.concat(F.lit('{"quantity":"x",'), F.ltrim(named, F.lit("{")))
    return (
        F.when(brand == "Brand#22", unnamed)
        .when(brand == "Brand#5", twice)
        .when((F.col("p_type") == "PROMO") & ~brand.isin("Brand#13", "Brand#7"), plain)
        .otherwise(named)
    )


def to_raw_orders(lines: DataFrame) -> DataFrame:
    """Lines with an element text gathered into one document per order.

    A row of the export is an order with all its lines, so its size is the
    order's; lines are in a fixed order. They are shuffled before they are gathered:
    gathering in front of the shuffle joins almost none, and sorts, and spills, whole files.
    """
    place = ["l_partkey", "l_extendedprice", "l_quantity", "element"]
    gathered = lines.repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(*place))).alias("_lines")
    )
    texts = F.array_join(F.transform("_lines", lambda line: line.element), ",")
    return gathered.select("l_orderkey", F.concat(F.lit("["), texts, F.lit("]")).alias("document"))


def _products_text() -> Column:
    """The document as the export writes it, with defects by status and priority."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    document = F.col("document")
    quoted = F.concat(F.lit('"'), F.replace(document, F.lit('"'), F.lit('""')), F.lit('"'))
    return (
        F.when(document.isNull(), F.lit(None))
        .when((status == "P") & (priority == "5-LOW"), F.lit("not json"))
        .when(
            (status == "O") & (priority == "2-HIGH"),
            F.concat(F.lit('{"items":'), document, F.lit("}")),
        )
        .when(
            (status == "F") & (priority == "4-NOT SPECIFIED"),
            F.concat(document, F.lit(" end")),
        )
        .when((status == "F") & (priority == "2-HIGH"), F.concat(document, F.lit(',"x":1')))
        .when(status == "F", document)
        .otherwise(quoted)
    )


def _build_raw(spark: SparkSession, sf: str) -> DataFrame:
    lines = (
        source(spark, sf, "lineitem")
        .select(
            "l_orderkey",
            "l_partkey",
            "l_extendedprice",
            "l_quantity",
        )
        .join(source(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_orderkey",
            "l_partkey",
            "l_extendedprice",
            "l_quantity",
            _element().alias("element"),
        )
    )
    documents = to_raw_orders(lines)
    # customers first, so that no document is shuffled again for them
    bought = source(spark, sf, "orders").join(
        source(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    placed = bought.join(documents, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    # an urgent order is exported twice, the second time with another phone
    copies = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    segment = F.col("c_mktsegment")
    phone = (
        F.when(segment == "FURNITURE", F.lit(None))
        .when(segment == "BUILDING", F.lit("nan"))
        .otherwise(F.concat_ws("-", "c_nationkey", "o_orderkey", "copy"))
    )
    bad_date = (F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderstatus") == "O")
    cells = {
        "order_id": F.col("o_orderkey"),
        "customer_id": F.col("o_custkey"),
        "order_date": F.when(bad_date, F.lit("bad")).otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
        ),
        "total_quantity": F.left("o_orderpriority", F.lit(1)),
        "taxful_total_price": F.concat(
            F.lit("$"), F.format_number(F.col("o_totalprice").cast(PRICE), 2)
        ),
        "customer_first_name": F.col("c_name"),
        "customer_last_name": segment,
        "customer_gender": F.when(F.col("c_nationkey") < 12, F.lit("FEMALE")).otherwise(
            F.lit("MALE")
        ),
        "email": F.concat(F.lower("c_name"), F.lit("@shop.test")),
        "customer_phone": phone,
        "geoip.region_name": F.when(
            segment != "MACHINERY", F.concat(F.lit("NATION_"), F.col("c_nationkey"))
        ),
        "products": _products_text(),
    }
    return placed.withColumn("copy", F.explode(copies)).select(
        *[cells[c].cast("string").alias(c) for c in EXPORT_COLUMNS],
        F.struct(
            F.col("o_orderkey").alias("order_id"),
            "copy",
        ).alias("seq"),
    )


_written: dict[tuple[str, str, str], tuple[str, Any]] = {}


def once(spark: SparkSession, sf: str, label: str, write: Callable[[str], Any]) -> Any:
    """What ``write`` returns for a new path; called once per application and data folder, and
    again when the path has been deleted since."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _written or not published(spark, _written[key][0]):
        path = fresh_path(spark, label)
        _written[key] = (path, write(path))
    return _written[key][1]


def _export_path(spark: SparkSession, sf: str) -> str:
    def write(path: str) -> str:
        _build_raw(spark, sf).write.parquet(path)
        return path

    return once(spark, sf, "export", write)


def raw_export(spark: SparkSession, sf: str) -> DataFrame:
    """The raw export of a whole data folder, written once per application."""
    return null_tokens(spark.read.parquet(_export_path(spark, sf)), EXPORT_COLUMNS)


def raw_batches(spark: SparkSession, sf: str, size: int) -> list[DataFrame]:
    """The same in parts, each of files of at most ``size`` bytes, or of one larger file."""
    path = _export_path(spark, sf)
    schema = spark.read.parquet(path).schema
    batches = file_batches(spark, path, size)
    return [null_tokens(spark.read.schema(schema).parquet(*files), EXPORT_COLUMNS) for files in batches]


def wide_export(spark: SparkSession, sf: str) -> DataFrame:
    """Export rows whose prices have 13 digits before the point, or 8 decimals."""
    amount = F.col("l_extendedprice").cast(PRICE)
    price = F.when(
        F.col("l_linenumber") % 2 == 0,
        F.concat(F.lit("$"), (amount + F.lit(10**12)).cast("string")),
    ).otherwise(F.concat(F.lit("$"), amount.cast("string"), F.lit("000001")))
    element = F.to_json(
        F.struct(
            F.col("l_partkey").alias("product_id"),
            price.alias("price"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
        )
    )
    documents = to_raw_orders(source(spark, sf, "lineitem").withColumn("element", element))
    return documents.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("document").alias("products"),
        F.col("l_orderkey").alias("seq"),
    )
