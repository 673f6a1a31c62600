"""The product catalogue: listing by category, and adding products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import default_if_empty, non_empty, price_label
from tillroll.operators.dedupe import merge_spellings
from tillroll.operators.numbering import assign_ids


def categories(products: DataFrame, collation: str | None = None) -> DataFrame:
    """Distinct categories, without NULL and the empty text."""
    found = products.select("category").where(non_empty("category")).distinct()
    return merge_spellings(found, "category", None, collation)


ID_RANGE = 100_000
"""Product ids per block. As ids are a key, a block of one category never holds more rows;
NULL ids, which a key excludes, would all be in block 0."""


def _listed(products: DataFrame) -> DataFrame:
    """Products with their block, their category's first-seen id, and the
    number of products the category has in earlier blocks.

    All counting per category runs on the blocks, and the products join their
    own block, so a category with very many products meets no task as a whole.
    """
    shown = products.select(
        "product_id",
        "name",
        default_if_empty("category").alias("category"),
        price_label("price").alias("price"),
        F.coalesce(F.expr(f"product_id div {ID_RANGE}"), F.lit(0)).alias("_block"),
    )
    blocks = shown.groupBy("category", "_block").agg(
        F.min("product_id").alias("_first"), F.count("*").alias("_rows")
    )
    category = Window.partitionBy("category")
    before = category.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(
        "category",
        "_block",
        F.min("_first").over(category).alias("first_seen"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
    )
    return shown.join(placed, ["category", "_block"])


def catalogue(products: DataFrame) -> DataFrame:
    """One row per product in display order.

    Categories come in the order in which their first product appears, and
    products by id. The sort is by range, so a large category spans tasks.
    """
    return (
        _listed(products)
        .select("category", "first_seen", "product_id", "name", "price")
        .orderBy("first_seen", "product_id")
    )


def catalogue_pages(products: DataFrame, page_size: int = 100) -> DataFrame:
    """The nested form: an array of at most ``page_size`` products per row.

    Pages restart with each category and follow the display order.
    """
    block = Window.partitionBy("category", "_block").orderBy("product_id")
    place = F.col("_before") + F.row_number().over(block) - 1
    return (
        _listed(products)
        .withColumn("page", F.floor(place / page_size) + 1)
        .groupBy("category", "first_seen", "page")
        .agg(F.array_sort(F.collect_list(F.struct("product_id", "name", "price"))).alias("products"))
    )


# --- on disk ----------------------------------------------------------------

SHELF = "category string, first_seen bigint, product_id bigint, name string, price string"


def write_catalogue(products: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write the listing, replacing the last one: a folder per category, its files in display order.

    The rows are dealt by range of the display order, so a large category is several files, each of
    ``rows_per_file`` rows at most, and small ones share a task.
    """
    kinds = {f.split()[0]: f.split()[1] for f in SHELF.split(", ")}
    listed = _listed(products).select(*[F.col(n).cast(t).alias(n) for n, t in kinds.items()])
    (
        listed.repartitionByRange("first_seen", "product_id")
        # the order that the writer needs to tell folders apart, and within each the display order
        .sortWithinPartitions("category", "product_id")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("category")
        .parquet(path)
    )


def read_catalogue(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """The stored listing in display order, or one category of it, of which only its folder is read."""
    held = spark.read.schema(SHELF).parquet(path)
    if category is not None:
        return held.where(F.col("category") == category).orderBy("product_id")
    return held.orderBy("first_seen", "product_id")


def validate_products(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch with ``reason``: NULL where the product may be added.

    A name is required, the price has to be an amount in range and on the 0.01
    grid, and the category has to be in use already.
    """
    price = F.col("price").cast("string")
    is_number = price.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    cents = price.try_cast("decimal(10,2)")
    # in range, eight digits stand before the point, which leaves thirty behind it
    exact = price.try_cast("decimal(38,30)")
    known = categories(existing).select(F.col("category").alias("_known"))
    tested = batch.join(known, F.col("category") == F.col("_known"), "left")
    reason = (
        F.when(~non_empty("name"), F.lit("name missing"))
        .when(~F.coalesce(is_number, F.lit(False)), F.lit("price is no amount"))
        .when(cents.isNull() | exact.isNull(), F.lit("price out of range"))
        .when(exact != cents, F.lit("price off the 0.01 grid"))
        .when(F.col("_known").isNull(), F.lit("unknown category"))
    )
    return tested.withColumn("reason", reason).drop("_known")


def append_products(
    existing: DataFrame, batch: DataFrame, order_by: list[str]
) -> tuple[DataFrame, DataFrame]:
    """The table with the valid part of the batch appended, and the rejects.

    New ids follow the largest existing one in ``order_by`` order. Columns the
    batch does not give, such as ``image_path``, are NULL.
    """
    tested = validate_products(existing, batch)
    price_type = existing.schema["price"].dataType
    accepted = assign_ids(
        existing, tested.where("reason IS NULL"), "product_id", order_by
    ).select("product_id", "name", "category", F.col("price").cast(price_type).alias("price"))
    table = existing.unionByName(accepted, allowMissingColumns=True)
    return table, tested.where("reason IS NOT NULL")
