"""From the denormalised order export to customers, orders, items and products.

Every function takes the raw frame: the export's text columns and ``seq``, any
sortable column that gives the source order (see ``read_export``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import as_money, coerce_timestamp, money_text, parse_int
from tillroll.functions.frames import fill_nulls
from tillroll.functions.nested import (
    explode_items,
    parse_fields,
    prefix_length,
    valid_prefix,
)
from tillroll.operators.dedupe import distinct_rows, keep_first
from tillroll.operators.joins import semi_join
from tillroll.schemas import CUSTOMERS
from tillroll.session import staged
from tillroll.sources.sinks import write_all, write_csv, write_table

CUSTOMER_COLUMNS = tuple(c.header for c in CUSTOMERS.columns)

# Export columns of an order, and keys of a line item.
ORDER_COLUMNS = ("order_id", "customer_id", "order_date", "total_quantity", "taxful_total_price")
ITEM_KEYS = ("product_id", "product_name", "category", "price", "quantity")

# What a missing cell is filled with.
EXPORT_DEFAULTS = {"customer_phone": "N/A", "geoip.region_name": "Unknown"}


# --- customers and orders ---------------------------------------------------


def build_customers(raw: DataFrame) -> DataFrame:
    """One row per customer id, the first in source order; missing phone filled."""
    subset = raw.select(*CUSTOMER_COLUMNS, "seq")
    filled = fill_nulls(subset, {"customer_phone": EXPORT_DEFAULTS["customer_phone"]})
    typed = filled.withColumn("customer_id", parse_int("customer_id"))
    return keep_first(typed, ["customer_id"], ["seq"]).drop("seq")


def build_orders(raw: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    """One row per order id, the first in source order.

    A bad date becomes NULL (see ``bad_dates``); a total that is no amount fails the run.
    """
    typed = raw.select(
        parse_int("order_id").alias("order_id"),
        parse_int("customer_id").alias("customer_id"),
        coerce_timestamp("order_date", date_formats).alias("order_date"),
        parse_int("total_quantity").alias("total_quantity"),
        money_text("taxful_total_price", strict=True).alias("total_price"),
        "seq",
    )
    first = keep_first(typed, ["order_id"], ["seq"]).drop("seq")
    return first.withColumn("total_price", as_money("total_price"))


# --- line items -------------------------------------------------------------


def _items_ok(e: Column) -> Column:
    """The items pass needs id, quantity and price to parse."""
    return e["product_id"].isNotNull() & e["quantity"].isNotNull() & e["price_text"].isNotNull()


def _products_ok(e: Column) -> Column:
    """The products pass needs id and price to parse, and name and category to exist."""
    return e["product_id"].isNotNull() & e["price_text"].isNotNull() & e["named"]


def _flat_ok(e: Column) -> Column:
    """The flat pass needs all keys to exist, and parses nothing."""
    return e["complete"]


PASSES = {"items": _items_ok, "products": _products_ok, "flat": _flat_ok}


# What the keys of a line item are read as.
ITEM_TYPES = {
    "product_id": "bigint",
    "price": "string",
    "quantity": "bigint",
    "product_name": "string",
    "category": "string",
}


def _pass_keys(passes: Sequence[str]) -> tuple[dict[str, str], tuple[str, ...]]:
    """The keys that the passes read, with their types, and those that have to exist."""
    flat, products = "flat" in passes, "products" in passes
    present = ITEM_KEYS if flat else ("product_name", "category") if products else ()
    read = {"product_id", "price", *present} | ({"quantity"} if "items" in passes else set())
    return {k: t for k, t in ITEM_TYPES.items() if k in read}, present


def _item_fields(e: Column, has: Callable[[str], Column], passes: Sequence[str]) -> Column:
    """The element's fields that the passes look at."""
    fields = [
        e["product_id"].alias("product_id"),
        money_text(e["price"], strip="$").alias("price_text"),
    ]
    if "items" in passes:
        fields.append(e["quantity"].alias("quantity"))
    if "products" in passes:
        fields += [
            e["product_name"].alias("product_name"),
            e["category"].alias("category"),
            (has("product_name") & has("category")).alias("named"),
        ]
    if "flat" in passes:
        fields.append(reduce(and_, [has(k) for k in ITEM_KEYS]).alias("complete"))
    return F.struct(*fields)


def parse_rows(
    raw: DataFrame,
    passes: Sequence[str] = ("items", "products"),
    raw_text: bool = False,
    wrapped_only: bool = False,
) -> DataFrame:
    """The export's rows with ``_items``, the parsed elements, and per pass
    ``<pass>_prefix``, the number of elements before the first one it rejects.

    The prefixes are taken before the explode, so the array is not carried
    along with each of its elements. ``raw_text`` adds ``_texts``, the texts of the elements from the
    first one on that some pass rejects.
    """
    types, present = _pass_keys(passes)
    parsed = parse_fields(
        "products",
        types,
        lambda e, has: _item_fields(e, has, passes),
        present,
        wrapped_only,
        (lambda e: ~reduce(and_, [PASSES[p](e) for p in passes])) if raw_text else None,
    )
    prefixes = {f"{p}_prefix": prefix_length(F.col("_items"), PASSES[p]) for p in passes}
    rows = raw.withColumn("_parsed", parsed).withColumn("_items", F.col("_parsed.items")).withColumns(prefixes)
    if raw_text:
        texts = F.col("_parsed.texts")
        rows = rows.withColumn("_texts", F.slice(texts, _first_lost(passes) + 1, F.size(texts)))
    return rows.drop("_parsed")


def _first_lost(passes: Sequence[str]) -> Column:
    """The number of elements before the first one that some pass rejects."""
    prefixes = [F.col(f"{p}_prefix") for p in passes]
    return F.least(*prefixes) if len(prefixes) > 1 else prefixes[0]


def elements_of(rows: DataFrame, passes: Sequence[str] = ("items", "products")) -> DataFrame:
    """One row per element of parsed rows; rows without an array vanish.

    A pass keeps what comes before a bad element (``pos`` below its prefix
    length) and loses it and the rest (see ``rejects``). ``<pass>_ok`` tells
    about the element alone.
    """
    place = ("order_id", "seq", *[f"{p}_prefix" for p in passes])
    return (
        rows.withColumn("order_id", parse_int("order_id"))
        .select(*place, explode_items(F.col("_items")))
        .select(
            *place,
            "pos",
            "item.*",
            as_money(F.col("item.price_text")).alias("price"),
            *[PASSES[p](F.col("item")).alias(f"{p}_ok") for p in passes],
        )
    )


def parse_export(
    raw: DataFrame, passes: Sequence[str] = ("items", "products"), wrapped_only: bool = False
) -> DataFrame:
    """One row per element of every parsable line-item text."""
    return elements_of(parse_rows(raw, passes, wrapped_only=wrapped_only), passes)


def items_from_elements(
    elements: DataFrame, orders: DataFrame | None = None, each: bool = False
) -> DataFrame:
    """Order items from parsed elements: one per (order, product), the first.

    A repeated line is dropped, not summed. ``orders`` keeps only items of
    known orders; leave it out when the orders come from the same export, where
    it could drop nothing. ``each`` keeps good elements behind a bad one too.
    """
    kept = elements.where("items_ok" if each else "pos < items_prefix")
    kept = kept.select("order_id", "product_id", "quantity", "price_text", "seq", "pos")
    items = _priced(keep_first(kept, ["order_id", "product_id"], ["seq", "pos"]))
    return items if orders is None else semi_join(items, orders, "order_id", null_safe=True)


def products_from_elements(elements: DataFrame, each: bool = False) -> DataFrame:
    """Products from parsed elements: one per product id, the first."""
    kept = elements.where("products_ok" if each else "pos < products_prefix")
    kept = kept.select("product_id", "product_name", "category", "price_text", "seq", "pos")
    return _priced(keep_first(kept, ["product_id"], ["seq", "pos"]))


def _priced(first: DataFrame) -> DataFrame:
    """The rows that stay, their prices as amounts: a text until here, as it travels lighter."""
    return first.drop("seq", "pos").withColumn("price_text", as_money("price_text")).withColumnRenamed(
        "price_text", "price"
    )


def build_order_items(
    raw: DataFrame, orders: DataFrame | None = None, each: bool = False
) -> DataFrame:
    return items_from_elements(parse_export(raw, ["items"]), orders, each)


def build_products(raw: DataFrame, each: bool = False) -> DataFrame:
    return products_from_elements(parse_export(raw, ["products"]), each)


def rejects(raw: DataFrame, target: str = "items", wrapped_only: bool = False) -> DataFrame:
    """What a pass loses silently: ``order_id, seq, pos, text, reason``.

    ``pos`` is NULL where the whole text is lost. The flat pass counts rows as they are
    exported, before identical ones are merged.
    """
    return rejects_of(parse_rows(raw, [target], True, wrapped_only), [target]).drop("pass")


_REJECT = "struct<pass:string,pos:int,text:string,reason:string>"


def _reject(name: str, pos: Column, text: Column, reason: Column) -> Column:
    return F.struct(F.lit(name), pos, text, reason).cast(_REJECT)


def rejects_of(rows: DataFrame, targets: Sequence[str], dates: Column | None = None) -> DataFrame:
    """The rejects of several passes from parsed rows with the texts of their elements.

    A row's rejects are gathered before the explode: each lost element gives one per pass
    that loses it, so nothing is scanned twice and good elements become no rows. ``dates`` is the parsed
    order date; with it the pass ``orders`` lists the texts that are none.
    """
    none = F.lit(None)
    why = F.when(F.col("products").isNull(), F.lit("missing text")).otherwise(F.lit("no JSON array"))
    whole = F.array(*[_reject(p, none, F.col("products"), why) for p in targets])

    def of_element(e: Column, at: Column) -> Column:
        lost = []
        for p in targets:
            good = F.when(PASSES[p](e), F.lit("after bad element")).otherwise(F.lit("bad element"))
            lost.append(F.when(at >= F.col(f"{p}_prefix"), _reject(p, at, text_at(at), good)))
        return F.array(*lost)

    def text_at(at: Column) -> Column:  # the texts are those of the last elements
        return F.get("_texts", at - F.size("_items") + F.size("_texts"))

    # what no pass loses is left out first
    before = _first_lost(targets)
    behind = F.slice("_items", before + 1, F.size("_items"))
    lost = F.coalesce(F.flatten(F.transform(behind, lambda e, i: of_element(e, i + before))), whole)
    if dates is not None:
        bad = F.col("order_date").isNotNull() & dates.isNull()
        of_date = _reject("orders", none, F.col("order_date"), F.lit("bad date"))
        lost = F.concat(lost, F.array(F.when(bad, of_date)))
    return rows.select(
        parse_int("order_id").alias("order_id"), "seq", F.explode(F.array_compact(lost)).alias("_lost")
    ).select("_lost.pass", "order_id", "seq", "_lost.pos", "_lost.text", "_lost.reason")


def bad_dates(raw: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    """Export rows whose date is a text that becomes NULL, in the columns of ``rejects``."""
    lost = raw.where(
        F.col("order_date").isNotNull() & coerce_timestamp("order_date", date_formats).isNull()
    )
    return lost.select(
        parse_int("order_id").alias("order_id"),
        "seq",
        F.lit(None).cast("int").alias("pos"),
        F.col("order_date").alias("text"),
        F.lit("bad date").alias("reason"),
    )


def all_rejects(rows: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    """What every pass over the parsed rows loses, named by ``pass``; dates under ``orders``.

    One scan of the rows and one explode serve all of them.
    """
    dates = coerce_timestamp("order_date", date_formats)
    lost = rejects_of(rows, tuple(PASSES), dates)
    return lost.withColumn("seq", F.col("seq").cast("string"))


# --- the flat variant -------------------------------------------------------


def build_flat_items(raw: DataFrame) -> DataFrame:
    """Items with customer and date carried along, values as they were written.

    Identical export rows count once. All five keys must exist; nothing is
    cast, so a text that is no price survives.
    """
    rows = fill_nulls(distinct_rows(raw.drop("seq")), EXPORT_DEFAULTS)
    return (
        rows.select(
            parse_int("order_id").alias("order_id"),
            parse_int("customer_id").alias("customer_id"),
            coerce_timestamp("order_date").alias("order_date"),
            parse_fields(
                "products",
                dict.fromkeys(ITEM_KEYS, "string"),
                lambda e, has: F.struct(
                    *[e[k].alias(k) for k in ITEM_KEYS],
                    reduce(and_, [has(k) for k in ITEM_KEYS]).alias("complete"),
                ),
                ITEM_KEYS,
            )["items"].alias("_items"),
        )
        .select(
            "order_id",
            "customer_id",
            "order_date",
            explode_items(valid_prefix(F.col("_items"), lambda e: e["complete"])),
        )
        .select(
            "order_id",
            "customer_id",
            *[F.col("item")[k].alias(k) for k in ITEM_KEYS],
            "order_date",
        )
    )


def flat_customers(raw: DataFrame) -> DataFrame:
    """Distinct customer rows; an id repeats if its other columns differ."""
    return distinct_rows(fill_nulls(raw, EXPORT_DEFAULTS), CUSTOMER_COLUMNS)


def flat_orders(raw: DataFrame) -> DataFrame:
    """Distinct order rows; the total stays text."""
    subset = raw.select(*ORDER_COLUMNS).withColumn("order_date", coerce_timestamp("order_date"))
    return distinct_rows(subset).withColumnRenamed("taxful_total_price", "total_price")


# --- the whole job ----------------------------------------------------------


def normalise(
    raw: DataFrame, out: str, fmt: str = "parquet", date_formats: Sequence[str] = ()
) -> dict[str, str]:
    """Write the four clean tables and the rejects below ``out``; returns name -> path.

    The export is read once and its JSON parsed once: the rows are staged with
    their parsed elements, and each table reads only the columns it needs. The staged
    rows are deleted behind the writes.
    """
    needed = dict.fromkeys((*CUSTOMER_COLUMNS, *ORDER_COLUMNS, "seq", "products"))
    parsed = parse_rows(raw.select(*needed), tuple(PASSES), raw_text=True)
    lost = F.when(F.col("_items").isNull(), F.col("products"))
    with staged(parsed.withColumn("products", lost), "parsed") as rows:
        elements = elements_of(rows)
        tables = {
            "customers": build_customers(rows),
            "orders": build_orders(rows, date_formats),
            "order_items": items_from_elements(elements),
            "products": products_from_elements(elements),
            "rejects": all_rejects(rows, date_formats),
        }
        write_all(tables, out, {"parquet": write_table, "csv": write_csv}[fmt])
    return {name: f"{out}/{name}" for name in tables}
