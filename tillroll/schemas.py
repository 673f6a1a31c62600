"""Table definitions: columns, types, keys and limits of the four shop tables."""

from __future__ import annotations

from dataclasses import dataclass, field

MONEY = "decimal(10,2)"


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    source: str | None = None
    """Header of the cleaned CSV file where it differs from the column name."""
    length: int | None = None
    required: bool = False
    optional: bool = False
    """May be absent from the input."""
    numbered: bool = False
    """Counts the rows as they are loaded."""

    @property
    def header(self) -> str:
        return self.source or self.name


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...]
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    """column -> (parent table, parent column)"""

    @property
    def amounts(self) -> dict[str, tuple[int, int]]:
        """column -> (precision, scale) of the decimal columns"""
        held = {c.name: c.type.removeprefix("decimal(") for c in self.columns}
        shapes = {n: t[:-1].split(",") for n, t in held.items() if t.endswith(")")}
        return {n: (int(precision), int(scale)) for n, (precision, scale) in shapes.items()}

    @property
    def lengths(self) -> dict[str, int]:
        return {c.name: c.length for c in self.columns if c.length}

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.columns if c.required]


# Names, types and lengths of the shop's tables.
CUSTOMERS = Table(
    "customers",
    (
        Column("customer_id", "bigint", required=True),
        Column("first_name", "string", source="customer_first_name", length=50),
        Column("last_name", "string", source="customer_last_name", length=50),
        Column("gender", "string", source="customer_gender", length=10),
        Column("email", "string", length=100),
        Column("phone", "string", source="customer_phone", length=20),
    ),
    key=("customer_id",),
)

ORDERS = Table(
    "orders",
    (
        Column("order_id", "bigint", required=True),
        Column("customer_id", "bigint"),
        Column("order_date", "timestamp_ntz"),
        Column("total_quantity", "bigint"),
        Column("total_price", MONEY),
    ),
    key=("order_id",),
    references={"customer_id": ("customers", "customer_id")},
)

ORDER_ITEMS = Table(
    "order_items",
    (
        Column("id", "bigint", required=True, numbered=True),
        Column("order_id", "bigint"),
        Column("product_id", "bigint"),
        Column("quantity", "bigint"),
        Column("price", MONEY),
    ),
    key=("id",),
    references={"order_id": ("orders", "order_id")},
)

PRODUCTS = Table(
    "products",
    (
        Column("product_id", "bigint", required=True),
        Column("name", "string", source="product_name", length=100),
        Column("category", "string", length=50),
        Column("price", MONEY),
        Column("image_path", "string", length=200, optional=True),
    ),
    key=("product_id",),
)

TABLES = {t.name: t for t in (CUSTOMERS, ORDERS, ORDER_ITEMS, PRODUCTS)}

# Columns of the denormalised order export that the clean-up reads.
EXPORT_COLUMNS = (
    "order_id",
    "customer_id",
    "order_date",
    "total_quantity",
    "taxful_total_price",
    "customer_first_name",
    "customer_last_name",
    "customer_gender",
    "email",
    "customer_phone",
    "geoip.region_name",
    "products",
)

# Cell texts that a data frame reader treats as missing.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
