from tillroll.functions.columns import (
    coerce_timestamp,
    collated,
    day_key,
    default_if_empty,
    display_name,
    drop_chars,
    month_key,
    non_empty,
    parse_int,
    parse_money,
    price_label,
    quoted,
)
from tillroll.functions.frames import fill_nulls, lookup, null_tokens
from tillroll.functions.nested import (
    explode_items,
    get_item,
    has_key,
    parse_items,
    prefix_length,
    repair_json,
    valid_prefix,
)

__all__ = [
    "coerce_timestamp",
    "collated",
    "day_key",
    "default_if_empty",
    "display_name",
    "drop_chars",
    "explode_items",
    "fill_nulls",
    "get_item",
    "has_key",
    "lookup",
    "month_key",
    "non_empty",
    "null_tokens",
    "parse_int",
    "parse_items",
    "parse_money",
    "prefix_length",
    "price_label",
    "quoted",
    "repair_json",
    "valid_prefix",
]
