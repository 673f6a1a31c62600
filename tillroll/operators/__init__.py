from tillroll.operators.dedupe import distinct_rows, keep_first, merge_spellings
from tillroll.operators.integrity import (
    check_decimal,
    check_fk,
    check_length,
    check_not_null,
    check_pk,
    check_unique,
)
from tillroll.operators.joins import (
    anti_join,
    join_items_products,
    join_orders_customers,
    semi_join,
)
from tillroll.operators.numbering import assign_ids, max_id, number_rows
from tillroll.operators.ranking import first_match, top_k, with_share

__all__ = [
    "anti_join",
    "assign_ids",
    "check_decimal",
    "check_fk",
    "check_length",
    "check_not_null",
    "check_pk",
    "check_unique",
    "distinct_rows",
    "first_match",
    "join_items_products",
    "join_orders_customers",
    "keep_first",
    "max_id",
    "merge_spellings",
    "number_rows",
    "semi_join",
    "top_k",
    "with_share",
]
