from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators import (
    assign_ids,
    check_decimal,
    check_fk,
    check_length,
    check_not_null,
    check_pk,
    check_unique,
    distinct_rows,
    first_match,
    join_items_products,
    join_orders_customers,
    keep_first,
    max_id,
    number_rows,
    semi_join,
    top_k,
    with_share,
)


def skewed(spark, rows=6000, seed=1):
    """Key 0 holds a third of all rows, every tenth of those a full copy."""
    rnd = random.Random(seed)
    data = []
    for i in range(rows):
        key = 0 if i % 3 == 0 else rnd.randrange(1, 300)
        data.append((key, i if i % 30 else 0, rnd.randrange(1000)))
    return spark.createDataFrame(data, "k bigint, seq bigint, v bigint").repartition(7), data


# --- duplicates -------------------------------------------------------------


def test_keep_first_against_brute_force_on_a_hot_key(spark):
    df, data = skewed(spark)
    data = [(k, i, v) for i, (k, _, v) in enumerate(data)]
    df = spark.createDataFrame(data, df.schema).repartition(7)
    want = {}
    for k, i, v in data:
        want.setdefault(k, (i, v))
    for parts in (1, 5):
        got = keep_first(df.repartition(parts), ["k"], ["seq"]).collect()
        assert {r.k: (r.seq, r.v) for r in got} == want and len(got) == len(want)


def test_keep_first_treats_missing_keys_as_equal_and_is_idempotent(spark):
    df = spark.createDataFrame(
        [(None, 1, "a"), (None, 0, "b"), (1, 2, "c")], "k bigint, seq bigint, v string"
    )
    once = keep_first(df, ["k"], ["seq"])
    assert sorted(r.v for r in once.collect()) == ["b", "c"]
    assert keep_first(once, ["k"], ["seq"]).count() == 2


def test_distinct_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a")], "k int, v string")
    assert distinct_rows(df).count() == 2
    assert distinct_rows(df, ["k"]).collect() == [(1,)]


# --- joins ------------------------------------------------------------------


def test_inner_joins_drop_unmatched_and_null_keys(spark):
    orders = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "order_id int, customer_id int")
    customers = spark.createDataFrame([(10, "a"), (11, "b")], "customer_id int, name string")
    assert [r.order_id for r in join_orders_customers(orders, customers).collect()] == [1]
    items = spark.createDataFrame([(1, 5), (1, None)], "order_id int, product_id int")
    products = spark.createDataFrame([(5, "p")], "product_id int, name string")
    assert [r.name for r in join_items_products(items, products).collect()] == ["p"]


def test_semi_join_never_multiplies_rows(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert sorted(r.v for r in semi_join(left, right, "k").collect()) == ["a", "b"]
    assert sorted(r.v for r in semi_join(left, right, "k", null_safe=True).collect()) == [
        "a",
        "b",
        "d",
    ]


# --- numbering --------------------------------------------------------------


def test_numbers_are_dense_and_follow_the_order(spark):
    rnd = random.Random(3)
    keys = rnd.sample(range(100_000), 5000)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(9)
    got = number_rows(df, ["k"], start=5).collect()
    want = {k: i for i, k in enumerate(sorted(keys), start=5)}
    assert {r.k: r.id for r in got} == want and len(got) == len(keys)


def test_numbers_on_a_hot_key_with_copies(spark):
    df, data = skewed(spark)
    got = number_rows(df, ["k", "seq", "v"], "n").collect()
    assert sorted(r.n for r in got) == list(range(1, len(data) + 1))
    assert [(r.k, r.seq, r.v) for r in sorted(got, key=lambda r: r.n)] == sorted(data)


def test_the_number_of_slices_is_a_parameter(spark):
    df = spark.range(100)
    for slices in (1, 3, 40):
        got = number_rows(df, ["id"], "n", slices=slices).collect()
        assert {r.id: r.n for r in got} == {i: i + 1 for i in range(100)}


def test_numbers_of_an_empty_table(spark):
    assert number_rows(spark.createDataFrame([], "k bigint"), ["k"]).count() == 0


def test_ids_follow_the_largest_existing_one(spark):
    new = spark.createDataFrame([("b",), ("a",)], "name string")
    existing = spark.createDataFrame([(25102,), (7,)], "product_id bigint")
    got = assign_ids(existing, new, "product_id", ["name"]).collect()
    assert {r.name: r.product_id for r in got} == {"a": 25103, "b": 25104}
    empty = existing.where("false")
    assert max_id(empty, "product_id").collect() == [(0,)]
    assert {r.product_id for r in assign_ids(empty, new, "product_id", ["name"]).collect()} == {1, 2}


# --- ranking ----------------------------------------------------------------


def test_top_k_breaks_ties_by_name_and_puts_null_last(spark):
    df = spark.createDataFrame(
        [("d", 4), ("c", 4), ("b", 4), ("a", 5), ("e", None)], "name string, v int"
    ).repartition(4)
    assert [r.name for r in top_k(df, "v", "name", 3).collect()] == ["a", "b", "c"]
    assert [r.name for r in top_k(df, "v", "name", 9).collect()][-1] == "e"


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "n string, x int")
    df = df.withColumn("x", F.col("x").cast("decimal(12,2)"))
    got = {r.n: r.share for r in with_share(df, "x").collect()}
    assert got == {"a": Decimal("33.3"), "b": Decimal("66.7"), "c": None}
    zero = with_share(df.where("n = 'a'").withColumn("x", F.col("x") - 1), "x")
    assert zero.first().share is None


def test_first_match(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    assert first_match(df, "k").collect() == [(1,)]
    assert first_match(df.where("k > 9"), "k").collect() == []
    with pytest.raises(ValueError):
        first_match(df)


# --- integrity --------------------------------------------------------------


def test_primary_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 1)], "a int, b int")
    assert sorted(check_pk(df, ["a", "b"]).collect(), key=str) == [(1, 1, 2), (None, 1, 1)]
    assert check_pk(df.where("b = 2"), ["a", "b"]).isEmpty()


def test_unique_with_collation(spark):
    df = spark.createDataFrame(
        [("Bob",), ("bob",), ("böb",), ("bob ",), ("bob",), (None,), (None,)], "name string"
    )
    assert check_unique(df, "name").collect() == [("bob", 2)]
    assert check_unique(df, "name", "UNICODE_CI_AI").collect() == [("Bob", 4)]


def test_foreign_key(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 11)], "id int, k int")
    parent = spark.createDataFrame([(10,), (10,), (None,)], "key int")
    assert sorted(r.id for r in check_fk(child, parent, "k", "key").collect()) == [2, 4]


def test_foreign_key_against_brute_force_on_a_hot_key(spark):
    df, data = skewed(spark)
    parent = spark.createDataFrame([(k,) for k in range(0, 300, 2)], "k bigint")
    assert check_fk(df, parent, "k").count() == sum(k % 2 for k, _, _ in data)


def test_not_null_and_length(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (None, "äöü€")], "id int, t string")
    assert check_not_null(df, ["id"]).collect() == [(None, "äöü€")]
    assert check_not_null(df, ["id", "t"]).count() == 2
    assert check_length(df, {"t": 3}).collect() == [(None, "äöü€")]
    assert check_length(df, {"t": 4}).isEmpty()


def test_decimal_range_and_scale(spark):
    df = spark.createDataFrame([(99_999_999.99,), (1e8,), (47.992,), (None,)], "x double")
    assert check_decimal(df, "x", 10, 2).collect() == [(1e8,)]
    assert sorted(check_decimal(df, "x", 10, 2, exact=True).collect()) == [(47.992,), (1e8,)]
    texts = ["1.000000000000001", "1.5", "99999999.99", "1." + "0" * 29 + "1"]
    fine = spark.createDataFrame([(t,) for t in texts], "x string")
    found = {r.x for r in check_decimal(fine, "x", 10, 2, exact=True).collect()}
    assert found == {"1.000000000000001"} | {texts[3]}
