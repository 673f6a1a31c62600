"""Shapes of the physical plans that have to hold at scale."""

from __future__ import annotations

import re

import pytest
from plans import optimized_text, plan_text
from pyspark.sql import functions as F

import __spark_entry__ as registry
from query_set import bindings as b
from tillroll.functions import lookup
from tillroll.operators import check_fk, keep_first, number_rows
from tillroll.plans import normalise as n
from tillroll.plans import reports as r

FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "ArrowEvalPython",
    "BatchEvalPython",
    "MapInPandas",
    "FlatMapGroupsInPandas",
)


@pytest.mark.parametrize("name", list(registry._REGISTERED))
def test_no_cross_join_and_no_python(spark, sf, name):
    plan = plan_text(registry.queries()[name](spark, sf))
    assert not [f for f in FORBIDDEN if f in plan]


@pytest.mark.parametrize("name", list(registry._REGISTERED))
def test_windows_over_all_rows_only_see_one_row_per_slice(spark, sf, name):
    plan = plan_text(registry.queries()[name](spark, sf))
    for line in re.findall(r"Window \[.*", plan):
        unpartitioned = re.search(r"\], \[_slice#\d+ ASC", line) and "], [], [" not in line
        if "windowspecdefinition(_slice" in line:
            assert unpartitioned
        else:
            assert not re.search(r"windowspecdefinition\([a-z_0-9#]+L? (ASC|DESC)", line), line


def test_the_text_is_parsed_once(spark, sf):
    raw = b.raw_export(spark, sf)
    for df in (n.build_order_items(raw), n.build_products(raw), n.rejects(raw), n.build_flat_items(raw)):
        assert optimized_text(df).lower().count("parsejson(") == 1


def test_elements_are_cast_in_one_pass(spark, sf):
    # a document's own parse makes no VARIANT for each of its elements
    raw = b.raw_export(spark, sf)
    for df in (n.build_order_items(raw), n.build_products(raw), n.rejects(raw), n.build_flat_items(raw)):
        plan = optimized_text(df)
        assert "$[0], ArrayType(StructType(StructField(product_id," in plan
        assert "$[0], ArrayType(VariantType" not in plan


def test_the_array_is_not_carried_behind_the_explode(spark, sf):
    plan = plan_text(n.parse_export(b.raw_export(spark, sf)))
    generate = re.search(r"Generate posexplode\(.*?\), \[(.*?)\], false", plan)
    assert "_items" not in generate.group(1)


def test_keep_first_limits_before_the_shuffle(spark, sf):
    plan = plan_text(keep_first(b.order_items(spark, sf), ["product_id"], ["order_id", "line_number"]))
    partial, exchange = plan.index("Partial"), plan.index("Exchange")
    assert plan.index("Final") < exchange < partial


def test_reports_read_only_their_columns(spark, sf):
    plan = plan_text(r.category_revenue(b.order_items(spark, sf), b.products(spark, sf)))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert {c.split(":")[0] for s in schemas for c in s.split(",")} == {
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
        "p_partkey",
        "p_type",
    }


def test_items_are_aggregated_before_the_join(spark, sf):
    items, products = b.order_items(spark, sf), b.products(spark, sf)
    plan = plan_text(r.product_sales(items, products, ["name"]))
    assert plan.index("Join") < plan.index("partial_sum(quantity")


@pytest.mark.parametrize("name", ["monthly_orders", "daily_sales"])
def test_the_series_are_not_sorted(spark, sf, name):
    assert "rangepartitioning" not in plan_text(registry.queries()[name](spark, sf))


@pytest.mark.parametrize("name", list(registry._REGISTERED))
def test_no_counting_before_a_plan(spark, sf, name):
    """A limit to one task is only in top-k and look-up."""
    plan = plan_text(registry.queries()[name](spark, sf))
    assert "GlobalLimit" not in plan or name == "lookup_customer"


def test_only_k_rows_meet_the_names(spark, sf):
    plan = plan_text(r.top_customers(b.orders(spark, sf), b.customers(spark, sf)))
    assert plan.count("TakeOrderedAndProject") == 2
    names = next(i for i, line in enumerate(plan.splitlines()) if "Join [customer_id" in line)
    assert "TakeOrderedAndProject" in "".join(plan.splitlines()[names:])


def test_the_share_reuses_the_shuffle_of_the_sums(spark, sf):
    df = r.category_share(b.order_items(spark, sf), b.products(spark, sf))
    df.collect()
    assert "ReusedExchange" in plan_text(df)


def test_lookup_reaches_the_scan(spark, sf):
    plan = plan_text(lookup(b.source(spark, sf, "customer"), c_mktsegment="BUILDING", c_nationkey=7))
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "EqualTo(c_nationkey,7)" in plan


def test_top_k_is_no_global_sort(spark, sf):
    plan = plan_text(r.top_customers(b.orders(spark, sf), b.customers(spark, sf)))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_a_hot_child_key_is_split(spark):
    """With broadcasting off, a key with a third of the rows becomes several tasks."""
    # several map tasks write the hot key, so its partition can be cut between them
    rows = spark.range(0, 300_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.repeat(F.col("id").cast("string"), 20).alias("text"),
    )
    parent = spark.range(0, 100_000, 1, 4).select(F.col("id").alias("k"))
    old = {}
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "8",
    }.items():
        old[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        df = check_fk(rows, parent, "k")
        assert len(df.collect()) == len([i for i in range(100_000, 300_000) if i % 3])
        assert "skew=true" in plan_text(df)
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_numbering_joins_one_row_per_slice(spark):
    df = number_rows(spark.range(1000), ["id"], "n")
    plan = plan_text(df)
    assert "BroadcastHashJoin [_slice" in plan


def test_documents_are_shuffled_once(spark, sf):
    """Lines are gathered behind their shuffle, in one step, and the documents stay where they are."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, -1)
    try:
        plan = plan_text(b._build_raw(spark, sf)).splitlines()
    finally:
        spark.conf.set(threshold, before)
    depth = [len(re.match(r"[ :+*|-]*", line)[0]) for line in plan]
    gathers = [k for k, line in enumerate(plan) if "ObjectHashAggregate" in line]
    assert len(gathers) == 2
    first, second = gathers
    assert not any("Exchange" in line for line in plan[first:second])
    above = [k for k in range(first) if all(depth[k] < depth[j] for j in range(k + 1, first + 1))]
    assert not any("Exchange" in plan[k] for k in above)
