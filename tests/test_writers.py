"""Markers, appends that may be repeated, ids for several writers, and reports kept by month."""

from __future__ import annotations

import datetime as dt
import os
import random
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.markers import names, publish, published, read_markers
from tillroll.operators import numbering
from tillroll.plans import periods
from tillroll.plans import reports as r
from tillroll.sources import batches

D = Decimal


# --- markers ----------------------------------------------------------------


def test_one_of_many_writers_gets_the_marker(spark, tmp_path):
    path = f"{tmp_path}/held/one"
    with ThreadPoolExecutor(12) as pool:
        won = list(pool.map(lambda k: publish(spark, path, f"writer {k}"), range(24)))
    assert sum(won) == 1 and published(spark, path) and names(spark, f"{tmp_path}/held") == ["one"]
    held = [x.value for x in read_markers(spark, f"{tmp_path}/held").collect()]
    assert held == [f"writer {won.index(True)}"]
    assert not [f for f in os.listdir(f"{tmp_path}/held") if not f.startswith((".one", "one"))]


def test_a_folder_without_markers(spark, tmp_path):
    assert names(spark, f"{tmp_path}/none") == [] and not published(spark, f"{tmp_path}/none/x")
    assert read_markers(spark, f"{tmp_path}/none").isEmpty()


# --- appends ----------------------------------------------------------------


def rows_of(spark, path):
    return sorted(tuple(x) for x in batches.read_batches(spark, path).collect())


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(k, f"r{k}") for k in ids], "id bigint, t string") for ids in ((1, 2), (3,)))
    assert batches.append_batch(one, path, "2019-01") and not batches.append_batch(one, path, "2019-01")
    assert batches.append_batch(two, path, "2019-02")
    assert rows_of(spark, path) == [(1, "r1"), (2, "r2"), (3, "r3")]
    assert not batches.append_batch(two.limit(0), path, "2019-02") and len(rows_of(spark, path)) == 3


def test_a_failed_attempt_is_not_read_and_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, t string")
    batches.append_batch(good, path, "first")
    batches.write_batch(spark.createDataFrame([(8, "half"), (9, "half")], "id bigint, t string"), path, "second")
    assert rows_of(spark, path) == [(1, "a"), (2, "b")]
    fails = good.withColumn("t", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        batches.append_batch(fails, path, "second")
    assert rows_of(spark, path) == [(1, "a"), (2, "b")] and not batches.is_finished(spark, path, "second")
    assert batches.append_batch(spark.createDataFrame([(3, "c")], "id bigint, t string"), path, "second")
    assert rows_of(spark, path) == [(1, "a"), (2, "b"), (3, "c")]


def test_batches_with_partitions_and_odd_names(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "x"), (2, None)], "id bigint, t string")
    for name in ("1", "2", "007"):
        batches.append_batch(df, path, name, ["t"])
    assert batches.read_batches(spark, path).count() == 6
    for name in ("", "a/b", "a b", "..", "é"):
        with pytest.raises(ValueError):
            batches.append_batch(df, path, name)
    with pytest.raises(ValueError, match="the table holds"):
        batches.append_batch(df.select("id"), path, "4")
    with pytest.raises(ValueError, match="own"):
        batches.append_batch(df.withColumn("batch", F.lit(1)), path, "5")
    with pytest.raises(ValueError, match="no finished batch"):
        batches.read_batches(spark, str(tmp_path / "none"))


def test_batches_side_by_side(spark, tmp_path):
    path = str(tmp_path / "t")
    frames = [spark.range(k * 10, k * 10 + 10) for k in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: batches.append_batch(frames[k], path, f"b{k}"), range(6)))
    assert rows_of(spark, path) == [(k,) for k in range(60)]


# --- ids --------------------------------------------------------------------


def test_ranges_of_many_writers_are_disjoint_and_dense(spark, tmp_path):
    ledger, sizes = str(tmp_path / "ids"), [5, 1, 7, 2, 9, 3, 4, 6]
    with ThreadPoolExecutor(8) as pool:
        held = list(pool.map(lambda k: numbering.reserve_ids(spark, ledger, sizes[k], f"b{k}", 101), range(8)))
    assert [high - low + 1 for low, high in held] == sizes
    ids = sorted(i for low, high in held for i in range(low, high + 1))
    assert ids == list(range(101, 101 + sum(sizes)))
    assert numbering.reserve_ids(spark, ledger, 7, "b2", 1) == held[2]
    with pytest.raises(ValueError, match="has reserved 7 ids"):
        numbering.reserve_ids(spark, ledger, 8, "b2")


def test_two_batches_interleaved(spark, tmp_path):
    ledger = str(tmp_path / "ids")
    existing = spark.createDataFrame([(4,), (17,)], "id bigint")
    a, b = (spark.createDataFrame([(n,) for n in held], "n string") for held in (["c", "a", "b"], ["y", "x"]))
    first = numbering.assign_reserved_ids(existing, a, "id", ["n"], ledger, "a")
    second = numbering.assign_reserved_ids(existing, b, "id", ["n"], ledger, "b")  # "a" is not written yet
    assert sorted((x.id, x.n) for x in second.collect()) == [(21, "x"), (22, "y")]
    assert sorted((x.id, x.n) for x in first.collect()) == [(18, "a"), (19, "b"), (20, "c")]
    again = numbering.assign_reserved_ids(existing.unionAll(first.select("id")), a, "id", ["n"], ledger, "a")
    assert sorted((x.id, x.n) for x in again.collect()) == [(18, "a"), (19, "b"), (20, "c")]
    assert numbering.assign_reserved_ids(existing, a.limit(0), "id", ["n"], ledger, "none").count() == 0


# --- reports by month -------------------------------------------------------


def shop(spark, seed=3):
    rnd = random.Random(seed)
    day = dt.datetime(2019, 1, 1)
    orders = [
        (i, rnd.choice([None, *range(1, 9)]), rnd.choice([None, day + dt.timedelta(days=rnd.randrange(200))]),
         D(rnd.randrange(100, 9999)) / 100)
        for i in range(150)
    ]
    items = [(rnd.randrange(160), rnd.randrange(12), rnd.randrange(1, 5), D(rnd.randrange(1, 999)) / 100) for _ in range(600)]
    return (
        spark.createDataFrame(orders, "order_id bigint, customer_id bigint, order_date timestamp_ntz, total_price decimal(10,2)"),
        spark.createDataFrame(items, "order_id bigint, product_id bigint, quantity bigint, price decimal(10,2)"),
        spark.createDataFrame([(i, f"f{i}", f"l{i}") for i in range(1, 8)], "customer_id bigint, first_name string, last_name string"),
        spark.createDataFrame([(i, f"n{i % 5}", f"c{i % 3}") for i in range(10)], "product_id bigint, name string, category string"),
    )


def all_rows(frames):
    return {n: sorted(map(tuple, df.collect()), key=str) for n, df in frames.items()}


def full(orders, items, customers, products):
    args = items, products
    return all_rows(
        {
            "monthly_orders": r.monthly_orders(orders),
            "top_customers": r.top_customers(orders, customers),
            "category_revenue": r.category_share(*args),
            "top_products": r.top_products(*args),
            "daily_sales": r.daily_sales(orders),
        }
    )


def files_of(state):
    return {
        os.path.join(folder, f): os.stat(os.path.join(folder, f)).st_mtime_ns
        for folder, _, held in os.walk(f"{state}/sums")
        for f in held
        if f.endswith(".parquet")
    }


def test_late_batches_equal_a_full_refresh(spark, tmp_path):
    orders, items, customers, products = shop(spark)
    state = str(tmp_path / "state")
    part = lambda k: orders.where(F.col("order_id") % 3 == k)
    of = lambda k: items.where(F.col("order_id") % 3 == k)
    periods.start(part(0), of(0), state)
    for k in (1, 2):
        assert periods.apply_batch(part(k), of(k), state, f"b{k}")
        assert not periods.apply_batch(part(k), of(k), state, f"b{k}")
    assert all_rows(periods.reports(spark, state, customers, products)) == full(orders, items, customers, products)
    paths = periods.refresh(spark, state, customers, products, str(tmp_path / "out"))
    stored = all_rows({n: spark.read.parquet(p) for n, p in paths.items()})
    assert stored == full(orders, items, customers, products)


def test_only_the_months_of_a_batch_are_written(spark, tmp_path):
    orders, items, customers, products = shop(spark)
    state = str(tmp_path / "state")
    late = orders.where("month(order_date) IN (2, 5) AND order_id % 2 = 0")
    early = orders.join(late, "order_id", "left_anti")
    late_items = items.join(late, "order_id", "left_semi")
    periods.start(early, items.join(late, "order_id", "left_anti"), state)
    before = files_of(state)
    periods.apply_batch(late, late_items, state, "late")
    after = files_of(state)
    touched = ("month=2019-02", "month=2019-05")
    assert {f: t for f, t in before.items() if not any(m in f for m in touched)} == {
        f: t for f, t in after.items() if not any(m in f for m in touched)
    }
    assert not [f for f in before if any(m in f for m in touched) and f in after]
    assert all_rows(periods.reports(spark, state, customers, products)) == full(orders, items, customers, products)


@pytest.mark.parametrize("step", ["own", "whole", "prepared", "copied", "applied"])
def test_a_batch_that_fails_at_any_step_counts_once(spark, tmp_path, monkeypatch, step):
    orders, items, customers, products = shop(spark)
    state = str(tmp_path / "state")
    early, late = orders.where("order_id < 100"), orders.where("order_id >= 100")
    periods.start(early, items.where("order_id < 100"), state)
    counted = {"writes": 0, "markers": 0}
    write, mark = periods._write_months, periods.publish

    def failing_write(df, path, replace=False):
        counted["writes"] += 1
        if {"own": 2, "whole": 5, "copied": 8}.get(step) == counted["writes"]:
            raise RuntimeError("lost")
        write(df, path, replace)

    def failing_mark(*args):
        counted["markers"] += 1
        if {"prepared": 1, "applied": 2}.get(step) == counted["markers"]:
            raise RuntimeError("lost")
        return mark(*args)

    monkeypatch.setattr(periods, "_write_months", failing_write)
    monkeypatch.setattr(periods, "publish", failing_mark)
    with pytest.raises(RuntimeError):
        periods.apply_batch(late, items.where("order_id >= 100"), state, "late")
    monkeypatch.undo()
    periods.apply_batch(late, items.where("order_id >= 100"), state, "late")
    assert all_rows(periods.reports(spark, state, customers, products)) == full(orders, items, customers, products)


def test_items_that_come_after_their_orders(spark, tmp_path):
    orders, items, customers, products = shop(spark)
    state = str(tmp_path / "state")
    periods.start(orders, items.where("product_id < 6"), state)
    none = orders.limit(0)
    periods.apply_batch(none, items.where("product_id >= 6"), state, "items", known=orders)
    periods.apply_batch(none, items.limit(0), state, "nothing")
    assert all_rows(periods.reports(spark, state, customers, products)) == full(orders, items, customers, products)


def test_sums_by_month_hold_no_order(spark):
    """No aggregation by order and product, which would keep the items themselves in memory."""
    orders = spark.createDataFrame(
        [(1, 5, dt.datetime(2024, 2, 1), D("9.00"))],
        "order_id bigint, customer_id bigint, order_date timestamp_ntz, total_price decimal(10,2)",
    )
    lines = [(1, 7, 2, D("1.50")), (1, 7, 3, D("2.00")), (1, 8, 1, D("4.00")), (9, 7, 1, D("0.25")), (None, 7, 1, None)]
    items = spark.createDataFrame(lines, "order_id bigint, product_id bigint, quantity bigint, price decimal(10,2)")
    sold = periods.monthly_sums(orders, items)["sold"]
    held = sorted((x.month, x.product_id, x.units, x.revenue) for x in sold.collect())
    assert held == [("2024-02", 7, 5, D("9")), ("2024-02", 8, 1, D("4")), ("undated", 7, 2, D("0.25"))]
    plan = sold._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [order_id" not in plan
