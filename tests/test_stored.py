"""Declared tables, bucketed layouts, the catalogue on disk, and large CSV files."""

from __future__ import annotations

import csv
import os
import random
import re
import uuid
from decimal import Decimal

import pytest
from plans import plan_text
from pyspark.sql import functions as F

from query_set import bindings as b
from query_set import tables as t
from tillroll.operators import check_fk, semi_join
from tillroll.plans import catalogue as cat
from tillroll.schemas import CUSTOMERS, EXPORT_COLUMNS, ORDER_ITEMS, ORDERS, PRODUCTS, TABLES
from tillroll.session import delete_path, fresh_path
from tillroll.sources import read_csv, read_export, write_csv
from tillroll.sources.multiline import read_records, read_split_csv
from tillroll.sources.stored import declare_table, declared_type, required_values, store_rows


def declared(spark, target, path, **layout):
    name = f"{target.name}_{uuid.uuid4().hex}"
    declare_table(spark, target, name, str(path), **layout)
    return name


# --- declared tables --------------------------------------------------------


@pytest.mark.parametrize("target", list(TABLES.values()), ids=list(TABLES))
def test_a_stored_table_has_the_declared_types(spark, tmp_path, target):
    name = declared(spark, target, tmp_path / "t")
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE `{name}`").collect()}
    assert told == {c.name: declared_type(target, c.name) for c in target.columns}


def product(name="n", pid=1, price="2.50", category="c"):
    return (pid, name, category, price)


PRODUCT_CELLS = "product_id bigint, product_name string, category string, price string"


def test_rows_are_stored_and_read_back(spark, tmp_path):
    name = declared(spark, PRODUCTS, tmp_path / "o'brien t")
    for k in range(2):
        store_rows(spark.createDataFrame([product("é" * 100, k, "2.505")], PRODUCT_CELLS), PRODUCTS, name)
    rows = spark.table(name).orderBy("product_id").collect()
    assert [(r.product_id, len(r.name), r.price, r.image_path) for r in rows] == [
        (k, 100, Decimal("2.51"), None) for k in range(2)
    ]


@pytest.mark.parametrize(
    ("row", "why"),
    [
        (product("x" * 101), "EXCEED_LIMIT_LENGTH"),
        (product(category="x" * 51), "EXCEED_LIMIT_LENGTH"),
        (product(pid=None), "products.product_id is missing"),
        (product(price="123456789.00"), "cannot hold"),
    ],
)
def test_a_write_that_breaks_a_rule_is_refused_whole(spark, tmp_path, row, why):
    name = declared(spark, PRODUCTS, tmp_path / "t")
    rows = [product(pid=k) for k in range(20)] + [row]
    with pytest.raises(Exception, match=why):
        store_rows(spark.createDataFrame(rows, PRODUCT_CELLS).repartition(4), PRODUCTS, name)
    assert spark.table(name).count() == 0


def test_the_table_itself_refuses_long_texts(spark, tmp_path):
    name = declared(spark, CUSTOMERS, tmp_path / "t")
    cells = [F.lit(1).cast("bigint")] + [F.lit("y" * 60)] * 5
    row = spark.range(1).select(*[c.alias(x.name) for c, x in zip(cells, CUSTOMERS.columns, strict=True)])
    with pytest.raises(Exception, match="EXCEED_LIMIT_LENGTH"):
        row.write.insertInto(name)


def test_required_values_are_told_by_name(spark):
    df = spark.createDataFrame([(None, 1, None, 1, None)], "order_id bigint, customer_id bigint, order_date timestamp_ntz, total_quantity bigint, total_price decimal(10,2)")
    with pytest.raises(Exception, match="orders.order_id is missing"):
        required_values(df, ORDERS).collect()
    assert required_values(df.withColumn("order_id", F.lit(1).cast("bigint")), ORDERS).count() == 1


# --- layouts ----------------------------------------------------------------


@pytest.fixture(scope="module")
def laid_out(spark, sf):
    return t._stored_orders_and_items(spark, sf)


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_joins_on_the_layout_key_shuffle_nothing(spark, laid_out, no_broadcast):
    orders, items = laid_out
    finished = orders.where("total_quantity > 2")
    for df in (
        check_fk(items, orders, "order_id"),
        semi_join(items, finished, "order_id"),
        check_fk(orders, items, "order_id"),
        items.join(orders.select("order_id", "customer_id"), "order_id"),
    ):
        df.collect()
        plan = plan_text(df)
        assert "Exchange" not in plan and "Join" in plan
        assert "Bucketed: true" in plan
    # the same rows without the layout
    plain = semi_join(items.select("*"), b.orders(spark, "/root/testdata/sf0.001"), "order_id")
    assert "Exchange" in plan_text(plain)


def test_a_bucketed_table_has_one_file_per_bucket_and_append(spark, tmp_path):
    name = declared(spark, ORDER_ITEMS, tmp_path / "t", bucket_by="order_id", buckets=3)
    df = spark.range(300).select(
        F.col("id").alias("order_id"), F.lit(1).cast("bigint").alias("product_id"),
        F.lit(1).cast("bigint").alias("quantity"), F.lit(Decimal("1.00")).cast("decimal(10,2)").alias("price"),
    )
    store_rows(df.repartition(7), ORDER_ITEMS, name)
    files = [f for f in os.listdir(tmp_path / "t") if f.endswith(".parquet")]
    assert len(files) == 3 and spark.table(name).count() == 300
    for f in files:
        ids = [r.order_id for r in spark.read.parquet(f"{tmp_path}/t/{f}").collect()]
        assert ids == sorted(ids)


# --- the catalogue on disk --------------------------------------------------


@pytest.fixture(scope="module")
def shelf(spark):
    rnd = random.Random(2)
    names = ["hot", "12", "a/b=c", "ü x", "", None]
    ids = rnd.sample(range(3 * cat.ID_RANGE), 1200)
    rows = [(i, f"n{i}", "hot" if k % 2 else rnd.choice(names), Decimal(k)) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "product_id bigint, name string, category string, price decimal(10,2)").repartition(6)


def test_the_stored_catalogue_is_the_listing(spark, shelf, tmp_path):
    path = str(tmp_path / "c")
    for _ in range(2):  # a second write replaces the first
        cat.write_catalogue(shelf, path, rows_per_file=100)
    wanted = [tuple(r) for r in cat.catalogue(shelf).collect()]
    columns = ["category", "first_seen", "product_id", "name", "price"]
    assert [tuple(r) for r in cat.read_catalogue(spark, path).select(columns).collect()] == wanted
    for category in ("hot", "12", "a/b=c", "ü x", "Uncategorized", "none"):
        got = [tuple(r) for r in cat.read_catalogue(spark, path, category).select(columns).collect()]
        assert got == [w for w in wanted if w[0] == category]


def test_a_large_category_is_several_bounded_files_in_order(spark, shelf, tmp_path):
    path = str(tmp_path / "c")
    cat.write_catalogue(shelf, path, rows_per_file=50)
    folder = f"{path}/category=hot"
    held = [
        [r.product_id for r in spark.read.parquet(f"{folder}/{f}").collect()]
        for f in sorted(os.listdir(folder))
        if f.endswith(".parquet")
    ]
    assert len(held) > 8 and max(map(len, held)) <= 50
    assert [i for ids in held for i in ids] == sorted(i for ids in held for i in ids)


def test_one_category_reads_its_folder_only(spark, shelf, tmp_path):
    path = str(tmp_path / "c")
    cat.write_catalogue(shelf, path)
    df = cat.read_catalogue(spark, path, "hot")
    assert re.search(r"PartitionFilters: \[[^]]*category#\d+ = hot", plan_text(df))


# --- large CSV files --------------------------------------------------------


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cells(rnd, long=False):
    pieces = ["a", "é", '"', ",", "\n", "\n\n", " ", '""', "x" * 30, ";", "'"]
    return "".join(rnd.choices(pieces, k=rnd.randint(0, 400 if long else 8)))


def write_rows(path, rows, names, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(names)
        writer.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_one_file_in_many_blocks(spark, tmp_path, small_blocks, end):
    rnd = random.Random(4)
    rows = [(str(k), cells(rnd, k % 9 == 0), cells(rnd)) for k in range(300)]
    write_rows(tmp_path / "f.csv", rows, ["id", "a", "b b"], end)
    df = read_split_csv(spark, str(tmp_path))
    assert read_records(spark, str(tmp_path)).select("block").distinct().count() > 20
    got = [tuple(r)[:3] for r in df.orderBy("seq").collect()]
    assert df.columns == ["id", "a", "b b", "seq"]
    assert got == [tuple(c or None for c in r) for r in rows]


def test_several_files_agree_with_the_reader_of_whole_files(spark, tmp_path, small_blocks):
    rnd = random.Random(6)
    for f in range(3):
        rows = [(f"{f}-{k}", cells(rnd), cells(rnd, k == 7)) for k in range(60)]
        write_rows(tmp_path / f"{f}.csv", rows, ["id", "a", "b"])
    split = read_split_csv(spark, str(tmp_path))
    whole = read_csv(spark, str(tmp_path))
    assert by_cells(split) == by_cells(whole)
    assert [r.id for r in split.orderBy("seq").collect()] == [f"{f}-{k}" for f in range(3) for k in range(60)]


def by_cells(df):
    return sorted((tuple(r) for r in df.select("id", "a", "b").collect()), key=str)


def test_an_export_in_blocks_is_the_export(spark, sf, small_blocks):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    path = fresh_path(spark, "one-file")
    broken = F.replace("products", F.lit("},{"), F.lit("},\n{"))
    write_csv(b.raw_export(spark, sf).drop("seq").withColumn("products", broken).coalesce(1), path)
    split, whole = read_export(spark, path, split=True), read_export(spark, path)
    assert split.select("seq.block").distinct().count() > 20
    assert split.count() == whole.count()
    assert split.select(*map(lambda c: f"`{c}`", EXPORT_COLUMNS)).exceptAll(whole.drop("seq")).isEmpty()
    ordered = [[r.order_id for r in df.orderBy("seq").collect()] for df in (split, whole)]
    assert ordered[0] == ordered[1]


def test_headers_that_do_not_fit_fail(spark, tmp_path):
    write_rows(tmp_path / "1.csv", [("1", "2")], ["a", "b"])
    write_rows(tmp_path / "2.csv", [("1", "2")], ["b", "a"])
    with pytest.raises(Exception, match="another header"):
        read_split_csv(spark, str(tmp_path)).collect()
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_split_csv(spark, str(tmp_path / "e"))
    (tmp_path / "m").mkdir()
    write_rows(tmp_path / "m" / "x.csv", [("1", "2")], ["a\nb", "c"])
    with pytest.raises(ValueError, match="line break in the header"):
        read_split_csv(spark, str(tmp_path / "m"))


def test_an_unclosed_cell_reaches_the_end_of_its_file_only(spark, tmp_path, small_blocks):
    (tmp_path / "1.csv").write_text("id,a\n1,x\n2,\"open\n" + "line\n" * 300)
    write_rows(tmp_path / "2.csv", [("3", "y"), ("4", "z\nz")], ["id", "a"])
    got = {r.id: r.a for r in read_split_csv(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2", "3", "4"} and got["4"] == "z\nz" and got["2"].startswith("open")


# --- queries ----------------------------------------------------------------


def test_what_is_written_once_is_written_again_when_it_is_gone(spark, sf):
    written = []

    def write(path):
        spark.range(3).write.parquet(path)
        written.append(path)
        return path

    assert b.once(spark, sf, "test", write) == b.once(spark, sf, "test", write) and len(written) == 1
    delete_path(spark, written[0])
    assert b.once(spark, sf, "test", write) == written[1] != written[0]
