from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillroll import session
from tillroll.operators import number_rows
from tillroll.plans import normalise as n
from tillroll.plans.checks import check_tables
from tillroll.schemas import CUSTOMERS, EXPORT_COLUMNS, ORDER_ITEMS, ORDERS, PRODUCTS, TABLES
from tillroll.session import build_session, fresh_path, shared_dir, stage_table, staged
from tillroll.sources import (
    append_rows,
    jdbc_options,
    load_table,
    read_csv,
    read_export,
    table,
    write_csv,
    write_table,
)


def test_csv_keeps_quotes_line_breaks_and_blanks(spark, tmp_path):
    rows = [
        (1, 'a "b", c', dt.datetime(2019, 3, 30)),
        (2, "two\nlines", dt.datetime(2019, 3, 30, 16, 12)),
        (3, " ends in a blank ", None),
        (4, "back\\slash", None),
        (5, None, None),
        (6, "", None),
    ]
    df = spark.createDataFrame(rows, "id int, t string, d timestamp_ntz")
    write_csv(df, str(tmp_path))
    rows[5] = (6, None, None)  # an empty cell is a missing cell
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path), df.schema).collect()) == rows
    text = "".join(p.read_text() for p in tmp_path.glob("*.csv"))
    assert "2019-03-30 00:00:00" in text and "id,t,d" in text


def test_csv_checks_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="header does not conform"):
        read_csv(spark, str(tmp_path), "a string, b string").collect()
    assert read_csv(spark, str(tmp_path)).select("a").first().a == "2"


def test_export_of_several_files_keeps_source_order(spark, tmp_path):
    """Other columns, another column order, CRLF, and a repeat in a later file."""
    names = list(reversed(EXPORT_COLUMNS)) + ["currency"]

    def line(order_id, phone, total="$1"):
        cells = {"order_id": order_id, "customer_phone": phone, "taxful_total_price": total}
        cells |= {"customer_id": "1", "products": '"[{""product_id"": 1, ""quantity"": 1, ""price"": ""$2""}]"'}
        return ",".join(cells.get(c, "") for c in names)

    small = [line("1", "second file"), line("3", "N/A")]
    large = [line("1", "first file")] + [line(str(i), "x") for i in range(10, 400)]
    (tmp_path / "2.csv").write_text("\r\n".join([",".join(names), *small]) + "\r\n")
    (tmp_path / "1.csv").write_text("\r\n".join([",".join(names), *large]) + "\r\n")
    for multi_line in (True, False):
        raw = read_export(spark, str(tmp_path), multi_line)
        assert raw.count() == 393
        first = n.keep_first(raw, ["order_id"], ["seq"]).where("order_id IN ('1', '3')")
        assert {r.order_id: r.customer_phone for r in first.collect()} == {"1": "first file", "3": None}
        assert n.build_customers(raw).first().customer_phone == "first file"
        items = n.build_order_items(raw)
        assert items.count() == 392 and items.first().price == Decimal(2)


def test_splitting_a_file_keeps_source_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n" + "".join(f"{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = read_csv(spark, str(tmp_path), multi_line=False)
        seq = F.struct(
            F.col("_metadata.file_path"),
            F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id(),
        )
        got = [r.id for r in df.select("id", seq.alias("seq")).orderBy("seq").collect()]
        assert df.rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [str(i) for i in range(20_000)]


def test_typed_load(spark):
    df = spark.createDataFrame(
        [("1", "7", "2019-03-30 16:12:00", "2", "47.992"), ("2", None, None, None, "0.005")],
        "order_id string, customer_id string, order_date string, total_quantity string, total_price string",
    )
    rows = load_table(df, ORDERS).orderBy("order_id").collect()
    assert rows[0] == (1, 7, dt.datetime(2019, 3, 30, 16, 12), 2, Decimal("47.99"))
    assert rows[1].total_price == Decimal("0.01")
    with pytest.raises(PySparkException):
        load_table(df.withColumn("order_id", F.lit("x")), ORDERS).collect()


def test_typed_load_renames_headers_and_checks_lengths(spark):
    header = "product_id string, product_name string, category string, price string"
    df = spark.createDataFrame([("1", "n" * 101, "c", "2")], header)
    with pytest.raises(PySparkException, match="products.name exceeds 100"):
        load_table(df, PRODUCTS).collect()
    loaded = load_table(df, PRODUCTS, strict=False)
    assert loaded.columns == ["product_id", "name", "category", "price", "image_path"]
    assert loaded.first().image_path is None
    assert len(loaded.first().name) == 101
    assert TABLES["order_items"].references == {"order_id": ("orders", "order_id")}
    assert PRODUCTS.amounts == {"price": (10, 2)} and CUSTOMERS.amounts == {}


def test_append_fills_missing_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.createDataFrame([(1, "a", "p")], "id bigint, name string, image string"), path)
    append_rows(spark.createDataFrame([("b", 2)], "name string, id int"), path)
    assert sorted(tuple(r) for r in table(spark, path).collect()) == [(1, "a", "p"), (2, "b", None)]
    with pytest.raises(ValueError):
        append_rows(spark.createDataFrame([(1,)], "other int"), path)


def test_append_to_a_partitioned_table_keeps_every_row(spark, tmp_path):
    path = str(tmp_path / "k=9" / "t")  # a folder above that looks like a partition
    df = spark.createDataFrame([(1, "a b", "p"), (2, None, "q")], "id bigint, kind string, image string")
    write_table(df, path, partition_by=["kind"])
    new = spark.createDataFrame([(3, "a b"), (4, "new")], "id bigint, kind string")
    for wrong in ((), ("id",), ("kind", "id")):
        with pytest.raises(ValueError, match="partitioned"):
            append_rows(new, path, partition_by=wrong)
    append_rows(new, path, partition_by=["kind"])
    assert sorted((r.id, r.kind, r.image) for r in table(spark, path).collect()) == [
        (1, "a b", "p"), (2, None, "q"), (3, "a b", None), (4, "new", None),
    ]
    plain = str(tmp_path / "plain")
    write_table(df, plain)
    with pytest.raises(ValueError, match="partitioned"):
        append_rows(new, plain, partition_by=["kind"])


def test_typed_load_is_strict_without_ansi(spark):
    df = spark.createDataFrame([("1", "1", "1", "1e9")], "order_id string, product_id string, quantity string, price string")
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            with pytest.raises(PySparkException, match="order_items.price cannot hold"):
                load_table(df, ORDER_ITEMS).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_clean_output_breaks_no_rule(spark, tmp_path):
    cells = {"customer_id": "3", "total_quantity": "2", "taxful_total_price": "$5", "order_date": "2019-01-01"}
    line = '[{"product_id": 1, "product_name": "n", "category": "c", "price": "$2.50", "quantity": 1}]'
    rows = [tuple({**cells, "order_id": str(i), "products": line}.get(c) for c in EXPORT_COLUMNS) + (i,) for i in range(5)]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in EXPORT_COLUMNS) + ", seq bigint")
    paths = n.normalise(raw, str(tmp_path))
    loaded = {name: load_table(table(spark, paths[name]), TABLES[name]) for name in TABLES}
    assert check_tables(loaded).isEmpty()
    broken = {**loaded, "orders": loaded["orders"].withColumn("customer_id", F.lit(9))}
    found = check_tables(broken).collect()
    assert {(r.table, r.rule, r.column, r.value) for r in found} == {("orders", "reference", "customer_id", "9")}


def test_replacing_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "v int, month string")
    write_table(df, path, ["month"])
    write_table(df.where("month = 'y'").withColumn("v", F.lit(9)), path, ["month"], replace_partitions=True)
    assert sorted((r.month, r.v) for r in table(spark, path).collect()) == [("x", 1), ("y", 9)]
    write_table(df.where("month = 'y'"), path, ["month"])
    assert table(spark, path).count() == 1


def test_table_by_name(spark):
    spark.range(3).createOrReplaceTempView("three_rows")
    assert table(spark, "three_rows").count() == 3


def test_jdbc_options():
    assert jdbc_options("jdbc:x", "orders") == {"url": "jdbc:x", "dbtable": "orders"}
    built = jdbc_options("jdbc:x", "SELECT * FROM t;", "id", (0, 99), 4, fetchsize=1000)
    assert built == {
        "url": "jdbc:x",
        "dbtable": "(SELECT * FROM t) src",
        "partitionColumn": "id",
        "lowerBound": "0",
        "upperBound": "99",
        "numPartitions": "4",
        "fetchsize": "1000",
    }
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "orders", "id")


def test_staged_tables_go_to_the_shared_folder(spark):
    held = stage_table(spark.range(10), "ten")
    assert held.count() == 10
    assert all(shared_dir(spark) in f for f in held.inputFiles())
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
    with staged(spark.range(10), "ten") as df:
        folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
        assert df.count() == 10 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_staging_is_cleared_at_the_end_of_a_job(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "staging_dir", lambda _: f"file://{tmp_path}/app")
    rows = number_rows(spark.range(10), ["id"], "n")
    write_table(rows, str(tmp_path / "out"))
    assert list((tmp_path / "app").iterdir())
    session.clear_staging(spark)
    assert not (tmp_path / "app").exists()
    assert table(spark, str(tmp_path / "out")).count() == 10
    assert build_session() is not None


def test_csv_files_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    """A file whose cells may hold line breaks is one task; its rows keep their order over the files."""
    monkeypatch.setattr("tillroll.sources.sinks.CSV_ROWS", 4)
    cells = [F.col("id").cast("string").alias(c) for c in EXPORT_COLUMNS]
    write_csv(spark.range(10, numPartitions=1).select(*cells), str(tmp_path))
    assert len([f for f in os.listdir(tmp_path) if f.endswith(".csv")]) == 3
    held = [x["order_id"] for x in read_export(spark, str(tmp_path)).orderBy("seq").collect()]
    assert held == [str(k) for k in range(10)]
