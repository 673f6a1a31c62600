"""The clean-up of the order export, with every edge of the item texts."""

from __future__ import annotations

import glob
import json
import os
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from plans import optimized_text, plan_text
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from query_set import bindings
from query_set import normalise as queries
from tillroll.functions import nested, parse_items, repair_json, valid_prefix
from tillroll.plans import normalise as n
from tillroll.schemas import EXPORT_COLUMNS
from tillroll.session import fresh_path, shared_dir, staged, staging_dir
from tillroll.sources import file_batches

SCHEMA = ", ".join(f"`{c}` string" for c in EXPORT_COLUMNS) + ", seq bigint"


def export(spark, *rows):
    """Raw rows from dicts; unnamed cells are NULL, seq counts the rows."""
    filled = [
        tuple(r.get(c) for c in EXPORT_COLUMNS) + (r.get("seq", i),) for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(filled, SCHEMA)


def item(pid=1, name="n", category="c", price="$2.50", quantity=1, **without):
    held = dict(product_id=pid, product_name=name, category=category, price=price, quantity=quantity)
    return {k: v for k, v in held.items() if k not in without.get("drop", ())}


def wrapped(items):
    return '"' + json.dumps(items).replace('"', '""') + '"'


def items_of(spark, text, **how):
    raw = export(spark, {"order_id": "7", "products": text})
    rows = n.build_order_items(raw, **how).collect()
    return sorted((r.product_id, r.quantity, r.price) for r in rows)


def products_of(spark, text):
    raw = export(spark, {"order_id": "7", "products": text})
    return sorted(tuple(r) for r in n.build_products(raw).collect())


D = Decimal("2.5")


@pytest.mark.parametrize("write", [json.dumps, wrapped])
def test_quoted_and_plain_texts(spark, write):
    assert items_of(spark, write([item(1), item(2)])) == [(1, 1, D), (2, 1, D)]


@pytest.mark.parametrize(
    "bad",
    [
        item(2, drop=("price",)),
        item(2, price=None),
        item(2, price="1,234.00"),
        item(2, price="oops"),
        item(2, price=[1]),
        item("x"),
        item("12.7"),
        item(None),
        item(2, quantity="two"),
        item(2, drop=("quantity",)),
        "text",
        5,
        None,
        [],
    ],
)
def test_a_bad_element_ends_the_items(spark, bad):
    text = json.dumps([item(1), bad, item(3)])
    assert items_of(spark, text) == [(1, 1, D)]
    assert items_of(spark, text, each=True) == [(1, 1, D), (3, 1, D)]


@pytest.mark.parametrize(
    "text",
    [
        None,
        "",
        "not json",
        "null",
        "5",
        json.dumps(item(1)),
        json.dumps([item(1)]) + " end",
        json.dumps([item(1)]) + ',"x":1',
        json.dumps([item(1)]) + "," + json.dumps([item(2)]),
        json.dumps([item(1)]) + "]",
        "[" + json.dumps([item(1)])[:-1],
        json.dumps([item(1)])[:-1],
        str([item(1)]),  # single quotes
        "[]",
    ],
)
def test_a_text_that_is_no_array_gives_nothing(spark, text):
    assert items_of(spark, text) == []
    assert products_of(spark, text) == []


def test_accepted_spellings(spark):
    items = [
        item("12", price=3),
        item(13, price=3.25, quantity="4"),
        item(14, price="$ 7 "),
        item(1.7),
        item(15, price="1e2"),
    ]
    assert items_of(spark, json.dumps(items)) == [
        (1, 1, D),
        (12, 1, Decimal(3)),
        (13, 4, Decimal("3.25")),
        (14, 1, Decimal(7)),
        (15, 1, Decimal(100)),
    ]


def test_amounts_of_any_size_are_kept(spark):
    items = [item(1, price="$1000000000000.00"), item(2, price=1000000000000), item(3, price="47.99212345678")]
    assert items_of(spark, json.dumps([*items, item(4)])) == [
        (1, 1, Decimal(10**12)),
        (2, 1, Decimal(10**12)),
        (3, 1, Decimal("47.99212345678")),
        (4, 1, D),
    ]
    with pytest.raises(PySparkException, match="amount out of range"):
        items_of(spark, json.dumps([item(1, price="1" + "0" * 40)]))


@pytest.fixture(params=["true", "false"])
def duplicate_keys(spark, request):
    """The session's setting for keys given twice, on which no result may depend."""
    key = "spark.sql.variant.allowDuplicateKeys"
    old = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.set(key, old)


def test_of_a_key_given_twice_the_last_counts(spark, duplicate_keys):
    text = '[{"product_id": 1, "quantity": "x", "price": "$1", "quantity": 2, "price": "$2.50"}]'
    assert items_of(spark, text) == [(1, 2, D)]


def test_a_key_given_twice_costs_no_other_element(spark, duplicate_keys):
    twice = '{"product_id": 8, "quantity": "x", "price": "$2.50", "quantity": 1, "note": "a \\"b\\" \\\\"}'
    ends = [5, None, "text", [1], json.dumps(item(9)), item(9, price="oops")]
    for end in ends:
        text = "[" + ", ".join([json.dumps(item(7)), twice, json.dumps(end), json.dumps(item(9))]) + "]"
        assert items_of(spark, text) == [(7, 1, D), (8, 1, D)]
        assert items_of(spark, text, each=True) == [(7, 1, D), (8, 1, D), (9, 1, D)]
        for behind in (" end", "]", ",[]", ',"x":1', f",{text}"):
            assert items_of(spark, text + behind) == []


def test_both_ways_of_parsing_agree(spark):
    texts = [
        "[]", " [ ] ", "['a']", "[{'a': 1}]", "[NaN]", '[{"price": NaN}]', "[01]", "[{a: 1}]", "null", "5", '"[1]"', "{}", "[", "[1", "not json", "[5]", "[null]", '["a"]', "[[1]]",
        json.dumps([item(1), item("2", price=3.5), {}, item(None, name="é \\ \" \ue000 \ue000q \n")]),
        json.dumps([item(1), {"product_id": {"a": [1, None]}}]) , json.dumps([item(1)]) + " x",
    ]
    both = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        *[
            F.transform(
                items, lambda i: F.struct(*[x for k in n.ITEM_KEYS for x in (nested.has_key(i, k), nested.get_item(i, k))])
            ).alias(name)
            for name, items in (("whole", parse_items("t", True)), ("each", nested.parse_elements(F.col("t"))))
        ],
    )
    for r in both.collect():
        assert r.whole == r.each or r.t == '"[1]"', r.t


def test_fields_read_at_once_are_those_of_the_elements(spark, duplicate_keys):
    """Values, presence and texts from one cast, as element by element, for keys given twice too."""
    twice = '{"product_id": 8, "quantity": "x", "price": "$2.50", "quantity": null, "note": "a \\"b\\""}'
    ends = ["5", "null", "[1]", '"t"', "{}", '{"price": 1.50}', '{"product_id": {"n": 1, "n": 2}}', '{"z": {"q": 1, "q": 2}}', "NaN", "01"]
    texts = ["[]", "null", "not json", f"[{twice}] end", f"[{twice}],[]", f'[{twice}],"x":1', f"[[{twice}]]"]
    texts += [f"[{first}, {end}]" for first in (twice, json.dumps(item(1, name=None))) for end in ends]
    keys = n.ITEM_KEYS
    elements = parse_items("t", True)

    def cells(value, has):
        return F.struct(*[x for k in keys for x in (value(k), has(k))])

    at_once = nested.parse_fields(
        "t", n.ITEM_TYPES, lambda e, has: cells(lambda k: e[k], has), keys, True, lambda e: F.lit(True)
    )
    one_by_one = F.transform(
        elements, lambda i: cells(lambda k: nested.get_item(i, k, n.ITEM_TYPES[k]), lambda k: nested.has_key(i, k))
    )
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        at_once["items"].cast("string").alias("items"),
        at_once["texts"].alias("texts"),
        one_by_one.cast("string").alias("want"),
        F.transform(elements, lambda e: e.cast("string")).alias("want_texts"),
    )
    for r in df.collect():
        assert r["items"] == r.want and (r.texts or []) == (r.want_texts or []), r.t


def test_a_document_beyond_a_variant_is_read_whole(spark):
    items = [item(i, name="x" * 2000) for i in range(20_000)]  # 40 MB
    df = spark.createDataFrame([("7", json.dumps(items))], "order_id string, t string")
    ids = F.transform(nested.parse_elements(F.col("t")), lambda i: nested.get_item(i, "product_id", "bigint"))
    assert df.select(F.array_distinct(ids).alias("ids")).first().ids == list(range(20_000))
    assert len(items_of(spark, json.dumps(items))) == 20_000


def test_the_passes_reject_different_elements(spark):
    # the items pass does not look at names, the products pass not at quantities
    unnamed, unmeasured = item(1, drop=("category",)), item(2, quantity="many")
    text = json.dumps([unnamed, item(3)])
    assert [p[0] for p in items_of(spark, text)] == [1, 3]
    assert products_of(spark, text) == []
    text = json.dumps([unmeasured, item(3)])
    assert items_of(spark, text) == []
    assert [p[0] for p in products_of(spark, text)] == [2, 3]


def test_a_json_null_is_a_present_key(spark):
    text = json.dumps([item(1, name=None), item(2, name="")])
    # a plain text with an empty string is destroyed by the quote repair
    assert products_of(spark, text) == []
    assert products_of(spark, wrapped([item(1, name=None), item(2, name="")])) == [
        (1, None, "c", D),
        (2, "", "c", D),
    ]


def test_repair_of_wrapped_texts_only(spark):
    text = json.dumps([item(1, name="")])
    df = spark.createDataFrame([(text,), (wrapped([item(1, name="")]),)], "t string")
    assert [r[0] for r in df.select(parse_items("t").isNull()).collect()] == [True, False]
    kept = df.select(parse_items("t", wrapped_only=True).isNull()).collect()
    assert [r[0] for r in kept] == [False, False]
    assert df.limit(1).select(repair_json("t", wrapped_only=True)).first()[0] == text


def test_repeated_lines_keep_the_first_in_source_order(spark):
    raw = export(
        spark,
        {"order_id": "1", "seq": 5, "products": json.dumps([item(1, quantity=5), item(1, quantity=6)])},
        {"order_id": "1", "seq": 2, "products": json.dumps([item(2), item(1, quantity=7)])},
    )
    rows = {(r.order_id, r.product_id): r.quantity for r in n.build_order_items(raw).collect()}
    assert rows == {(1, 1): 7, (1, 2): 1}


def test_items_of_unknown_orders(spark):
    raw = export(
        spark,
        {"order_id": "1", "products": json.dumps([item(1)])},
        {"order_id": "2", "products": json.dumps([item(1)])},
        {"order_id": None, "products": json.dumps([item(1)])},
    )
    orders = spark.createDataFrame([(1,), (None,)], "order_id bigint")
    kept = {r.order_id for r in n.build_order_items(raw, orders).collect()}
    assert kept == {1, None}
    # the export's own orders could drop nothing
    own = n.build_order_items(raw, n.build_orders(raw))
    assert own.exceptAll(n.build_order_items(raw)).isEmpty()
    assert n.build_order_items(raw).exceptAll(own).isEmpty()


def test_customers(spark):
    raw = export(
        spark,
        {"customer_id": "1", "customer_first_name": "late", "customer_phone": "5", "seq": 9},
        {"customer_id": "1", "customer_first_name": "first", "seq": 3},
        {"customer_id": "2", "customer_first_name": "other", "customer_phone": "6", "seq": 4},
    )
    rows = {r.customer_id: r for r in n.build_customers(raw).collect()}
    assert rows[1].customer_first_name == "first" and rows[1].customer_phone == "N/A"
    assert rows[2].customer_phone == "6" and len(rows) == 2


def test_orders(spark):
    cells = {"customer_id": "3", "total_quantity": "2"}
    raw = export(
        spark,
        {"order_id": "1", "order_date": "soon", "taxful_total_price": "$1,000.25", **cells},
        {"order_id": "1", "order_date": "2019-01-01", "taxful_total_price": "$5", **cells},
        {"order_id": "2", "order_date": "2019-01-01 10:00:00", "taxful_total_price": None, **cells},
    )
    rows = {r.order_id: r for r in n.build_orders(raw).collect()}
    assert rows[1].order_date is None and rows[1].total_price == Decimal("1000.25")
    assert rows[2].total_price is None and rows[2].order_date.hour == 10
    bad = export(spark, {"order_id": "1", "taxful_total_price": "free"})
    with pytest.raises(PySparkException, match="not an amount"):
        n.build_orders(bad).collect()


def test_flat_items(spark):
    cells = {"order_id": "1", "customer_id": "4", "order_date": "soon"}
    good, odd = item(1, price="oops"), item(2, drop=("quantity",))
    row = {**cells, "products": json.dumps([good, odd, item(3)]), "customer_phone": "1"}
    raw = export(spark, row, {**row, "seq": 9}, {**row, "customer_phone": "2"})
    rows = n.build_flat_items(raw).collect()
    # identical rows count once, and the text that is no price survives
    assert [(r.product_id, r.price, r.order_date, r.customer_id) for r in rows] == [
        ("1", "oops", None, 4)
    ] * 2


def test_rejects_and_items_make_up_all_elements(spark):
    raw = export(
        spark,
        {"order_id": "1", "products": json.dumps([item(1), item(2, price="oops"), item(3)])},
        {"order_id": "2", "products": "not json"},
        {"order_id": "3", "products": None},
        {"order_id": "4", "products": "[]"},
        {"order_id": "5", "products": json.dumps([item(1, drop=("category",)), 5])},
    )
    rows = {(r.order_id, r.pos): r for r in n.rejects(raw).collect()}
    assert {k: r.reason for k, r in rows.items()} == {
        (1, 1): "bad element",
        (1, 2): "after bad element",
        (2, None): "no JSON array",
        (3, None): "missing text",
        (5, 1): "bad element",
    }
    assert json.loads(rows[1, 1].text)["price"] == "oops" and rows[2, None].text == "not json"
    assert {(r.order_id, r.pos) for r in n.rejects(raw, "products").collect()} == {
        (1, 1),
        (1, 2),
        (2, None),
        (3, None),
        (5, 0),
        (5, 1),
    }
    elements = n.parse_export(raw)
    assert elements.count() == 5
    assert elements.where("pos < items_prefix").count() == 2


def test_valid_prefix_on_plain_arrays(spark):
    df = spark.createDataFrame([([1, 2, -1, 3],), ([1],), ([-1],), ([],), (None,)], "a array<int>")
    kept = df.select(valid_prefix(F.col("a"), lambda e: e > 0)).collect()
    assert [r[0] for r in kept] == [[1, 2], [1], [], [], None]


# every spelling with what it must become, or BAD
BAD = object()
IDS = [(1, 1), (2, 2), (3, 3), ("4", 4), ("x", BAD), (None, BAD)]
PRICES = [("$1.50", 1.5), (2, 2.0), ("oops", BAD), ("1,5", BAD), ("$ 7 ", 7.0)]
QUANTITIES = [(1, 1), ("2", 2), ("2.5", BAD), (None, BAD)]


@st.composite
def element(draw):
    """``(what the text holds, (id, quantity, price) or BAD)``"""
    if draw(st.integers(0, 7)) == 0:
        return draw(st.sampled_from([5, "s", None])), BAD
    (pid, want_id), (price, want_price), (quantity, want_quantity) = (
        draw(st.sampled_from(choices)) for choices in (IDS, PRICES, QUANTITIES)
    )
    dropped = draw(st.sampled_from([(), (), ("category",), ("price",)]))
    held = item(pid, draw(st.sampled_from(["a", None])), "c", price, quantity, drop=dropped)
    wanted = (want_id, want_quantity, BAD if "price" in dropped else want_price)
    return held, BAD if BAD in wanted else wanted


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 3), st.lists(element(), max_size=5)), min_size=1, max_size=8))
def test_items_follow_the_rule(spark, documents):
    raw = export(
        spark,
        *[{"order_id": str(o), "products": wrapped([e for e, _ in els])} for o, els in documents],
    ).repartition(3)
    want = {}
    for order_id, elements in documents:
        for _, wanted in elements:
            if wanted is BAD:
                break
            want.setdefault((order_id, wanted[0]), wanted[1:])
    got = {
        (r.order_id, r.product_id): (r.quantity, float(r.price))
        for r in n.build_order_items(raw).collect()
    }
    assert got == want


def test_normalise_leaves_nothing_staged_and_parses_once(spark, tmp_path, monkeypatch):
    held = []
    monkeypatch.setattr(n, "staged", lambda df, label: held.append(df) or staged(df, label))
    before = set(glob.glob(shared_dir(spark) + "/**/parsed-*", recursive=True))
    raw = export(spark, {"order_id": "1", "products": json.dumps([item(1)])})
    n.normalise(raw, str(tmp_path))
    assert set(glob.glob(shared_dir(spark) + "/**/parsed-*", recursive=True)) == before
    assert optimized_text(held[0]).lower().count("parsejson(") == 1


def test_rejects_of_the_job(spark, tmp_path):
    """Items and rejects of a pass make up all elements; lost dates are listed."""
    rows = [
        {"order_id": "1", "products": json.dumps([item(1), item(2, price="oops"), item(3)]), "order_date": "soon"},
        {"order_id": "2", "products": "not json", "order_date": "2019-01-01"},
        {"order_id": "3", "products": None},
        {"order_id": "4", "products": json.dumps([item(4), item(5, drop=("category",)), item(6)])},
    ]
    paths = n.normalise(export(spark, *rows), str(tmp_path))
    lost = [tuple(r) for r in spark.read.parquet(paths["rejects"]).select("pass", "order_id", "pos", "reason").collect()]
    whole = [(2, None, "no JSON array"), (3, None, "missing text")]
    assert sorted(lost, key=str) == sorted(
        [(p, *w) for p in ("items", "products", "flat") for w in whole]
        + [("items", 1, 1, "bad element"), ("items", 1, 2, "after bad element")]
        + [("products", 1, 1, "bad element"), ("products", 1, 2, "after bad element")]
        + [(p, 4, 1, "bad element") for p in ("products", "flat")]
        + [(p, 4, 2, "after bad element") for p in ("products", "flat")]
        + [("orders", 1, None, "bad date")],
        key=str,
    )
    texts = spark.read.parquet(paths["rejects"]).where("pass = 'items' AND order_id = 1 AND pos = 1")
    assert json.loads(texts.first().text)["price"] == "oops"
    kept = spark.read.parquet(paths["order_items"]).count()
    assert kept + sum(r[0] == "items" and r[2] is not None for r in lost) == 6


def test_all_rejects_come_from_one_scan_and_one_explode(spark, tmp_path):
    raw = export(spark, {"order_id": "1", "products": json.dumps([item(1), 5])})
    with staged(n.parse_rows(raw, tuple(n.PASSES), raw_text=True), "test") as rows:
        plan = plan_text(n.all_rejects(rows))
        assert plan.count("FileScan") == 1 and plan.count("Generate") == 1 and "Union" not in plan
        assert "Exchange" not in plan


def test_normalise_writes_the_four_tables(spark, tmp_path):
    cells = {"customer_id": "3", "total_quantity": "2", "taxful_total_price": "$5"}
    raw = export(
        spark,
        {"order_id": "1", "products": json.dumps([item(1), item(2)]), **cells},
        {"order_id": "2", "products": "bad", **cells},
    )
    for fmt in ("parquet", "csv"):
        paths = n.normalise(raw, str(tmp_path / fmt), fmt)
        read = spark.read.option("header", True).format(fmt)
        assert {k: read.load(p).count() for k, p in paths.items()} == {
            "customers": 1,
            "orders": 2,
            "order_items": 2,
            "products": 2,
            "rejects": 3,
        }


def test_files_in_batches(spark):
    path = fresh_path(spark, "files")
    for k in (10, 1000, 100_000):
        spark.range(k).coalesce(1).write.mode("append").parquet(path)
    files = {os.path.basename(f): os.path.getsize(f) for f in glob.glob(f"{path}/*.parquet")}
    for size in (1, sum(sorted(files.values())[:2]), 1 << 30):
        batches = [[os.path.basename(f) for f in batch] for batch in file_batches(spark, path, size)]
        assert sorted(sum(batches, [])) == sorted(files) and all(batches)
        assert all(len(x) == 1 or sum(files[f] for f in x) <= size for x in batches)
    assert len(batches) == 1 and len(file_batches(spark, path, 1)) == 3


def test_text_of_a_large_export_is_written_in_batches(spark, monkeypatch):
    """An order in several files counts once with all its elements; two batches at most are text at a time."""
    path, there = fresh_path(spark, "export"), []
    texts = [json.dumps([item(1), item(2, quantity=3)]), wrapped([item(3), item(4, price="oops")]), "no json"]
    rows = [{"order_id": order, "products": text} for order in ("7", "8", None) for text in texts]
    for part in ([], rows[0::2], rows[1::2], rows[:1]):
        export(spark, *part).coalesce(1).write.mode("append").parquet(path)
    monkeypatch.setitem(bindings._written, (spark.sparkContext.applicationId, "toy", "export"), (path, path))
    text = lambda: glob.glob(f"{staging_dir(spark).removeprefix('file:')}/csv-lines-*")
    before, write = text(), queries.write_csv
    monkeypatch.setattr(queries, "write_csv", lambda df, to: (write(df, to), there.append(len(text()) - len(before))))
    for size, batches in ((1, 4), (1 << 30, 1)):
        monkeypatch.setattr(queries, "BATCH", size)
        there.clear()
        got = {tuple(r) for r in queries.csv_split_elements(spark, "toy").collect()}
        assert got == {(7, 5, 9, 12.5), (8, 3, 5, 7.5), (None, 3, 5, 7.5)}
        assert len(there) == batches and max(there) <= 2 and text() == before
