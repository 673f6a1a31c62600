from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillroll.functions import (
    coerce_timestamp,
    collated,
    day_key,
    default_if_empty,
    display_name,
    drop_chars,
    fill_nulls,
    lookup,
    month_key,
    non_empty,
    null_tokens,
    parse_int,
    parse_money,
    price_label,
)


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_money(spark):
    texts = ["$1,234.50", "9.99", "$ 5", "oops", None, ""]
    order_level = values(spark, texts, parse_money)
    assert order_level == [Decimal("1234.5"), Decimal("9.99"), Decimal(5), None, None, None]
    item_level = values(spark, texts, lambda c: parse_money(c, strip="$"))
    assert item_level == [None, Decimal("9.99"), Decimal(5), None, None, None]


def test_strict_money_fails_the_run(spark):
    assert values(spark, ["$1", None], lambda c: parse_money(c, strict=True)) == [Decimal(1), None]
    with pytest.raises(PySparkException, match="not an amount"):
        values(spark, ["oops"], lambda c: parse_money(c, strict=True))


def test_money_has_no_digit_cap(spark):
    texts = ["$1000000000000.00", "47.99212345678", "1e2", "-0.00000001", "nan", "inf", "1_000"]
    assert values(spark, texts, parse_money) == [
        Decimal("1000000000000"),
        Decimal("47.99212345678"),
        Decimal(100),
        Decimal("-0.00000001"),
        None,
        None,
        None,
    ]
    with pytest.raises(PySparkException, match="amount out of range"):
        values(spark, ["1" + "0" * 30], parse_money)


def test_other_date_spellings_are_named(spark):
    texts = ["03/29/2019", "Mar 29, 2019", "20190329", "2019-03-29 10:00:00", "soon"]
    day = dt.datetime(2019, 3, 29)
    plain = values(spark, texts, coerce_timestamp)
    assert plain == [None, None, None, day.replace(hour=10), None]
    formats = ["MM/dd/yyyy", "MMM d, yyyy", "yyyyMMdd"]
    named = values(spark, texts, lambda c: coerce_timestamp(c, formats))
    assert named == [day, day, day, day.replace(hour=10), None]


def test_whole_numbers(spark):
    texts = ["12", " 12 ", "12.7", "x", "", None]
    assert values(spark, texts, parse_int) == [12, 12, None, None, None, None]


def test_timestamps(spark):
    texts = ["2019-03-30 16:12:00", "2019-03-30", "soon", None]
    assert values(spark, texts, coerce_timestamp) == [
        dt.datetime(2019, 3, 30, 16, 12),
        dt.datetime(2019, 3, 30),
        None,
        None,
    ]
    # the last days of a year keep their calendar year
    keys = values(
        spark, ["2019-12-31 23:59:59", None], lambda c: month_key(c.cast("timestamp_ntz"))
    )
    assert keys == ["2019-12", None]
    days = values(spark, ["2019-12-31 23:59:59"], lambda c: day_key(c.cast("timestamp_ntz")))
    assert days == [dt.date(2019, 12, 31)]


def test_empty_texts(spark):
    assert values(spark, ["a", "", None], non_empty) == [True, False, False]
    assert values(spark, ["a", "", None], default_if_empty) == ["a", "Uncategorized", "Uncategorized"]


def test_text_building(spark):
    assert values(spark, ["b", "", None], lambda c: display_name(F.lit("a"), c)) == ["a b", "a ", None]
    assert values(spark, ["$a$,b"], lambda c: drop_chars(c, "$,")) == ["ab"]
    assert values(spark, ["9.9", "1000"], price_label) == ["$9.90", "$1000.00"]


def test_collation_ignores_case_and_accents_but_not_blanks(spark):
    same = values(spark, ["Café", "CAFE", "cafe ", "caff"], lambda c: collated(c) == F.lit("cafe"))
    assert same == [True, True, False, False]


def test_null_tokens_touch_named_columns_only(spark):
    df = spark.createDataFrame([("N/A", "Null"), ("nan", "None"), ("x", "")], "p string, s string")
    assert null_tokens(df, ["p"]).collect() == [(None, "Null"), (None, "None"), ("x", "")]
    with pytest.raises(ValueError):
        null_tokens(df, ["q"])


def test_fill_nulls_with_a_dotted_name(spark):
    df = spark.createDataFrame([(None, None), ("1", "a")], "phone string, `geoip.region_name` string")
    filled = fill_nulls(df, {"phone": "N/A", "geoip.region_name": "Unknown"})
    assert filled.columns == df.columns
    assert filled.collect() == [("N/A", "Unknown"), ("1", "a")]


def test_lookup_binds_values(spark):
    df = spark.createDataFrame([("a", 1), ("' OR 1=1 --", 2), ("a", 2)], "n string, k int")
    assert lookup(df, n="a", k=2).collect() == [("a", 2)]
    assert lookup(df, n="' OR 1=1 --").collect() == [("' OR 1=1 --", 2)]
    with pytest.raises(ValueError):
        lookup(df)
