"""Column expressions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.functions import text
from tallybook.functions.money import money_text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "width", "expected"),
    [
        ("12.5", 5, "    12.50"),
        ("-5.5", 5, "-    5.50"),
        ("0", 5, "     0.00"),
        ("99999.99", 5, " 99999.99"),
        ("99999.995", 5, " #####.##"),
        ("-100000", 5, "-#####.##"),
        ("-0.005", 5, "-    0.01"),
        ("-0.004", 5, "     0.00"),
        ("100000", 6, " 100000.00"),
        ("1000000", 6, " ######.##"),
        (None, 5, None),
    ],
)
def test_money_text(spark, value, width, expected):
    number = F.lit(None if value is None else Decimal(value)).cast("decimal(20,3)")
    assert one(spark, money_text(number, width)) == expected


@pytest.mark.parametrize(
    ("value", "expected"), [("abcdef", "abcdef"), ("abcdefg", "abc..."), ("été été", "été..."), (None, None)]
)
def test_clip_text(spark, value, expected):
    assert one(spark, text.clip_text(F.lit(value).cast("string"), 6)) == expected


@pytest.mark.parametrize(("aid", "name"), [(7, "account_0007"), (9999, "account_9999"), (10000, "account_####")])
def test_default_account_name(spark, aid, name):
    assert one(spark, text.default_account_name(F.lit(aid))) == name


@pytest.mark.parametrize(
    ("value", "kind"),
    [("credit", "credit"), ("c", "credit"), ("", "credit"), ("debit", "debit"), ("d", "debit"), ("x", None), ("C", None)],
)
def test_parse_split_kind(spark, value, kind):
    assert one(spark, text.parse_split_kind(F.lit(value))) == kind


@pytest.mark.parametrize(
    ("value", "amount"),
    [
        ("4", "4.00"),
        ("-4.5", "-4.50"),
        (" 1e3 ", "1000.00"),
        ("0.005", "0.01"),
        ("0.0049999999", "0.00"),
        ("abc", None),
        ("", None),
        (".5", None),
        ("5.", None),
        ("1,000", None),
        ("1e30", None),
    ],
)
def test_parse_amount(spark, value, amount):
    assert one(spark, text.parse_amount(F.lit(value))) == (None if amount is None else Decimal(amount))


@pytest.mark.parametrize(("value", "tid"), [("12", 12), (" -3 ", -3), ("1.5", None), ("x", None), ("", None)])
def test_parse_tid(spark, value, tid):
    assert one(spark, text.parse_tid(F.lit(value))) == tid


@pytest.mark.parametrize(
    ("value", "date"), [("2017-1-5", "2017-01-05"), ("2017-02-30", None), ("2017", None), ("soon", None)]
)
def test_parse_date(spark, value, date):
    assert one(spark, text.parse_date(F.lit(value)).cast("string")) == date


@pytest.mark.parametrize(
    ("value", "pattern", "hit"),
    [
        ("50% off", r"50\%%", True),
        ("50 off", r"50\%%", False),
        ("abc", r"a\bc", True),
        ("a\\c", r"a\\c", True),
        ("abc", "a_c", True),
    ],
)
def test_like(spark, value, pattern, hit):
    assert one(spark, text.like(F.lit(value), pattern)) is hit


def test_null_labels(spark):
    assert one(spark, text.null_label(F.lit(None).cast("string"))) == "None"
    assert one(spark, text.label_to_null(F.lit("None"))) is None
    assert one(spark, text.label_to_null(F.lit("none"))) == "none"
