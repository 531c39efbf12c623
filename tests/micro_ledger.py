"""Small ledgers, and helpers to build and read them."""

import datetime as dt
from decimal import Decimal

from tallybook import Ledger
from tallybook.sources.schema import ACCOUNTS, SPLITS, TRANSACTIONS

SMALL = "/root/testdata/sf0.001"


def money(text):
    return Decimal(text)


def day(text):
    return dt.date.fromisoformat(text)


def make_ledger(spark, accounts, transactions, splits):
    return Ledger(
        spark.createDataFrame(accounts, ACCOUNTS).coalesce(1),
        spark.createDataFrame([(t, day(d), x) for t, d, x in transactions], TRANSACTIONS).coalesce(1),
        spark.createDataFrame([(s, t, a, k, money(m), x) for s, t, a, k, m, x in splits], SPLITS).coalesce(1),
    )


MICRO_ACCOUNTS = [
    (1, "equity", "Imbalance", None),
    (2, "asset", "Checking", None),
    (3, "asset", "Cash Wallet", None),
    (4, "asset", "Cash Jar", None),
    (5, "expense", "Food", None),
    (6, "asset", "Petty Cash", None),
    (7, "income", "Salary", "monthly"),
    (8, "liability", "Card", None),
]
MICRO_TRANSACTIONS = [
    (1, "2016-12-31", "Opening"),
    (2, "2017-01-05", "Pay"),
    (3, "2017-01-10", "ATM"),
    (4, "2017-01-10", "Lunch"),
    (5, "2017-01-12", "Move"),
    (6, "2017-02-01", "Mixed"),
    (7, "2017-02-02", "Empty"),
    (8, "2017-03-01", "Broken"),
    (9, "2017-01-12", "Top up"),
]
MICRO_SPLITS = [
    (11, 1, 2, "debit", "100.00", "first"),
    (12, 1, 7, "credit", "100.00", None),
    (21, 2, 2, "debit", "50.00", None),
    (22, 2, 7, "credit", "50.00", None),
    (31, 3, 3, "debit", "20.00", None),
    (32, 3, 2, "credit", "20.00", None),
    (41, 4, 5, "debit", "8.50", None),
    (42, 4, 3, "credit", "8.50", None),
    (51, 5, 4, "debit", "5.00", "moved"),
    (52, 5, 3, "credit", "5.00", None),
    (61, 6, 5, "debit", "3.00", None),
    (62, 6, 3, "debit", "7.00", None),
    (63, 6, 2, "credit", "10.00", None),
    (81, 8, 2, "debit", "1.00", None),
    (91, 9, 6, "debit", "2.00", None),
    (92, 9, 4, "credit", "2.00", None),
]


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
