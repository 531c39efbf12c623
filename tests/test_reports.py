"""Reports on the hand-computed ledger."""

import pytest
from micro_ledger import day, make_ledger, money, rows

from tallybook.plans import reports

YEAR = {"start": "2017-01-01", "end": "2018-01-01"}
STATEMENT = ("sid", "date", "counter", "amount", "balance", "debit_balance", "credit_balance")


def expect(text):
    out = []
    for line in text.strip().splitlines():
        sid, date, counter, *sums = [p.strip() for p in line.split("|")]
        out.append((int(sid), day(date), counter, *[money(s) for s in sums]))
    return out


R7 = expect("""
81 | 2017-03-01 |                  |   1.00 | 21.00 | 51.00 | 30.00
63 | 2017-02-01 | Cash Wallet,Food | -10.00 | 20.00 | 50.00 | 30.00
32 | 2017-01-10 | Cash Wallet      | -20.00 | 30.00 | 50.00 | 20.00
21 | 2017-01-05 | Salary           |  50.00 | 50.00 | 50.00 |  0.00
""")
R9 = expect("""
62 | 2017-02-01 | Checking    |  7.00 | 16.50 | 27.00 | 8.50
52 | 2017-01-12 | Cash Jar    | -5.00 |  9.50 | 20.00 | 8.50
51 | 2017-01-12 | Cash Wallet |  5.00 |  9.50 | 20.00 | 8.50
92 | 2017-01-12 | Petty Cash  | -2.00 |  9.50 | 20.00 | 8.50
31 | 2017-01-10 | Checking    | 20.00 | 11.50 | 20.00 | 8.50
42 | 2017-01-10 | Food        | -8.50 | 11.50 | 20.00 | 8.50
""")


@pytest.fixture(params=["joined", "journal"])
def book(request, micro, micro_with_journal):
    return micro if request.param == "joined" else micro_with_journal


def test_account_balances(micro):
    report = reports.account_balances(micro)
    assert rows(report, "name", "balance", "balance_text") == [
        ("Cash Jar", money("3.00"), "     3.00"),
        ("Cash Wallet", money("13.50"), "    13.50"),
        ("Checking", money("121.00"), "   121.00"),
        ("Petty Cash", money("2.00"), "     2.00"),
        ("Card", money("0.00"), "     0.00"),
        ("Imbalance", money("0.00"), "     0.00"),
        ("Salary", money("-150.00"), "-  150.00"),
        ("Food", money("11.50"), "    11.50"),
    ]
    assert rows(reports.account_balances(micro, [7]), "aid", "description", "balance") == [
        (7, "monthly", money("-150.00"))
    ]


def test_transaction_list_newest_first(micro):
    assert [r[0] for r in rows(reports.transaction_list(micro), "tid")] == [8, 7, 6, 9, 5, 4, 3, 2, 1]


def test_split_list(micro):
    report = reports.split_list(micro)
    assert [r[0] for r in rows(report, "sid")] == [12, 11, 22, 21, 32, 31, 42, 41, 52, 51, 63, 61, 62, 81, 92, 91]
    assert rows(reports.split_list(micro, tids=[6]), "sid", "account", "amount_text") == [
        (63, "Checking", "    10.00"),
        (61, "Food", "     3.00"),
        (62, "Cash Wallet", "     7.00"),
    ]
    assert rows(reports.split_list(micro, sids=[51]), "sid", "memo") == [(51, "moved")]


def test_account_statement(book):
    assert rows(reports.account_statement(book, [2], **YEAR), *STATEMENT) == R7


def test_account_statement_texts(micro):
    report = reports.account_statement(micro, [2], **YEAR)
    assert rows(report, "amount_text", "balance_text", "credit_balance_text")[1] == (
        "-   10.00",
        "    20.00",
        "    30.00",
    )


def test_account_statement_of_all_accounts_holds_each_one(book):
    everything = reports.account_statement(book, **YEAR)
    mine = everything.filter("account = 'Checking'")
    assert rows(mine, *STATEMENT) == R7
    assert everything.count() == 14


def test_account_statement_by_frame_of_accounts(micro):
    wanted = micro.accounts.filter("name = 'Checking'")
    assert rows(reports.account_statement(micro, wanted, **YEAR), *STATEMENT) == R7


def test_account_statement_open_range_starts_with_first_split(book):
    report = reports.account_statement(book, [2])
    assert rows(report, "sid", "balance")[-1] == (11, money("100.00"))
    assert rows(report, "sid", "balance")[0] == (81, money("121.00"))


def test_statement_rows_outside_the_dates(book):
    assert rows(reports.account_statement_rows(book, [11], **YEAR), *STATEMENT) == expect(
        "11 | 2016-12-31 | Salary | 100.00 | 0.00 | 0.00 | 0.00"
    )
    after = reports.account_statement_rows(book, [81], "2017-01-01", "2017-02-01")
    assert rows(after, *STATEMENT) == expect("81 | 2017-03-01 | | 1.00 | 30.00 | 50.00 | 20.00")


def test_statement_rows_of_all_splits(book):
    report = reports.account_statement_rows(book, None, **YEAR)
    assert report.count() == 16
    assert rows(report.filter("account = 'Checking' and sid <> 11"), *STATEMENT) == R7


def test_cash_statement(book):
    assert rows(reports.cash_statement(book, "%", **YEAR), *STATEMENT) == R9


def test_cash_statement_widths(micro):
    report = reports.cash_statement(micro, "%", **YEAR)
    assert rows(report, "balance_text", "debit_balance_text")[0] == ("    16.50", "     27.00")


def test_cash_statement_pattern(book):
    report = reports.cash_statement(book, "M%", **YEAR)
    assert rows(report, *STATEMENT) == expect("""
    62 | 2017-02-01 | Checking    |  7.00 | 7.00 | 7.00 | 0.00
    52 | 2017-01-12 | Cash Jar    | -5.00 | 0.00 | 0.00 | 0.00
    51 | 2017-01-12 | Cash Wallet |  5.00 | 0.00 | 0.00 | 0.00
    """)
    assert reports.cash_statement(book, "nothing", **YEAR).count() == 0


def test_cash_statement_rows_of_any_account(book):
    assert rows(reports.cash_statement_rows(book, [91], "%", **YEAR), *STATEMENT) == expect(
        "91 | 2017-01-12 | Cash Jar | 2.00 | 9.50 | 20.00 | 8.50"
    )
    assert reports.cash_statement_rows(book, None, "%", **YEAR).count() == 16


def test_statement_opening_carries_history(book):
    report = reports.statement_opening(book, [2], **YEAR)
    assert rows(report, "sid", "counter", "kind", "amount", "balance") == [
        (81, None, "debit", money("1.00"), money("121.00")),
        (63, "Cash Wallet,Food", "credit", money("10.00"), money("120.00")),
        (32, "Cash Wallet", "credit", money("20.00"), money("130.00")),
        (21, "Salary", "debit", money("50.00"), money("150.00")),
    ]


def test_statement_history_oldest_first(book):
    assert rows(reports.statement_history(book, [2]), "sid", "balance") == [
        (11, money("100.00")),
        (21, money("150.00")),
        (32, money("130.00")),
        (63, money("120.00")),
        (81, money("121.00")),
    ]


def test_imbalances(micro):
    assert rows(reports.imbalances(micro), "tid", "s") == [(8, money("1.00"))]


def test_same_day_ties_sort_by_unsigned_amount_then_sid(spark):
    book = make_ledger(
        spark,
        [(1, "asset", "A", None), (2, "asset", "B", None)],
        [(1, "2017-01-01", "x"), (2, "2017-01-01", "y")],
        [
            (1, 1, 1, "debit", "5.00", None),
            (2, 1, 2, "credit", "5.00", None),
            (3, 2, 1, "credit", "9.00", None),
            (4, 2, 2, "debit", "9.00", None),
            (5, 2, 1, "debit", "9.00", None),
        ],
    )
    report = reports.account_statement(book, [1])
    assert rows(report, "sid", "balance") == [(5, money("5.00")), (3, money("5.00")), (1, money("5.00"))]


def test_sql_with_bound_parameters(micro):
    query = "SELECT t.tid FROM {transactions} t JOIN {splits} s ON s.tid = t.tid WHERE t.description LIKE :p AND s.amount > :low"
    assert rows(micro.sql(query, p="M%", low=6), "tid") == [(6,), (6,)]
    assert micro.sql(query, p="' OR '1'='1", low=0).count() == 0
