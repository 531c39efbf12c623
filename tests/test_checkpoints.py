"""Opening balances from stored ones, against reports that add up all history."""

import random
from dataclasses import replace

import pytest
from micro_ledger import make_ledger, rows
from pyspark.sql import functions as F

from tallybook.operators.checkpoints import month_of
from tallybook.plans import reports
from tallybook.sources import book

DATES = ["1998-12-31", "1999-01-01", "1999-06-15", "1999-06-30", "2001-02-28", "2001-03-01", "2001-03-31", "2001-12-31", "2004-02-29", "2004-12-01"]


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    """Two accounts with gaps of years, one that starts late, one without splits, a split without a transaction."""
    rng = random.Random(1)
    accounts = [(1, "asset", "Checking", None), (2, "income", "Salary", None), (3, "asset", "Late", None), (4, "asset", "Idle", None)]
    transactions = [(i, d, f"on {d}") for i, d in enumerate(DATES * 2)]
    splits = []
    for tid, day, _ in transactions:
        pair = (1, 3) if day > "2004" else (1, 2)
        for aid, kind in zip(pair, ("debit", "credit"), strict=True):
            splits.append((len(splits), tid, aid, kind, f"{rng.randint(1, 99)}.25", None))
    splits.append((len(splits), 999, 1, "debit", "5.00", None))
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    return book.store_unchecked(make_ledger(spark, accounts, transactions, splits), f"{folder}/tables", journal=False), folder


@pytest.fixture(scope="module")
def stored(plain):
    ledger, folder = plain
    book.write_journal(ledger, folder)
    return book.read_journal(ledger, folder)


STARTS = ["1990-01-01", "1998-12-31", "1999-06-20", "2000-07-01", "2001-03-01", "2001-03-15", "2004-02-29", "2005-01-01", "2030-05-05"]


@pytest.mark.parametrize("start", STARTS)
def test_openings_are_those_of_all_history(plain, stored, start):
    for aids, end in ((None, None), ([1, 3], "2004-12-01"), (plain[0].accounts.filter("aid = 2"), None)):
        want = reports.statement_opening(plain[0], aids, start, end).collect()
        assert reports.statement_opening(stored, aids, start, end).collect() == want


def test_rows_of_chosen_splits(plain, stored):
    for sids in ([0], [5, 18, 19, 30], plain[0].splits.filter("aid = 3"), [40], []):
        want = reports.account_statement_rows(plain[0], sids).collect()
        assert reports.account_statement_rows(stored, sids).collect() == want


def test_history_before_the_month_is_not_read(stored):
    """The block of the year and the month's own rows are all that a late report needs."""
    start = "2004-12-01"
    late = replace(
        stored,
        journal=stored.journal.filter(F.col("date") >= str(month_of(start))),
        checkpoints=stored.checkpoints.filter("year = 2004"),
    )
    want = rows(reports.statement_opening(stored, None, start), "sid", "balance")
    assert rows(reports.statement_opening(late, None, start), "sid", "balance") == want and want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_cut(stored):
    text = plan(reports.statement_opening(stored, None, "2004-02-29", ordered=False))
    scans = [line for line in text.split("\n") if "FileScan" in line]
    journal = [line for line in scans if "amount" in line.split("DataFilters")[0]]
    assert journal and all("GreaterThanOrEqual(date,2004-02-" in line for line in journal)
    blocks = [line for line in scans if "/checkpoints" in line and "balance" in line.split("DataFilters")[0]]
    assert len(blocks) == 1 and "least(2004" in blocks[0].split("PartitionFilters")[1]


def test_size_grows_with_accounts_and_years(stored):
    assert sorted(rows(stored.checkpoints.filter("month = 0").groupBy("aid").count(), "aid", "count")) == [(1, 7), (2, 7), (3, 1)]
    assert stored.checkpoints.filter("month > 0").count() == stored.journal.filter("date is not null").select("aid", F.trunc("date", "month")).distinct().count()


def test_a_changed_ledger_has_none(stored):
    staged = stored.stage(splits=stored.splits.filter("sid <> 0"))
    assert staged.checkpoints is None and staged.journal is None
