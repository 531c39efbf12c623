"""Equi joins between the three tables.

No side is forced to be broadcast: Spark sends the accounts along when their
measured size allows, and otherwise sorts and merges, where adaptive execution
splits the partition of an account or transaction that holds many of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.ledger import Ledger


def named_accounts(ledger: Ledger) -> DataFrame:
    return ledger.accounts.select("aid", F.col("name").alias("account"))


def enrich_splits(ledger: Ledger) -> DataFrame:
    """Every split with its account name and its transaction's date and description."""
    return ledger.splits.join(named_accounts(ledger), "aid", "left").join(
        ledger.transactions.select("tid", "date", "description"), "tid", "left"
    )


def splits_with_account(ledger: Ledger) -> DataFrame:
    """Every split with its account name; a split without an account drops out."""
    return ledger.splits.join(named_accounts(ledger), "aid")


def accounts_left_splits(ledger: Ledger) -> DataFrame:
    """Every account with each of its splits; one without splits appears once.

    A left join, taken apart: adaptive execution can split an account's many
    splits in an inner join, but not on the right of an outer one.
    """
    splits = ledger.splits.select("sid", "tid", "aid", F.col("kind").alias("side"), "amount")
    matched = ledger.accounts.join(splits, "aid")
    idle = ledger.accounts.join(splits.select("aid").distinct(), "aid", "left_anti")
    return matched.unionByName(idle, allowMissingColumns=True)


def transactions_of(ledger: Ledger, splits: DataFrame) -> DataFrame:
    """The transactions that a set of splits belongs to, each once."""
    return ledger.transactions.join(splits.select("tid").distinct(), "tid", "left_semi")


def dated_splits(ledger: Ledger) -> DataFrame:
    """Splits with the date of their transaction; a split without one drops out."""
    if ledger.journal is not None:
        return ledger.journal.filter(F.col("date").isNotNull())
    return ledger.splits.join(ledger.transactions.select("tid", "date"), "tid")
