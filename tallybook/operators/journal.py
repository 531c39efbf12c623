"""The journal: every split with date, description and account name, and who is opposite it.

This is the one wide join of the library. Reports can do it on the fly; a book
that is read often keeps the result as tables (``sources.book.publish``): the journal, a row per
split, and the counters, a list of account names per side of a transaction. A
transaction of n splits and m accounts takes n + m names there, not n times m.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import mentions_cash
from tallybook.ledger import Ledger
from tallybook.operators.checkpoints import build_checkpoints
from tallybook.operators.counters import attach_names, cash_sides, opposite, side_names
from tallybook.operators.joins import named_accounts
from tallybook.operators.skew import join_facts
from tallybook.sources.schema import COUNTERS, JOURNAL, SPLITS


def journal_rows(ledger: Ledger, rows: DataFrame | None = None) -> DataFrame:
    """Splits with date, description and account name; NULL where the other tables have none.

    ``rows`` are the splits to make rows of, with their ``account`` name, if not all are wanted.
    """
    if rows is None:
        if ledger.journal is not None:
            return ledger.journal
        rows = ledger.splits.join(named_accounts(ledger), "aid", "left")
    return join_facts(rows, ledger.transactions.select("tid", "date", "description"), "tid")


def names_of(ledger: Ledger) -> DataFrame:
    """(tid, side, names, ...), stored or made from the tables."""
    return side_names(ledger) if ledger.counters is None else ledger.counters


def build_journal(ledger: Ledger) -> DataFrame:
    """Every split with date, description, account name and ``counter``, the names opposite it."""
    rows = attach_names(journal_rows(ledger), names_of(ledger))
    return rows.select(*SPLITS.names, "date", "description", "account", "counter")


def stored_journal(ledger: Ledger) -> DataFrame:
    """The rows of the journal table: what one transaction says is put together before its splits meet it."""
    mentioning = named_accounts(ledger).filter(mentions_cash(F.col("account")))
    sides = cash_sides(ledger.splits.join(mentioning, "aid"))
    facts = ledger.transactions.select("tid", "date", "description").join(sides, "tid", "full")
    rows = ledger.splits.join(named_accounts(ledger), "aid", "left")
    joined = join_facts(rows, facts, "tid").withColumn("counter_cash", opposite("cash"))
    return joined.select(*JOURNAL.names)


def stored_counters(ledger: Ledger) -> DataFrame:
    """The rows of the counters table: lists of names, with the date of their transaction."""
    dates = ledger.transactions.select("tid", "date")
    return side_names(ledger).join(dates, "tid", "left").select(*COUNTERS.names)


def with_journal(ledger: Ledger) -> Ledger:
    """The ledger with its journal as plans over its tables."""
    return replace(
        ledger, journal=stored_journal(ledger), counters=stored_counters(ledger), checkpoints=build_checkpoints(ledger)
    )
