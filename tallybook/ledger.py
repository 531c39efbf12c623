"""The ledger: three DataFrames that travel together."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Version:
    """A published version of a book: where it is, and its number."""

    root: str
    year: str
    number: int


@dataclass(frozen=True)
class Ledger:
    """Accounts, transactions and splits of one book.

    ``journal``, ``counters`` and ``checkpoints`` are optional and come together: the splits already
    joined with their date and account name, the account names of each side of a transaction
    (see ``operators.journal``), and balances by account, year and month (``operators.checkpoints``). Reports read them when
    they are there and join the three tables when they are not.

    ``version`` is the published version it was read from; ledgers staged from it keep it, so that
    publishing them can tell whether the book has moved on. ``published`` holds only for the tables of that
    version as they were read, which passed every check. ``merged`` tells that tables are put together with changes
    whenever they are read.
    """

    accounts: DataFrame
    transactions: DataFrame
    splits: DataFrame
    journal: DataFrame | None = None
    counters: DataFrame | None = None
    checkpoints: DataFrame | None = None
    version: Version | None = None
    published: bool = False
    merged: bool = False

    def stage(self, **tables: DataFrame | bool) -> Ledger:
        """A copy with some tables replaced; the journal no longer fits, so it goes."""
        return replace(self, journal=None, counters=None, checkpoints=None, published=False, **tables)

    def sql(self, query: str, **parameters) -> DataFrame:
        """Run a SQL query over ``{accounts}``, ``{transactions}`` and ``{splits}``.

        Parameters are bound by name (``:start``), never pasted into the text.
        """
        return self.splits.sparkSession.sql(
            query,
            args=parameters,
            accounts=self.accounts,
            transactions=self.transactions,
            splits=self.splits,
        )


@dataclass(frozen=True)
class Change:
    """What differs in one table: whole rows that are new or changed, and keys of rows that are gone."""

    rows: DataFrame
    gone: DataFrame


@dataclass(frozen=True)
class Staged:
    """Outcome of a batch of changes: the ledger after it, and what was refused.

    ``ledger`` and the ledger the batch started from are separate lineages:
    reading ``ledger`` previews the changes, dropping it rolls them back.
    ``inserted`` tells which row came of which request: (``seq``, ``table_name``, ``id``); None
    for a batch that inserts nothing.

    ``rows`` and ``gone`` say the same as ``ledger`` by what differs: per table, the rows that are new
    or no longer read as before, whole, and the keys of rows that are deleted. ``base`` is the ledger they
    differ from; without it they say nothing.
    """

    ledger: Ledger
    rejects: DataFrame
    inserted: DataFrame | None = None
    rows: dict[str, DataFrame] = field(default_factory=dict)
    gone: dict[str, DataFrame] = field(default_factory=dict)
    base: Ledger | None = None
