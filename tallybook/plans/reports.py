"""Reports over a ledger.

Each takes a set of accounts, transactions or splits and defaults to all of
them. Money comes back as decimals and, under ``<name>_text``, as fixed-width
text. ``ordered=False`` leaves out the final sort, for callers that aggregate
further or write the rows unordered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import (
    amount_of,
    credit_sum,
    debit_sum,
    money_text,
    signed_amount,
    signed_sum,
)
from tallybook.functions.text import is_cash_account, kind_rank, like, mentions_cash
from tallybook.ledger import Ledger
from tallybook.operators.asof import attach, running_totals
from tallybook.operators.checkpoints import month_of, moves_of_months, openings_before, openings_of
from tallybook.operators.checks import imbalances
from tallybook.operators.counters import attach_names, cash_sides, opposite
from tallybook.operators.journal import journal_rows, names_of
from tallybook.operators.joins import dated_splits, named_accounts, splits_with_account
from tallybook.operators.scopes import Keys, cut, in_dates, in_keys, stored_columns, stored_keys, zoom
from tallybook.operators.skew import join_facts
from tallybook.sources.schema import ACCOUNT_KINDS, SPLIT_KINDS

__all__ = [
    "account_balances",
    "account_statement",
    "account_statement_rows",
    "account_sums",
    "cash_statement",
    "cash_statement_rows",
    "external_sums",
    "imbalances",
    "split_list",
    "statement_history",
    "statement_opening",
    "transaction_list",
]


def _sorted(df: DataFrame, ordered: bool, *keys) -> DataFrame:
    return df.orderBy(*keys) if ordered else df


# -- accounts, transactions, splits --------------------------------------------


def account_sums(ledger: Ledger) -> DataFrame:
    """Signed, debit and credit sums of every account that has splits."""
    return ledger.splits.groupBy("aid").agg(
        signed_sum().alias("balance"),
        debit_sum().alias("debits"),
        credit_sum().alias("credits"),
    )


def account_balances(ledger: Ledger, aids: Keys = None, ordered: bool = True) -> DataFrame:
    """All accounts with their balance; an account without splits has zero."""
    accounts = in_keys(ledger.accounts, "aid", aids)
    # One row per account leaves the sum, so even a hot account joins as one row.
    # A list of accounts also filters the scan; a frame of them acts in that join.
    splits = ledger.splits if isinstance(aids, DataFrame) else in_keys(ledger.splits, "aid", aids)
    sums = splits.groupBy("aid").agg(signed_sum().alias("balance"))
    balance = F.coalesce("balance", F.lit(0)).cast(sums.schema["balance"].dataType)
    report = accounts.join(sums, "aid", "left").select(
        "aid",
        "kind",
        "name",
        "description",
        balance.alias("balance"),
        money_text(balance).alias("balance_text"),
    )
    return _sorted(report, ordered, kind_rank(F.col("kind"), ACCOUNT_KINDS), "name", "aid")


def transaction_list(ledger: Ledger, ordered: bool = True) -> DataFrame:
    """All transactions, newest first."""
    report = ledger.transactions.select("tid", "date", "description")
    return _sorted(report, ordered, F.desc("date"), F.desc("tid"))


def split_list(ledger: Ledger, sids: Keys = None, tids: Keys = None, ordered: bool = True) -> DataFrame:
    """Splits with their account name, by transaction, credits first."""
    scoped = ledger.stage(splits=in_keys(in_keys(ledger.splits, "sid", sids), "tid", tids))
    report = splits_with_account(scoped).select(
        "sid", "tid", "account", "kind", "amount", money_text(F.col("amount")).alias("amount_text"), "memo"
    )
    return _sorted(report, ordered, "tid", F.desc(kind_rank(F.col("kind"), SPLIT_KINDS)), "sid")


# -- statements ------------------------------------------------------------------


def _statement(rows: DataFrame, names: DataFrame, ordered: bool, wide: int) -> DataFrame:
    """Common columns and order: newest first, then the larger unsigned amount."""
    raw = F.col("amount")
    report = attach_names(rows, names).select(
        "sid",
        "date",
        "description",
        "account",
        F.coalesce("counter", F.lit("")).alias("counter"),
        raw.alias("unsigned"),
        signed_amount().alias("amount"),
        "balance",
        "debit_balance",
        "credit_balance",
    )
    report = _sorted(report, ordered, F.desc("date"), F.desc("unsigned"), F.desc("sid")).drop("unsigned")
    return report.withColumns({
        "amount_text": money_text(F.col("amount")),
        "balance_text": money_text(F.col("balance")),
        "debit_balance_text": money_text(F.col("debit_balance"), wide),
        "credit_balance_text": money_text(F.col("credit_balance"), wide),
    })


def _running() -> dict[str, Column]:
    return {
        "balance": signed_amount(),
        "debit_balance": amount_of("debit"),
        "credit_balance": amount_of("credit"),
    }


def _in_scope(start, end, pattern: str = "%") -> Column:
    """Transactions in scope; one without a description fits no pattern."""
    return in_dates(start, end) & like(F.col("description"), pattern)


def _cut(ledger: Ledger, start, end, pattern: str = "%") -> Ledger:
    """The ledger of the transactions in scope; all of it if everything is, or if a journal is at hand."""
    if ledger.journal is not None or (start is None and end is None and pattern == "%"):
        return ledger
    return cut(ledger, ledger.transactions.filter(_in_scope(start, end, pattern)))


def _of_dates(ledger: Ledger, start, end) -> Ledger:
    """The ledger with the transactions of the dates, for joins with them: the splits of others meet none."""
    if ledger.journal is not None or (start is None and end is None):
        return ledger
    return ledger.stage(transactions=ledger.transactions.filter(_in_scope(start, end)))


def _dated(detail: DataFrame, start, end) -> DataFrame:
    """Rows in ``[start, end)``; a split without a transaction has no date and is in no statement."""
    return detail.filter(F.col("date").isNotNull() & in_dates(start, end))


def _names(near: Ledger, start=None, end=None) -> DataFrame:
    """Account names of the sides of transactions; stored ones of the dates only."""
    names = names_of(near)
    return names if near.counters is None else names.filter(in_dates(start, end))


def _of_accounts(ledger: Ledger, aids: Keys, start=None, end=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Journal rows of the wanted accounts, their splits with dates, and the names opposite.

    The dates only spare work.
    """
    near = _cut(ledger, start, end)
    if aids is not None and ledger.journal is None:
        near = zoom(ledger, stored_keys(in_keys(ledger.splits, "aid", aids), "tid"))
    detail = in_keys(journal_rows(near), "aid", aids).filter(F.col("account").isNotNull())
    return detail, in_keys(dated_splits(near), "aid", aids), _names(near, start, end)


def _chosen(ledger: Ledger, sids: Keys) -> DataFrame | None:
    """Keys of the wanted splits, with their transactions and accounts, written once; None for all."""
    return None if sids is None else stored_columns(in_keys(ledger.splits, "sid", sids).select("sid", "tid", "aid"))


def _of_splits(ledger: Ledger, chosen: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Journal rows of the chosen splits, the dates to probe for them, and the names opposite.

    Of a merged ledger the chosen transactions are written once, with all their splits and which of them are chosen: they
    are read several times, and its tables would be put together whenever they are.
    """
    near = ledger if chosen is None or ledger.journal is not None else zoom(ledger, chosen)
    if chosen is None or not ledger.merged:
        return in_keys(journal_rows(near), "sid", chosen), in_keys(dated_splits(near), "sid", chosen), _names(near)
    marks = chosen.select("sid").distinct().withColumn("wanted", F.lit(True))
    splits = stored_columns(join_facts(near.splits, marks, "sid"))
    near = near.stage(transactions=stored_columns(near.transactions), splits=splits.drop("wanted"))
    own = near.stage(splits=splits.filter("wanted").drop("wanted"))
    return journal_rows(own), dated_splits(own), _names(near)


def account_statement(
    ledger: Ledger, aids: Keys = None, start=None, end=None, ordered: bool = True
) -> DataFrame:
    """Splits of each account with its running balance, debits and credits.

    Only splits in ``[start, end)`` count, so each balance starts from zero; without
    dates all of them do.
    """
    detail, moves, names = _of_accounts(ledger, aids, start, end)
    totals = running_totals(_dated(moves, start, end), _running(), by=("aid",))
    return _statement(attach(_dated(detail, start, end), totals, by=("aid",)), names, ordered, wide=5)


def account_statement_rows(
    ledger: Ledger, sids: Keys = None, start=None, end=None, ordered: bool = True
) -> DataFrame:
    """The statement rows of chosen splits, whatever their own date.

    The dates limit what is summed, not which rows appear: a row before
    ``start`` shows zero, a row after ``end`` the whole range's total.
    """
    chosen = _chosen(ledger, sids)
    detail, probes, names = _of_splits(ledger, chosen)
    if chosen is not None and ledger.checkpoints is not None and start is None and end is None:
        return _statement(_with_month_totals(ledger, detail), names, ordered, wide=5)
    # everything that ever moved the accounts of the chosen splits
    moves = in_keys(dated_splits(_of_dates(ledger, start, end)), "aid", chosen)
    totals = running_totals(moves.filter(in_dates(start, end)), _running(), by=("aid",), probes=probes)
    return _statement(attach(detail, totals, by=("aid",)), names, ordered, wide=5)


def _with_month_totals(ledger: Ledger, detail: DataFrame) -> DataFrame:
    """Rows with their account's totals up to their day, from what was stored before their month and the month itself."""
    detail = detail.withColumn("first", F.trunc("date", "month"))
    wanted = stored_columns(detail.filter("date is not null").select("aid", "first").distinct())
    keys = ("aid", "first")
    moves = moves_of_months(dated_splits(ledger), wanted)
    totals = running_totals(moves, _running(), by=keys, opening=openings_of(ledger.checkpoints, wanted))
    return attach(detail, totals, by=keys)


def _as_plan(df: DataFrame) -> DataFrame:
    return df


def _cash_book(
    ledger: Ledger, pattern: str, start, end, keep: Callable[[DataFrame], DataFrame] = _as_plan
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Journal rows of the cash accounts in scope, the same splits as movements, and the names opposite.

    Movements carry ``counter_cash``: whether an account opposite mentions cash. ``keep`` may store the splits of
    accounts that mention cash, which are read twice.
    """
    if ledger.journal is not None:
        scope = like(F.col("description"), pattern) & is_cash_account(F.col("account"))
        detail = _dated(ledger.journal.filter(scope), start, end)
        return detail, detail, _names(ledger, start, end)
    near = _cut(ledger, start, end, pattern)
    # Only accounts that mention cash can mark a transfer, and the cash accounts are among them.
    mentioning = named_accounts(near).filter(mentions_cash(F.col("account")))
    marking = keep(near.splits.join(mentioning, "aid"))
    splits = marking.filter(is_cash_account(F.col("account")))
    transactions = near.transactions.select("tid", "date", "description")
    facts = transactions.join(cash_sides(marking), "tid", "left")
    moves = join_facts(splits, facts, "tid", how="inner").withColumn("counter_cash", opposite("cash"))
    return _dated(journal_rows(near, splits), start, end), _dated(moves, start, end), _names(near)


def _internal() -> Column:
    """A transfer between cash accounts: the word for cash on both sides."""
    return mentions_cash(F.col("account")) & F.coalesce("counter_cash", F.lit(False))


def _cash_totals(moves: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    internal = _internal()
    measures = {
        "balance": signed_amount(),
        "debit_balance": amount_of("debit", unless=internal),
        "credit_balance": amount_of("credit", unless=internal),
    }
    return running_totals(moves, measures, probes=probes)


def cash_statement(
    ledger: Ledger, pattern: str = "%", start=None, end=None, ordered: bool = True
) -> DataFrame:
    """One statement across all cash accounts.

    The balance moves with every cash split; a transfer between cash accounts
    is left out of the running debits and credits.
    """
    detail, moves, names = _cash_book(ledger, pattern, start, end)
    return _statement(attach(detail, _cash_totals(moves)), names, ordered, wide=6)


def cash_statement_rows(
    ledger: Ledger,
    sids: Keys = None,
    pattern: str = "%",
    start=None,
    end=None,
    ordered: bool = True,
) -> DataFrame:
    """Cash-statement rows of chosen splits of any account, date and description."""
    chosen = _chosen(ledger, sids)
    detail, probes, names = _of_splits(ledger, chosen)
    _, moves, _ = _cash_book(ledger, pattern, start, end, keep=stored_columns if ledger.merged else _as_plan)
    totals = _cash_totals(moves, probes=probes)
    return _statement(attach(detail, totals), names, ordered, wide=6)


def external_sums(ledger: Ledger, pattern: str = "%", start=None, end=None) -> DataFrame:
    """Debits and credits of each cash account, transfers between cash accounts left out."""
    _, moves, _ = _cash_book(ledger, pattern, start, end)
    internal = _internal()
    return moves.groupBy("account").agg(debit_sum(internal).alias("debits"), credit_sum(internal).alias("credits"))


def _plain_statement(rows: DataFrame, names: DataFrame, *order) -> DataFrame:
    """Raw kind and amount, balance only, and NULL where there is no counter account."""
    report = attach_names(rows, names).select(
        "sid", "date", "description", "account", "counter", "kind", "amount", "balance"
    )
    return report.orderBy(*order) if order else report


def statement_history(ledger: Ledger, aids: Keys = None, ordered: bool = True) -> DataFrame:
    """Each account's whole history, oldest first."""
    return _plain_statement(*_with_balance(ledger, aids), *(("date", "sid") if ordered else ()))


def statement_opening(
    ledger: Ledger, aids: Keys = None, start=None, end=None, ordered: bool = True
) -> DataFrame:
    """Rows of ``[start, end)``, newest first, balances carrying all earlier history."""
    return _plain_statement(*_with_balance(ledger, aids, start, end), *((F.desc("date"), F.desc("sid")) if ordered else ()))


def _with_balance(ledger: Ledger, aids: Keys, start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """Rows of the dates with their running balance, and the names opposite."""
    detail, moves, names = _of_accounts(ledger, aids)
    if start is not None and ledger.checkpoints is not None:
        # what was stored before the month of ``start`` takes the place of all history before it
        month = month_of(start)
        opening = in_keys(openings_before(ledger.checkpoints, month), "aid", aids)
        near = moves.filter(in_dates(month, end))
        totals = running_totals(near, {"balance": signed_amount()}, by=("aid",), opening=opening)
        return attach(_dated(detail, start, end), totals, by=("aid",)), _names(ledger, start, end)
    # Rows on or after ``end`` cannot reach any balance shown.
    totals = running_totals(moves.filter(in_dates(None, end)), {"balance": signed_amount()}, by=("aid",))
    return attach(_dated(detail, start, end), totals, by=("aid",)), names

