"""The six views of a ledger: what each shows, which columns may change, and how."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import null_label
from tallybook.operators import edits
from tallybook.operators.scopes import in_keys
from tallybook.plans import reports


@dataclass(frozen=True)
class View:
    """A named view.

    ``columns`` maps each label to the report column behind it, in display
    order; ``update`` accepts edits of the labels in ``editable`` and rejects others. ``select`` runs
    the report, ``reselect`` the same for given ids only, usually on a staged
    ledger to show changed rows.
    """

    columns: dict[str, str]
    editable: frozenset[str]
    select: Callable[..., DataFrame]
    reselect: Callable[..., DataFrame]
    insert: Callable[..., edits.Staged]
    update: Callable[..., edits.Staged]
    delete: Callable[..., edits.Staged]
    nullable: frozenset[str] = field(default_factory=frozenset)
    refusal: str = edits.NOT_EDITABLE


def _enforced(spec: View) -> View:
    """The view with an ``update`` that rejects edits of other labels before the rest is judged."""
    change = spec.update

    def update(ledger, batch: DataFrame) -> edits.Staged:
        allowed = F.coalesce(F.col("field").isin(*sorted(spec.editable)), F.lit(False))
        staged = change(ledger, batch.filter(allowed))
        others = edits.refuse(ledger, batch.filter(~allowed), spec.refusal).rejects
        return replace(staged, rejects=staged.rejects.unionByName(others))

    return replace(spec, update=update)


def _reselect_transactions(ledger, tids, ordered: bool = True) -> DataFrame:
    return reports.transaction_list(ledger.stage(transactions=in_keys(ledger.transactions, "tid", tids)), ordered)


# Labels of the views, and the columns that may be edited.
_SPLIT_EDITABLE = frozenset({"tid", "account", "kind", "amount", "memo"})
_STATEMENT = {
    "date": "date",
    "description": "description",
    "account": "account",
    "counter": "counter",
    "amount": "amount_text",
    "balance": "balance_text",
    "debits": "debit_balance_text",
    "credits": "credit_balance_text",
}
_STATEMENT_EDITABLE = frozenset({"date", "description", "account", "counter", "amount"})

VIEWS = {
    "accounts": View(
        columns={"aid": "aid", "kind": "kind", "name": "name", "balance": "balance_text"},
        editable=frozenset({"kind", "name", "description"}),
        select=reports.account_balances,
        reselect=reports.account_balances,
        insert=edits.insert_accounts,
        update=edits.update_accounts,
        delete=edits.delete_accounts,
    ),
    "transactions": View(
        columns={"tid": "tid", "date": "date", "description": "description"},
        editable=frozenset({"date", "description"}),
        select=reports.transaction_list,
        reselect=_reselect_transactions,
        insert=edits.insert_transactions,
        update=edits.update_transactions,
        delete=edits.delete_transactions,
    ),
    "splits": View(
        columns={
            "sid": "sid",
            "tid": "tid",
            "account": "account",
            "kind": "kind",
            "amount": "amount_text",
            "memo": "memo",
        },
        editable=_SPLIT_EDITABLE,
        select=reports.split_list,
        reselect=reports.split_list,
        insert=edits.insert_splits,
        update=edits.update_splits,
        delete=edits.delete_splits,
        nullable=frozenset({"memo"}),
    ),
    "scoped_splits": View(
        columns={"sid": "sid", "kind": "kind", "account": "account", "amount": "amount_text", "memo": "memo"},
        editable=_SPLIT_EDITABLE - {"tid"},
        select=lambda ledger, tids, ordered=True: reports.split_list(ledger, tids=tids, ordered=ordered),
        reselect=reports.split_list,
        insert=edits.insert_splits,
        update=edits.update_splits,
        delete=edits.delete_splits,
        nullable=frozenset({"memo"}),
    ),
    "account_statement": View(
        columns=_STATEMENT,
        editable=_STATEMENT_EDITABLE,
        select=reports.account_statement,
        reselect=reports.account_statement_rows,
        insert=edits.insert_statement,
        update=edits.update_statement,
        delete=edits.delete_statement,
        refusal=edits.NOT_EDITABLE_STATEMENT,
    ),
    "cash_statement": View(
        columns=_STATEMENT,
        editable=_STATEMENT_EDITABLE,
        select=reports.cash_statement,
        reselect=reports.cash_statement_rows,
        insert=edits.insert_statement,
        update=edits.update_statement,
        delete=edits.delete_by_statement_row,
        refusal=edits.NOT_EDITABLE_STATEMENT,
    ),
}
VIEWS = {name: _enforced(spec) for name, spec in VIEWS.items()}


def project_view(report: DataFrame, view: str) -> DataFrame:
    """The columns a view shows, under its labels; a missing memo reads ``None``."""
    spec = VIEWS[view]
    return report.select(
        *[
            (null_label(F.col(column)) if label in spec.nullable else F.col(column)).alias(label)
            for label, column in spec.columns.items()
        ]
    )
