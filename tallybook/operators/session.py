"""A ledger being changed in several steps, kept as what differs from where it started.

Every step is judged and computed once and written to the shared folder: per table, the rows that are
new or read differently, and the keys of deleted rows. The ledger after the steps is merged when it is read: the
rows of the first ledger whose keys are in neither, and the stored rows. Filters of a report reach the
scans of both, so a scoped report reads its scope and the changes, whatever led to them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.ledger import Change, Ledger, Staged
from tallybook.operators import edits
from tallybook.operators.changes import merged
from tallybook.operators.scopes import in_keys, not_in_keys, stored_columns
from tallybook.sources.schema import KEYS, REJECTS, TABLES

#: Cells that read differently: ``old`` is NULL for new rows, ``new`` for deleted ones.
CELLS = ("table_name", "key", "column_name", "old", "new")


@dataclass(frozen=True)
class Session:
    """A first ledger and the changes since. Each step returns a new session; older ones stay as they are."""

    base: Ledger
    changes: dict[str, Change] = field(default_factory=dict)
    rejects: DataFrame | None = None
    inserted: DataFrame | None = None

    @property
    def ledger(self) -> Ledger:
        """The first ledger with all changes, merged when it is read."""
        return merged(self.base, self.changes)

    @property
    def staged(self) -> Staged:
        """The ledger with the rejects of all steps, to be published."""
        rejects = self.rejects
        if rejects is None:
            rejects = self.base.splits.sparkSession.createDataFrame([], REJECTS)
        rows, gone = ({name: getattr(c, part) for name, c in self.changes.items()} for part in ("rows", "gone"))
        return Staged(self.ledger, rejects, rows=rows, gone=gone, base=self.base)

    def _after(self, step: Staged) -> Session:
        """The session with one more step, its rows and keys written now."""
        changes = dict(self.changes)
        for name in TABLES:
            if name not in step.rows and name not in step.gone:
                continue
            key = KEYS[name]
            rows = step.rows[name].select(*TABLES[name].names) if name in step.rows else None
            gone = step.gone[name].select(key).distinct() if name in step.gone else None
            if name in changes:
                before = changes[name]
                for newer in (rows, gone):
                    if newer is not None:
                        before = replace(before, rows=not_in_keys(before.rows, key, newer))
                rows = before.rows if rows is None else before.rows.unionByName(rows)
                gone = before.gone if gone is None else before.gone.unionByName(gone).distinct()
            empty = getattr(self.base, name).limit(0)
            changes[name] = Change(
                stored_columns(empty if rows is None else rows),
                stored_columns(empty.select(key) if gone is None else gone),
            )
        # of judged edits, which are stored, if there are any
        rejects = step.rejects
        if self.rejects is not None:
            rejects = self.rejects.unionByName(rejects)
        inserted = None if step.inserted is None else stored_columns(step.inserted)
        return Session(self.base, changes, rejects, inserted)

    def edit(self, batch: dict[str, DataFrame]) -> Session:
        """Apply edits, given per view (``edits.apply_edits``); they are judged once."""
        return self._after(edits.apply_edits(self.ledger, batch, keep=stored_columns))

    def insert_accounts(self, requests: DataFrame, gapless: bool = False) -> Session:
        return self._after(edits.insert_accounts(self.ledger, requests, gapless))

    def insert_transactions(self, requests: DataFrame, today=None, gapless: bool = False) -> Session:
        return self._after(edits.insert_transactions(self.ledger, requests, today, gapless))

    def insert_splits(self, requests: DataFrame, gapless: bool = False) -> Session:
        return self._after(edits.insert_splits(self.ledger, requests, keep=stored_columns, gapless=gapless))

    def delete_accounts(self, requests: DataFrame) -> Session:
        return self._after(edits.delete_accounts(self.ledger, requests, keep=stored_columns))

    def delete_transactions(self, requests: DataFrame) -> Session:
        return self._after(edits.delete_transactions(self.ledger, requests))

    def delete_splits(self, requests: DataFrame) -> Session:
        return self._after(edits.delete_splits(self.ledger, requests))

    def delete_by_statement_row(self, requests: DataFrame) -> Session:
        return self._after(edits.delete_by_statement_row(self.ledger, requests, keep=stored_columns))

    def rollback(self) -> Session:
        """The first ledger, without changes."""
        return Session(self.base)

    def cells(self, tables: Iterable[str] = tuple(TABLES)) -> DataFrame:
        """What differs, cell by cell (``CELLS``): only touched rows of the first ledger are read."""
        parts = [self._cells(name) for name in tables if name in self.changes]
        if not parts:
            return self.base.splits.sparkSession.createDataFrame([], ", ".join(f"{c} {'long' if c == 'key' else 'string'}" for c in CELLS))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _cells(self, name: str) -> DataFrame:
        change, key = self.changes[name], KEYS[name]
        touched = change.rows.select(key).unionByName(change.gone).distinct()
        before = in_keys(getattr(self.base, name), key, touched)
        columns = [f.name for f in TABLES[name] if f.name != key]
        was, now = (df.select(F.col(key).alias("key"), F.struct(*columns).alias(side)) for df, side in ((before, "was"), (change.rows, "now")))
        each = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.col(f"was.{c}").cast("string").alias("old"),
                    F.col(f"now.{c}").cast("string").alias("new"),
                )
                for c in columns
            ]
        )
        joined = was.join(now, "key", "full").select("key", F.explode(each).alias("cell")).select("key", "cell.*")
        return joined.filter(~F.col("old").eqNullSafe(F.col("new"))).select(F.lit(name).alias("table_name"), *CELLS[1:])
