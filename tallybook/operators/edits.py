"""Bulk changes to a ledger.

An edit is a row ``(seq, target_id, field, value)``: set ``field`` of the row
with id ``target_id`` to the text ``value``. Every edit is judged against the
ledger as it was before the batch. Accepted edits are brought down to cells of
the three tables; where several reach the same cell, the highest ``seq`` wins (of equal ones
always the same edit; an amount set on a split goes before one set on its transaction).
The others become ``rejects``: refused with a reason, and marked fatal when a
database would have broken off the transaction. Batches may be as large as the
tables: all of it is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.text import (
    default_account_name,
    label_to_null,
    parse_amount,
    parse_date,
    parse_split_kind,
    parse_tid,
)
from tallybook.ledger import Ledger, Staged
from tallybook.operators.counters import opposite, side_counts
from tallybook.operators.ranks import numbered
from tallybook.operators.scopes import in_keys, not_in_keys
from tallybook.operators.skew import join_facts, join_some_facts
from tallybook.sources.schema import (
    ACCOUNT_KINDS,
    ACCOUNTS,
    EDITS,
    IMBALANCE_ACCOUNT,
    KEYS,
    MONEY,
    NEW_ACCOUNT_KIND,
    NEW_SPLIT_KIND,
    REJECTS,
    SPLIT_KINDS,
    SPLITS,
    TRANSACTIONS,
)

# Reasons for refusing a change.
NOT_EDITABLE = "This field cannot be updated."
NOT_EDITABLE_STATEMENT = "Cannot update field."
NO_STATEMENT_INSERT = "Cannot insert into statements."
NO_STATEMENT_DELETE = "Cannot delete from statements."
IRREGULAR_COUNTER = "Cannot update counter on irregular transactions."
IRREGULAR_AMOUNT = "Cannot update amount on irregular transactions."
NO_ACCOUNT = "No account named "
CANNOT_READ = "cannot read "
KIND_CHOICE = " must be one of debit, credit"
NO_SPLIT = "Unexpected query result in split update."
NO_STATEMENT_ROW = "Could not reselect row in statement update."

VIEWS = ("accounts", "transactions", "splits", "statement")


# -- shared steps ------------------------------------------------------------------


def lookup_account(ledger: Ledger, names: DataFrame) -> DataFrame:
    """The aid of each ``name``, for names that belong to exactly one account."""
    counted = ledger.accounts.groupBy("name").agg(F.count(F.lit(1)).alias("matches"), F.min("aid").alias("aid"))
    wanted = names.select("name").distinct()
    return counted.filter("matches = 1").join(wanted, "name", "left_semi").select("name", "aid")


def _sent_along(df: DataFrame) -> bool:
    """Whether Spark takes a frame to be small enough for a broadcast; nothing is read for it."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


Keep = Callable[[DataFrame], DataFrame]


def _as_plan(judged: DataFrame) -> DataFrame:
    return judged


class _Batch:
    """A batch of edits. Nothing is read while it is judged.

    ``keep`` is applied to the judged edits: it may store them, so that what follows reads them.
    """

    def __init__(self, edits: DataFrame, keep: Keep = _as_plan):
        self.edits, self.keep = edits.select(*EDITS.names), keep

    def found(self, table: DataFrame, key: str, *columns: str, by: str = "target_id") -> DataFrame:
        """Rows of ``table`` that the batch points at, keyed as ``by``."""
        wanted = self.edits.select(F.col(by).alias(key)).distinct()
        return table.join(wanted, key, "left_semi").select(F.col(key).alias(by), *columns)

    def facts(self, table: DataFrame, key: str, *columns: str, by: str = "target_id") -> DataFrame:
        """Rows of ``table`` for a left join of the edits, keyed as ``by``: at least those the batch points at.

        Finding them first spares a large table its shuffle where Spark can send the batch along. A larger batch
        would be shuffled once more for it, and so would the rows that were found: it meets the table directly.
        """
        if _sent_along(self.edits):
            return self.found(table, key, *columns, by=by)
        return table.select(F.col(key).alias(by), *columns)


def _first_reason(*tests: tuple[Column, Column | str, bool]) -> tuple[Column, Column]:
    """The reason of the first test that holds, and whether that one is fatal."""
    rows = [
        F.when(
            F.coalesce(test, F.lit(False)),
            F.struct((F.lit(r) if isinstance(r, str) else r).alias("reason"), F.lit(fatal).alias("fatal")),
        )
        for test, r, fatal in tests
    ]
    verdict = F.coalesce(*rows)
    return verdict["reason"], F.coalesce(verdict["fatal"], F.lit(False))


def _judge(batch: _Batch, edits: DataFrame, *tests: tuple[Column, Column | str, bool]) -> DataFrame:
    reason, fatal = _first_reason(*tests)
    return batch.keep(edits.withColumns({"reason": reason, "fatal": fatal}))


def _rejected(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNotNull()).select(*REJECTS.names)


def _accepted(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNull())


def _cells(accepted: DataFrame, key: str, column: Column | str, value: Column) -> DataFrame:
    column = F.col(column) if isinstance(column, str) else column
    return accepted.select(
        F.col(key).alias("key"), "seq", column.alias("column"), value.cast("string").alias("value")
    )


def _quoted(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.lit('"'), F.coalesce("value", F.lit("")), F.lit('"'))


def _is(field: str) -> Column:
    return F.col("field") == field


#: What a place in the order of edits leaves for the value, where edits of a cell share their ``seq``.
_PER_SEQ = 10**18


def _place() -> Column:
    """The place of a cell's edit: by ``seq``, then by a hash of the value, so that equal places are equal values."""
    by_value = F.pmod(F.xxhash64("value"), F.lit(_PER_SEQ))
    return F.col("seq").cast("decimal(20,0)") * F.lit(Decimal(_PER_SEQ)) + by_value.cast("decimal(18,0)")


def _is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType) and field.name != "kind"


def _kinds() -> Column:
    return F.array(*[F.lit(kind) for kind in (*ACCOUNT_KINDS, *SPLIT_KINDS)])


def _packed(field: T.StructField, value: Column) -> Column:
    """The value as a number; a kind as its place among the kinds."""
    return F.array_position(_kinds(), value).cast("int") if field.name == "kind" else value.cast(field.dataType)


def _unpacked(field: T.StructField, value: Column) -> Column:
    return F.try_element_at(_kinds(), value) if field.name == "kind" else value


def _last_values(cells: DataFrame, table: T.StructType, columns: Iterable[str]) -> DataFrame:
    """One row per key; per column the last value ``new_`` and its ``seq_``, which is NULL if it was never edited.

    Only numbers are aggregated: places, and values that are numbers. A text is fetched afterwards, by
    its key, by which the edits are laid out already: its place is the one that is not below the last.
    Of edits that share a cell and a ``seq`` one wins, always the same one.
    """
    fields = [table[c] for c in columns]
    cells = cells.withColumn("place", _place())
    picks = []
    for f in fields:
        mine = F.col("column") == f.name
        place = F.when(mine, F.col("place"))
        picks.append(F.max(F.when(mine, F.col("seq"))).alias(f"seq_{f.name}"))
        if _is_text(f):
            picks.append(F.max(place).alias(f"place_{f.name}"))
        else:
            picks.append(F.max_by(F.when(mine, _packed(f, F.col("value"))), place).alias(f"new_{f.name}"))
    last = cells.groupBy("key").agg(*picks)
    for f in filter(_is_text, fields):
        place = f"place_{f.name}"
        texts = cells.filter(F.col("column") == f.name)
        texts = texts.select(
            F.col("key").alias("text_key"), F.col("place").alias("text_place"), F.col("value").alias(f"new_{f.name}")
        )
        # laid out by key before repeated ones go, they need not be moved again for the join
        texts = texts.repartition("text_key").distinct()
        found = (F.col("key") == F.col("text_key")) & (F.col("text_place") >= F.col(place))
        last = last.join(texts, found, "left").drop("text_key", "text_place", place)
    return last


def _edited(field: T.StructField, columns: Iterable[str]) -> Column:
    """The cell after the edits, where the last ones were joined to its row."""
    if field.name not in columns:
        return F.col(field.name)
    new = _unpacked(field, F.col(f"new_{field.name}"))
    return F.when(F.col(f"seq_{field.name}").isNotNull(), new).otherwise(F.col(field.name)).alias(field.name)


def _overwrite(table: DataFrame, key: str, cells: DataFrame, columns: tuple[str, ...], touched: bool = False) -> DataFrame:
    """The table with its edited cells replaced, or its ``touched`` rows only: they are those that meet a cell."""
    last = _last_values(cells, table.schema, columns).withColumnRenamed("key", key)
    return table.join(last, key, "inner" if touched else "left").select(*[_edited(f, columns) for f in table.schema])


# -- judging the edits of each view --------------------------------------------------


class _Changes:
    """Accepted cells per table, the amounts set on whole transactions, and the rejects."""

    def __init__(self, accounts=(), transactions=(), splits=(), amounts=(), rejects=()):
        self.accounts, self.transactions, self.splits = list(accounts), list(transactions), list(splits)
        self.amounts, self.rejects = list(amounts), list(rejects)

    def __add__(self, other: _Changes) -> _Changes:
        return _Changes(
            self.accounts + other.accounts,
            self.transactions + other.transactions,
            self.splits + other.splits,
            self.amounts + other.amounts,
            self.rejects + other.rejects,
        )


def _account_changes(ledger: Ledger, batch: _Batch) -> _Changes:
    found = batch.facts(ledger.accounts, "aid").withColumn("known", F.lit(True))
    judged = _judge(
        batch,
        join_facts(batch.edits, found, "target_id"),
        (~F.col("field").isin("kind", "name", "description") | F.col("field").isNull(), NOT_EDITABLE, False),
        (
            _is("kind") & ~F.coalesce(F.col("value").isin(*ACCOUNT_KINDS), F.lit(False)),
            _quoted("invalid input value for enum account_kind: "),
            True,
        ),
        (_is("name") & F.col("value").isNull(), "null value in a required field", True),
        (F.col("known").isNull(), "no account with this id", True),
    )
    value = F.when(_is("description"), label_to_null(F.col("value"))).otherwise(F.col("value"))
    return _Changes(accounts=[_cells(_accepted(judged), "target_id", "field", value)], rejects=[_rejected(judged)])


def _bad_date() -> tuple[Column, Column, bool]:
    return (
        _is("date") & parse_date(F.col("value")).isNull(),
        _quoted("invalid input syntax for type date: "),
        True,
    )


def _transaction_value() -> Column:
    return F.when(_is("date"), parse_date(F.col("value")).cast("string")).otherwise(F.col("value"))


def _no_text() -> tuple[Column, str, bool]:
    return (_is("description") & F.col("value").isNull(), "null value in a required field", True)


def _transaction_changes(ledger: Ledger, batch: _Batch) -> _Changes:
    found = batch.facts(ledger.transactions, "tid").withColumn("known", F.lit(True))
    judged = _judge(
        batch,
        join_facts(batch.edits, found, "target_id"),
        (~F.col("field").isin("date", "description") | F.col("field").isNull(), NOT_EDITABLE, False),
        _bad_date(),
        _no_text(),
        (F.col("known").isNull(), "no transaction with this id", True),
    )
    return _Changes(
        transactions=[_cells(_accepted(judged), "target_id", "field", _transaction_value())],
        rejects=[_rejected(judged)],
    )


def _with_named_account(ledger: Ledger, batch: _Batch, *fields: str, **more: DataFrame) -> DataFrame:
    """Add ``named_aid``: the account that the value of a naming field stands for; and ``more`` facts, by keys of other fields."""
    edits = batch.edits.withColumn("name", F.when(F.col("field").isin(*fields), F.col("value")))
    named = lookup_account(ledger, edits).withColumnRenamed("aid", "named_aid")
    return join_some_facts(edits, {"name": named, **more}).drop("name")


def _split_changes(ledger: Ledger, batch: _Batch) -> _Changes:
    value = F.col("value")
    batch.edits = batch.edits.withColumn("home", F.when(_is("tid"), parse_tid(value)))
    found = batch.facts(ledger.splits, "sid").withColumn("known", F.lit(True))
    homes = batch.facts(ledger.transactions, "tid", by="home").withColumn("home_known", F.lit(True))
    edits = _with_named_account(ledger, batch, "account", home=homes)
    kind, amount = parse_split_kind(value), parse_amount(value)
    shown = F.coalesce(value, F.lit(""))
    judged = _judge(
        batch,
        join_facts(edits, found, "target_id"),
        (
            ~F.col("field").isin("tid", "account", "kind", "amount", "memo") | F.col("field").isNull(),
            NOT_EDITABLE,
            False,
        ),
        (_is("tid") & parse_tid(value).isNull(), F.concat(F.lit(CANNOT_READ), shown), False),
        (_is("account") & F.col("named_aid").isNull(), F.concat(F.lit(NO_ACCOUNT), shown), False),
        (_is("kind") & kind.isNull(), F.concat(shown, F.lit(KIND_CHOICE)), False),
        (_is("amount") & amount.isNull(), F.concat(F.lit(CANNOT_READ), shown), False),
        (F.col("known").isNull(), NO_SPLIT, True),
        (_is("tid") & F.col("home_known").isNull(), "no transaction with this id", True),
    )
    column = F.when(_is("account"), F.lit("aid")).otherwise(F.col("field"))
    new = (
        F.when(_is("tid"), parse_tid(value).cast("string"))
        .when(_is("account"), F.col("named_aid").cast("string"))
        .when(_is("kind"), kind)
        .when(_is("amount"), amount.cast("string"))
        .otherwise(label_to_null(value))
    )
    return _Changes(splits=[_cells(_accepted(judged), "target_id", column, new)], rejects=[_rejected(judged)])


def _statement_changes(ledger: Ledger, batch: _Batch) -> _Changes:
    value = F.col("value")
    shown = F.coalesce(value, F.lit(""))
    edits = _with_named_account(ledger, batch, "account", "counter")
    # a split without its transaction is in no statement, and has no opposite split there
    found = batch.facts(ledger.splits, "sid", "tid", "kind").join(
        ledger.transactions.select("tid"), "tid", "left_semi"
    )
    if _sent_along(batch.edits):
        sides = side_counts(ledger.splits.join(found.select("tid").distinct(), "tid", "left_semi"))
    else:
        # these are all splits of their transactions, laid out by them
        sides = side_counts(found.withColumnRenamed("target_id", "sid"))
    placed = join_facts(found, sides, "tid").select(
        "target_id",
        "tid",
        F.when(opposite("count") == 1, opposite("sid")).alias("opposite_sid"),
    )
    regular = F.col("opposite_sid").isNotNull()
    unnamed = F.concat(F.lit(NO_ACCOUNT), shown)
    judged = _judge(
        batch,
        join_facts(edits, placed, "target_id"),
        (
            ~F.col("field").isin("date", "description", "account", "counter", "amount")
            | F.col("field").isNull(),
            NOT_EDITABLE_STATEMENT,
            False,
        ),
        _bad_date(),
        _no_text(),
        (_is("account") & F.col("named_aid").isNull(), unnamed, False),
        (_is("counter") & ~regular, IRREGULAR_COUNTER, False),
        (_is("counter") & F.col("named_aid").isNull(), unnamed, False),
        (_is("amount") & ~regular, IRREGULAR_AMOUNT, False),
        (_is("amount") & parse_amount(value).isNull(), F.concat(F.lit(CANNOT_READ), shown), False),
        (F.col("tid").isNull(), NO_STATEMENT_ROW, True),
    )
    accepted = _accepted(judged)
    return _Changes(
        transactions=[
            _cells(accepted.filter(F.col("field").isin("date", "description")), "tid", "field", _transaction_value())
        ],
        splits=[
            _cells(
                accepted.filter(F.col("field").isin("account", "counter")).withColumn(
                    "moved_sid", F.when(_is("counter"), F.col("opposite_sid")).otherwise(F.col("target_id"))
                ),
                "moved_sid",
                F.lit("aid"),
                F.col("named_aid"),
            )
        ],
        amounts=[_cells(accepted.filter(_is("amount")), "tid", "field", parse_amount(value))],
        rejects=[_rejected(judged)],
    )


_JUDGES = {
    "accounts": _account_changes,
    "transactions": _transaction_changes,
    "splits": _split_changes,
    "statement": _statement_changes,
}


# -- updates -------------------------------------------------------------------------


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _new_splits(splits: DataFrame, changes: _Changes, touched: bool = False) -> DataFrame:
    """Splits after the batch, or the ``touched`` ones only.

    An amount set through a statement goes to every split of a transaction. It
    is joined per transaction, after the last such edit of each was picked, and
    then competes by ``seq`` with the edit of the split itself. Splits are touched that have
    an edited cell, and all those of transactions whose amount was set.
    """
    names = ("tid", "aid", "kind", "amount", "memo")
    joined, edited, met = splits, (), F.lit(False)
    if changes.splits:
        own, edited = _last_values(_all(changes.splits), splits.schema, names).withColumnRenamed("key", "sid"), names
        joined, met = joined.join(own.withColumn("own", F.lit(True)), "sid", "left"), F.col("own").isNotNull()
    out = {f.name: _edited(f, edited) for f in splits.schema}
    if changes.amounts:
        whole = _last_values(_all(changes.amounts), splits.schema, ["amount"]).select(
            F.col("key").alias("tid"),
            F.col("new_amount").alias("whole_amount"),
            F.col("seq_amount").alias("whole_seq"),
            F.lit(True).alias("whole"),
        )
        joined, met = join_facts(joined, whole, "tid"), met | F.col("whole").isNotNull()
        later = F.col("whole_seq").isNotNull()
        if edited:
            later &= F.col("seq_amount").isNull() | (F.col("whole_seq") > F.col("seq_amount"))
        out["amount"] = F.when(later, F.col("whole_amount")).otherwise(out["amount"]).alias("amount")
    return (joined.filter(met) if touched else joined).select(*out.values())


def apply_edits(ledger: Ledger, edits: dict[str, DataFrame], keep: Keep = _as_plan) -> Staged:
    """Apply one batch of edits, given per view they were made in.

    The keys are from ``VIEWS``; ``seq`` orders the edits of all views together. ``keep`` may store the
    judged edits of a view, which several results are made of.
    """
    unknown = set(edits) - set(VIEWS)
    if unknown or not edits:
        raise ValueError(f"edits must be given for some of {VIEWS}, not {sorted(unknown)}")
    changes = reduce(lambda a, b: a + b, [_JUDGES[view](ledger, _Batch(df, keep)) for view, df in edits.items()])
    new = {}
    if changes.accounts:
        cells = _all(changes.accounts)
        new["accounts"] = lambda touched: _overwrite(ledger.accounts, "aid", cells, ("kind", "name", "description"), touched)
    if changes.transactions:
        dated = _all(changes.transactions)
        new["transactions"] = lambda touched: _overwrite(ledger.transactions, "tid", dated, ("date", "description"), touched)
    if changes.splits or changes.amounts:
        new["splits"] = lambda touched: _new_splits(ledger.splits, changes, touched)
    return Staged(
        ledger.stage(**{name: change(False) for name, change in new.items()}),
        _all(changes.rejects),
        rows={name: change(True) for name, change in new.items()},
        base=ledger,
    )


def update_accounts(ledger: Ledger, edits: DataFrame) -> Staged:
    """Edit kind, name or description of accounts, by aid."""
    return apply_edits(ledger, {"accounts": edits})


def update_transactions(ledger: Ledger, edits: DataFrame) -> Staged:
    """Edit date or description of transactions, by tid."""
    return apply_edits(ledger, {"transactions": edits})


def update_splits(ledger: Ledger, edits: DataFrame) -> Staged:
    """Edit tid, account (by name), kind, amount or memo of splits, by sid."""
    return apply_edits(ledger, {"splits": edits})


def update_statement(ledger: Ledger, edits: DataFrame) -> Staged:
    """Edit statement rows, by sid.

    Date and description belong to the whole transaction. The counter account
    and the amount can only be set where the split has a single opposite split;
    the amount then goes to every split of the transaction.
    """
    return apply_edits(ledger, {"statement": edits})


# -- inserts -------------------------------------------------------------------------


def _next_ids(table: DataFrame, key: str, requests: DataFrame) -> Column:
    """Ids after the highest one in use, in the order of ``seq``.

    Like the numbers of a database sequence they may have gaps, where ``seq``
    has them. No row waits for another, so a batch of any size is numbered in
    parallel; ``seq`` must not repeat within the batch. ``_numbered`` has no gaps and takes any ``seq``.
    """
    last = table.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    first = requests.agg(F.min("seq")).scalar()
    return (last + F.lit(1) + F.col("seq") - first).cast("long")


def _numbered(table: DataFrame, key: str, requests: DataFrame, gapless: bool, *columns: str) -> DataFrame:
    """``seq`` and other columns of the requests, and the id of each as ``key``.

    ``gapless`` ids follow each other in the order of ``seq``, then of the other columns; ``seq`` may be sparse,
    negative, or repeat.
    """
    if not gapless:
        return requests.select("seq", _next_ids(table, key, requests).alias(key), *columns)
    last = table.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    return numbered(requests.withColumn("seq", F.col("seq").cast("long")), "seq", *columns).select(
        "seq", (last + F.lit(1) + F.col("number")).cast("long").alias(key), *columns
    )


def _shaped(rows: DataFrame, schema) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def _no_rejects(requests: DataFrame) -> DataFrame:
    return requests.limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in REJECTS])


def _inserted(rows: DataFrame, table: str, key: str) -> DataFrame:
    return rows.select("seq", F.lit(table).alias("table_name"), F.col(key).alias("id"))


def _with_rows(ledger: Ledger, table: str, rows: DataFrame, rejects: DataFrame, inserted: DataFrame) -> Staged:
    """The ledger with new rows in one table."""
    staged = ledger.stage(**{table: getattr(ledger, table).unionByName(rows)})
    return Staged(staged, rejects, inserted, rows={table: rows}, base=ledger)


def insert_accounts(ledger: Ledger, requests: DataFrame, gapless: bool = False) -> Staged:
    """One new account per row of ``requests(seq)``, named after its number.

    With ``gapless`` the ids of a batch follow each other, and ``seq`` may be any longs, repeated ones too (so with every insert).
    """
    new = _numbered(ledger.accounts, "aid", requests, gapless)
    rows = new.select(
        "aid",
        F.lit(NEW_ACCOUNT_KIND).alias("kind"),
        default_account_name(F.col("aid")).alias("name"),
        F.lit(None).alias("description"),
    )
    return _with_rows(ledger, "accounts", _shaped(rows, ACCOUNTS), _no_rejects(requests), _inserted(new, "accounts", "aid"))


def insert_transactions(ledger: Ledger, requests: DataFrame, today=None, gapless: bool = False) -> Staged:
    """One new transaction per row of ``requests(seq)``: today, without description."""
    rows = _numbered(ledger.transactions, "tid", requests, gapless).select(
        "seq",
        "tid",
        (F.current_date() if today is None else F.lit(today)).alias("date"),
        F.lit("").alias("description"),
    )
    return _with_rows(ledger, "transactions", _shaped(rows, TRANSACTIONS), _no_rejects(requests), _inserted(rows, "transactions", "tid"))


def insert_splits(ledger: Ledger, requests: DataFrame, keep: Keep = _as_plan, gapless: bool = False) -> Staged:
    """One new split per row of ``requests(seq[, tid])``: a debit of zero.

    Without a ``tid`` it joins the transaction with the lowest one. The account
    is the one named for imbalances; without exactly one such account, or with a
    ``tid`` that does not exist, the insert is refused. It then uses up an id, unless they are to be ``gapless``;
    requests of one ``seq`` are then numbered by their transaction.
    """
    given = F.col("tid") if "tid" in requests.columns else F.lit(None).cast("long")
    lowest = ledger.transactions.agg(F.min("tid")).scalar()
    holder = ledger.accounts.filter(F.col("name") == IMBALANCE_ACCOUNT)
    holder = holder.agg(F.when(F.count(F.lit(1)) == 1, F.min("aid"))).scalar()
    batch = _Batch(_as_edits(requests.select("seq", F.coalesce(given, lowest).alias("target_id"))), keep)
    homes = batch.facts(ledger.transactions, "tid").withColumn("known", F.lit(True))
    judged = _judge(
        batch,
        join_facts(batch.edits, homes, "target_id").withColumn("aid", holder),
        (F.col("aid").isNull(), NO_ACCOUNT + IMBALANCE_ACCOUNT, True),
        (F.col("known").isNull(), "no transaction with this id", True),
    )
    accepted = _accepted(judged)
    if gapless:
        new = _numbered(ledger.splits, "sid", accepted, True, "target_id").withColumn("aid", holder)
    else:
        new = accepted.select("seq", _next_ids(ledger.splits, "sid", requests).alias("sid"), "target_id", "aid")
    rows = new.select(
        "seq",
        "sid",
        F.col("target_id").alias("tid"),
        "aid",
        F.lit(NEW_SPLIT_KIND).alias("kind"),
        F.lit(0).cast(MONEY).alias("amount"),
        F.lit(None).alias("memo"),
    )
    return _with_rows(ledger, "splits", _shaped(rows, SPLITS), _rejected(judged), _inserted(rows, "splits", "sid"))


# -- deletes ---------------------------------------------------------------------------


def _as_edits(requests: DataFrame) -> DataFrame:
    """Deletes come as ``(seq, target_id)``; give them the shape of edits."""
    return requests.select(
        "seq", "target_id", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")
    )


def _without(ledger: Ledger, rejects: DataFrame, **gone: tuple[str, DataFrame]) -> Staged:
    """The ledger without rows; per table the column to go by, and the values of it that go."""
    kept, keys = {}, {}
    for table, (column, ids) in gone.items():
        rows, key = getattr(ledger, table), KEYS[table]
        kept[table] = not_in_keys(rows, column, ids)
        keys[table] = ids if column == key else in_keys(rows, column, ids).select(key)
    return Staged(ledger.stage(**kept), rejects, gone=keys, base=ledger)


def _ids(requests: DataFrame, key: str, column: str = "target_id") -> DataFrame:
    return requests.select(F.col(column).alias(key))


def delete_transactions(ledger: Ledger, requests: DataFrame) -> Staged:
    """Delete transactions with all their splits; ids that do not exist are passed over."""
    ids = _ids(requests, "tid")
    return _without(ledger, _no_rejects(requests), transactions=("tid", ids), splits=("tid", ids))


def delete_splits(ledger: Ledger, requests: DataFrame) -> Staged:
    """Delete splits; ids that do not exist are passed over."""
    return _without(ledger, _no_rejects(requests), splits=("sid", _ids(requests, "sid")))


def delete_accounts(ledger: Ledger, requests: DataFrame, keep: Keep = _as_plan) -> Staged:
    """Delete accounts, refusing those that splits still refer to."""
    # Down to one row per account before the join, however many splits it has.
    owners = ledger.splits.select("aid").distinct()
    batch = _Batch(_as_edits(requests), keep)
    in_use = owners.select(F.col("aid").alias("target_id"), F.lit(True).alias("used"))
    judged = _judge(
        batch,
        join_facts(batch.edits, in_use, "target_id"),
        (F.col("used"), "account is still referenced from splits", True),
    )
    return _without(ledger, _rejected(judged), accounts=("aid", _ids(_accepted(judged), "aid")))


def delete_by_statement_row(ledger: Ledger, requests: DataFrame, keep: Keep = _as_plan) -> Staged:
    """Delete the whole transactions behind cash-statement rows, given by sid."""
    batch = _Batch(_as_edits(requests), keep)
    judged = _judge(
        batch,
        join_facts(batch.edits, batch.facts(ledger.splits, "sid", "tid"), "target_id"),
        (F.col("tid").isNull(), NO_STATEMENT_ROW, True),
    )
    ids = _ids(_accepted(judged), "tid", "tid")
    return _without(ledger, _rejected(judged), transactions=("tid", ids), splits=("tid", ids))


# -- changes that are always refused --------------------------------------------------


def refuse(ledger: Ledger, requests: DataFrame, reason: str) -> Staged:
    """Leave the ledger as it is and reject every request."""
    have = set(requests.columns)
    columns = [
        F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in EDITS
    ]
    rejects = requests.select(*columns, F.lit(reason).alias("reason"), F.lit(False).alias("fatal"))
    return Staged(ledger, rejects)


def insert_statement(ledger: Ledger, requests: DataFrame) -> Staged:
    return refuse(ledger, requests, NO_STATEMENT_INSERT)


def delete_statement(ledger: Ledger, requests: DataFrame) -> Staged:
    return refuse(ledger, requests, NO_STATEMENT_DELETE)
