"""

The ledger behind the queries is derived from the order tables by rule
(``tallybook.sources.synthetic``). It is written once per session and input
folder to the shared folder the session names, and read from there.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle_queries  # noqa: E402
from tallybook import Ledger  # noqa: E402
from tallybook.functions import text  # noqa: E402
from tallybook.functions.money import credit_sum, debit_sum, money_text, signed_amount, signed_sum  # noqa: E402
from tallybook.ledger import Change  # noqa: E402
from tallybook.operators import changes, checks, counters, edits, joins, scopes  # noqa: E402
from tallybook.operators.asof import attach, running_totals  # noqa: E402
from tallybook.operators.journal import build_journal  # noqa: E402
from tallybook.operators.session import Session  # noqa: E402
from tallybook.plans import reports  # noqa: E402
from tallybook.plans.views import VIEWS, project_view  # noqa: E402
from tallybook.sources import book, export  # noqa: E402
from tallybook.sources.synthetic import derived_ledger  # noqa: E402

# The date range of the scoped queries, and "today" for new transactions.
START, END = oracle_queries.START, oracle_queries.END
TODAY = oracle_queries.TODAY
MID_YEAR = oracle_queries.MID_YEAR

_stored: dict[tuple, Ledger] = {}


def _folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder on the shared file system; a local session that names none gets one."""
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()) and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallybook-"))
    return f"{book.shared_folder(spark)}/tallybook/{purpose}-{uuid.uuid4().hex}"


def stored_ledger(spark: SparkSession, sf_dir: str, journal: bool = False) -> Ledger:
    """The derived ledger as written tables, with or without its journal."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if (*key, False) not in _stored:
        _stored[(*key, False)] = book.store_unchecked(
            derived_ledger(spark, sf_dir), _folder(spark, "ledger"), journal=False
        )
    if journal and (*key, True) not in _stored:
        plain = _stored[(*key, False)]
        folder = _folder(spark, "journal")
        book.write_journal(plain, folder)
        _stored[(*key, True)] = book.read_journal(plain, folder)
    return _stored[(*key, journal)]


def _comparable(df: DataFrame) -> DataFrame:
    """Money and dates as text, which reads the same in every engine."""
    return df.select(
        *[
            F.col(f.name).cast("string").alias(f.name)
            if isinstance(f.dataType, (T.DecimalType, T.DateType))
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _on_ledger(query: Callable[[Ledger], DataFrame], journal: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _comparable(query(stored_ledger(spark, sf_dir, journal)))

    return run


def _on_tables(query: Callable[[Callable[[str], DataFrame]], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _comparable(query(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")))

    return run


# -- batches of changes, one or more per row of the ledger ------------------------------


def _batch(rows: DataFrame, key: str, *changes) -> DataFrame:
    """Edits of every row: ``changes`` are (field, value); ``seq`` follows key, then place."""
    edit = F.array(
        *[
            F.struct(
                (F.col(key) * 8 + place).alias("seq"),
                F.col(key).alias("target_id"),
                F.lit(field).alias("field"),
                value.cast("string").alias("value"),
            )
            for place, (field, value) in enumerate(changes)
        ]
    )
    return rows.select(F.explode(edit).alias("e")).select("e.*")


def account_edits(ledger: Ledger) -> DataFrame:
    kind = F.when(F.col("kind") == "asset", "asset").when(F.col("kind") == "liability", "loan").otherwise("expense")
    about = F.when(F.col("name").like("Cash%"), "None").otherwise(F.col("name"))
    return _batch(
        ledger.accounts,
        "aid",
        ("name", F.concat("name", F.lit(" *"))),
        ("kind", kind),
        ("description", about),
        ("balance", F.lit("0")),
    )


def transaction_edits(ledger: Ledger) -> DataFrame:
    new_date = F.when(F.col("description").like("Sale%"), F.date_add("date", 1).cast("string")).otherwise("soon")
    return _batch(
        ledger.transactions,
        "tid",
        ("date", new_date),
        ("description", F.concat("description", F.lit("?"))),
        ("description", F.concat("description", F.lit("!"))),
        ("tid", F.lit("1")),
    )


def split_edits(ledger: Ledger) -> DataFrame:
    debit = F.col("kind") == "debit"
    return _batch(
        ledger.splits,
        "sid",
        ("amount", F.when(debit, (F.col("amount") + 1).cast("string")).otherwise("n/a")),
        ("memo", F.when(F.col("memo").isNull(), "checked").otherwise("None")),
        ("account", F.when(debit, "Nobody").otherwise("Dormant")),
        ("kind", F.when(debit, "c").otherwise("D")),
        ("tid", (F.col("tid") - F.pmod("tid", F.lit(4))).cast("string")),
        ("sid", F.lit("0")),
    )


def statement_edits(ledger: Ledger) -> DataFrame:
    return _batch(
        ledger.splits,
        "sid",
        ("amount", (F.col("amount") + 1).cast("string")),
        ("account", F.when(F.col("kind") == "debit", "Petty Cash").otherwise("Nobody")),
        ("counter", F.lit("Dormant")),
        ("date", F.when(F.col("kind") == "debit", "2000-02-29").otherwise("2001-02-29")),
        ("description", F.concat(F.lit("sid "), F.col("sid").cast("string"))),
        ("balance", F.lit("0")),
    )


def _targets(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("seq"), F.col(key).alias("target_id"))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("seq"))


def _cash_splits(ledger: Ledger) -> DataFrame:
    return joins.splits_with_account(ledger).filter(text.is_cash_account(F.col("account")))


# -- queries with more than one step ------------------------------------------------------


def _running(ledger: Ledger, measure: str) -> DataFrame:
    rows = reports.account_statement(ledger, ordered=False)
    return rows.select("sid", "account", "date", measure)


def _asof_account(ledger: Ledger) -> DataFrame:
    moves = joins.dated_splits(ledger)
    return running_totals(moves, {"balance": signed_amount()}, by=("aid",))


def _asof_probe(ledger: Ledger) -> DataFrame:
    """Each account on each date of its splits, counting only splits of the scope."""
    moves = joins.dated_splits(ledger)
    scoped = moves.filter(scopes.in_dates(START, END))
    totals = running_totals(scoped, {"balance": signed_amount()}, by=("aid",), probes=moves)
    return attach(moves.select("sid", "aid", "date"), totals, by=("aid",))


def _raw_accounts(table) -> DataFrame:
    """Account lines as an outside source might send them: odd kinds, missing names."""
    return table("customer").select(
        F.col("c_custkey").cast("long").alias("aid"),
        F.when(F.col("c_acctbal") < 0, "liability").when(F.col("c_nationkey") != 3, F.lower("c_mktsegment")).alias("kind"),
        F.when(F.col("c_nationkey") != 7, F.col("c_name")).alias("name"),
        F.lit(None).cast("string").alias("description"),
    )


def _publish_round_trip(ledger: Ledger) -> DataFrame:
    """Drop what is out of balance, publish, and report from the published book."""
    spark = ledger.splits.sparkSession
    off = reports.imbalances(ledger).withColumn("seq", F.col("tid")).withColumnRenamed("tid", "target_id")
    staged = edits.delete_transactions(ledger, off)
    root = _folder(spark, "books")
    book.publish(staged, root)
    return reports.account_balances(book.read_book(spark, root))


def _bulk_load(ledger: Ledger) -> DataFrame:
    """The ledger through CSV files, with their columns in another order, and back."""
    spark = ledger.splits.sparkSession
    folder = _folder(spark, "bulk")
    files = {name: f"{folder}/{name}" for name in ("accounts", "transactions", "splits")}
    for name, path in files.items():
        table = getattr(ledger, name)
        table.select(*reversed(table.columns)).write.option("header", True).csv(path)
    loaded, _ = book.bulk_load(spark, files)
    return joins.enrich_splits(loaded)


def _bulk_load_violations(ledger: Ledger) -> DataFrame:
    """Files with surplus fields, line breaks inside quotes and amounts of three decimals."""
    spark = ledger.splits.sparkSession
    folder = _folder(spark, "bulk")
    paths = {name: f"{folder}/{name}" for name in ("accounts", "whole", "surplus", "splits")}
    ledger.accounts.write.csv(paths["accounts"])
    broken = F.concat("description", F.lit("\nsecond line"))
    ledger.transactions.filter("tid % 5 <> 0").withColumn("description", broken).write.csv(paths["whole"])
    ledger.transactions.filter("tid % 5 = 0").withColumn("more", F.lit("extra")).write.csv(paths["surplus"])
    longer = F.when(F.col("sid") % 3 == 0, F.concat(F.col("amount").cast("string"), F.lit("5"))).otherwise(F.col("amount"))
    ledger.splits.withColumn("amount", longer).write.csv(paths["splits"])
    files = {"accounts": paths["accounts"], "transactions": [paths["whole"], paths["surplus"]], "splits": paths["splits"]}
    loaded, violations = book.bulk_load(spark, files, header=False)
    kept = loaded.transactions.filter(F.col("description").endswith("\nsecond line")).select(
        F.lit("transactions").alias("table_name"),
        F.col("tid").alias("key"),
        F.lit("description").alias("column_name"),
        F.lit("loaded whole").alias("problem"),
        "description",
    )
    return violations.union(kept)


def _insert_returned(ledger: Ledger) -> DataFrame:
    """Which row came of which request, for inserts into each table."""
    done = (
        edits.insert_accounts(ledger, _numbered(ledger.transactions, "tid")),
        edits.insert_transactions(ledger, _numbered(ledger.accounts, "aid"), TODAY),
        edits.insert_splits(ledger, ledger.transactions.select(F.col("tid").alias("seq"), (F.col("tid") + 1).alias("tid"))),
    )
    return done[0].inserted.union(done[1].inserted).union(done[2].inserted)


def _insert_gapless(ledger: Ledger) -> DataFrame:
    """Ids without gaps for requests whose ``seq`` is negative, far apart, or repeated many times."""
    far = ledger.transactions.select((F.col("tid") * 4_000_000_007 - 1_000_000_000_000).alias("seq"))
    done = (
        edits.insert_accounts(ledger, ledger.splits.select((F.col("aid") * 1_000_003).alias("seq")), gapless=True),
        edits.insert_transactions(ledger, far, TODAY, gapless=True),
        edits.insert_splits(ledger, ledger.splits.select(F.col("aid").alias("seq"), (F.col("tid") + 1).alias("tid")), gapless=True),
    )
    return done[0].inserted.union(done[1].inserted).union(done[2].inserted)


def _batch_rejects(ledger: Ledger) -> DataFrame:
    """Fatal and plain rejects of one batch over three views."""
    batch = {"accounts": account_edits(ledger), "transactions": transaction_edits(ledger), "splits": split_edits(ledger)}
    return edits.apply_edits(ledger, batch).rejects


def _publish_conflict(ledger: Ledger) -> DataFrame:
    """Two sessions edit version 1; the slower one is refused, and applies its edits to version 2."""
    spark = ledger.splits.sparkSession
    root = _folder(spark, "books")
    off = reports.imbalances(ledger).withColumn("seq", F.col("tid")).withColumnRenamed("tid", "target_id")
    book.publish(edits.delete_transactions(ledger, off), root, journal=False)
    seen = book.read_book(spark, root)

    def described(newest: Ledger):
        return edits.update_accounts(newest, _batch(newest.accounts, "aid", ("description", F.col("kind"))))

    book.publish(edits.update_accounts(seen, _batch(seen.accounts, "aid", ("name", F.concat("name", F.lit(" *"))))), root, journal=False)
    refused = None
    try:
        book.publish(described(seen), root, journal=False)
    except checks.Conflict as error:
        refused = str(error)
    done = book.publish_changes(spark, root, described, journal=False)
    return done.accounts.withColumns({"version": F.lit(done.version.number).cast("long"), "refused": F.lit(refused)})


def _export(ledger: Ledger) -> DataFrame:
    """The accounts view written as text lines and read again."""
    spark = ledger.splits.sparkSession
    path = f"{_folder(spark, 'export')}/accounts"
    export.export_report(project_view(reports.account_balances(ledger), "accounts"), path, form="text")
    return spark.read.text(path).withColumnRenamed("value", "line")


def _preview(ledger: Ledger) -> DataFrame:
    """Balances before and after a staged batch, side by side."""
    staged = edits.update_splits(ledger, split_edits(ledger)).ledger
    before = reports.account_balances(ledger, ordered=False).select("aid", F.col("balance").alias("before"))
    after = reports.account_balances(staged, ordered=False).select("aid", F.col("balance").alias("after"))
    return before.join(after, "aid")


def _session(ledger: Ledger) -> Session:
    """A session on the ledger; its steps are written to the shared folder."""
    _folder(ledger.splits.sparkSession, "session")
    return Session(ledger)


def _reselect(ledger: Ledger) -> DataFrame:
    """Statement rows of the edited debits, as they read on the staged ledger."""
    staged = _session(ledger).edit({"statement": statement_edits(ledger)}).ledger
    changed = ledger.splits.filter(F.col("kind") == "debit")
    return VIEWS["account_statement"].reselect(staged, changed, START, END)


def _reselect_cash(ledger: Ledger) -> DataFrame:
    """Cash-statement rows of the edited debits, as they read on the staged ledger."""
    staged = _session(ledger).edit({"statement": statement_edits(ledger)}).ledger
    changed = ledger.splits.filter(F.col("kind") == "debit")
    return VIEWS["cash_statement"].reselect(staged, changed, "%", START, END)


def _reselect_splits(ledger: Ledger, view: str, changed: DataFrame) -> DataFrame:
    """Edited splits, as the view shows them on the staged ledger."""
    staged = _session(ledger).edit({"splits": split_edits(ledger)}).ledger
    return VIEWS[view].reselect(staged, changed)


def _session_cells(ledger: Ledger) -> DataFrame:
    """What three steps changed, cell by cell: splits added to petty transactions, unbalanced ones deleted, accounts edited."""
    off = reports.imbalances(ledger).withColumn("seq", F.col("tid")).withColumnRenamed("tid", "target_id")
    petty = ledger.transactions.filter("description = 'Petty'").select(F.col("tid").alias("seq"), "tid")
    session = _session(ledger).insert_splits(petty).delete_transactions(off).edit({"accounts": account_edits(ledger)})
    return session.cells()


def _change_imbalances(ledger: Ledger) -> DataFrame:
    """What edits of splits leave off balance, looked for where a split was touched."""
    session = _session(ledger).edit({"splits": split_edits(ledger)})
    return changes.change_imbalances(ledger, session.changes)


def _change_problems(ledger: Ledger) -> DataFrame:
    """Splits moved to other account numbers, petty transactions and income accounts deleted: what points nowhere."""
    return changes.change_problems(
        ledger,
        {
            "accounts": Change(ledger.accounts.limit(0), ledger.accounts.filter("kind = 'income'").select("aid")),
            "transactions": Change(ledger.transactions.limit(0), ledger.transactions.filter("description = 'Petty'").select("tid")),
            "splits": Change(ledger.splits.filter("memo is null").withColumn("aid", F.col("aid") * 2), ledger.splits.limit(0).select("sid")),
        },
    )


def _both_updates(ledger: Ledger) -> DataFrame:
    """Split edits and statement edits in one batch; the later of each cell wins."""
    direct = split_edits(ledger).filter("field = 'amount'")
    wide = statement_edits(ledger).filter("field = 'amount'")
    return edits.apply_edits(ledger, {"splits": direct, "statement": wide}).ledger.splits


def _events_text(table) -> DataFrame:
    number = F.col("value").cast("decimal(18,2)").cast("string")
    return table("events").select(
        "event_id",
        F.when(F.col("event_type") == "click", F.col("props"))
        .when(F.col("event_type") == "error", F.regexp_extract("props", r"([0-9]+)", 1))
        .otherwise(number)
        .alias("value"),
    )


# -- contract ------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the statement of all accounts, on the smallest tables."""
    return _on_ledger(reports.account_statement)(spark, "/root/testdata/sf0.001")


def _training_data() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries of the training-data operators and their SQL; none where that subpackage is not there."""
    try:
        import corpus_pipeline
        from tallybook.llm import queries as operators
    except ModuleNotFoundError as e:
        if e.name not in ("corpus_pipeline", "tallybook.llm"):
            raise
        return {}, {}
    found = {**operators.QUERIES, "pipeline": corpus_pipeline.run}
    sql = dict(operators.ORACLE_SQL)
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return ledger_queries() | _training_data()[0]


def ledger_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on, tables = _on_ledger, _on_tables
    kept, refused = (lambda s: s.ledger), (lambda s: s.rejects)
    scope = {"start": START, "end": END}
    return {
        # tables and contracts
        "accounts": on(lambda L: L.accounts),
        "transactions": on(lambda L: L.transactions),
        "splits": on(lambda L: L.splits),
        "validate_schema": tables(lambda t: checks.validate_table("accounts", _raw_accounts(t))),
        "validate_keys": on(
            lambda L: checks.validate_keys(L.stage(accounts=L.accounts.unionByName(L.accounts.filter("kind <> 'asset'")),
                                                   transactions=L.transactions.filter("description <> 'Transfer'")))
        ),
        "bulk_load": on(_bulk_load),
        "bulk_load_violations": on(_bulk_load_violations),
        "publish_round_trip": on(_publish_round_trip),
        "publish_conflict": on(_publish_conflict),
        "export_report": on(_export),
        "column_widths": on(lambda L: export.column_widths(project_view(reports.split_list(L, ordered=False), "splits"), export.SCREEN_WIDTH)),
        # views
        **{
            f"view_{name}": on(
                lambda L, name=name: project_view(
                    VIEWS[name].select(L, L.transactions) if name == "scoped_splits" else VIEWS[name].select(L), name
                )
            )
            for name in VIEWS
        },
        # scopes and predicates
        "scope_account": on(lambda L: scopes.in_keys(L.splits, "aid", L.accounts.filter("kind = 'income'"))),
        "scope_transaction": on(lambda L: scopes.in_keys(L.splits, "tid", L.transactions.filter("description = 'Petty'"))),
        "scope_split": on(lambda L: scopes.in_keys(L.splits, "sid", L.splits.filter("memo is null"))),
        "scope_dates": on(lambda L: L.transactions.filter(scopes.in_dates(START, END))),
        "like_prefix": on(lambda L: L.accounts.filter(text.is_cash_account(F.col("name")))),
        "like_contains": on(lambda L: L.accounts.filter(text.mentions_cash(F.col("name")))),
        "like_param": on(lambda L: L.transactions.filter(text.like(F.col("description"), "%_-%G%"))),
        "not_internal_transfer": on(
            lambda L: build_journal(L)
            .filter(text.mentions_cash(F.col("account")))
            .filter(~(text.mentions_cash(F.col("account")) & F.coalesce(text.mentions_cash(F.col("counter")), F.lit(False))))
            .select("sid", "account", "counter")
        ),
        "master_detail": on(lambda L: scopes.detail_of(L.splits, reports.imbalances(L), "tid")),
        "parameter_binding": on(
            lambda L: L.sql(
                "SELECT tid, date, description FROM {transactions} WHERE date >= :start AND date < :end AND description LIKE :pattern",
                start=START, end=END, pattern="Payment%",
            )
        ),
        # joins
        "enrich_splits": on(joins.enrich_splits),
        "splits_with_account": on(joins.splits_with_account),
        "accounts_left_splits": on(joins.accounts_left_splits),
        "counter_splits": on(lambda L: counters.counter_splits(L.splits)),
        "counter_splits_inner": on(lambda L: counters.counter_splits(joins.dated_splits(L), required=True)),
        "asof_account": on(_asof_account),
        "asof_global": on(lambda L: running_totals(joins.dated_splits(L), {"balance": signed_amount(), "debits": F.when(F.col("kind") == "debit", F.col("amount")).otherwise(0)})),
        "asof_probe": on(_asof_probe),
        "semi_join": on(lambda L: joins.transactions_of(L, _cash_splits(L))),
        "scalar_subquery": on(
            lambda L: L.accounts.filter("name = 'Imbalance'").select(
                F.col("aid").alias("imbalance_aid"), L.transactions.agg(F.min("tid")).scalar().alias("lowest_tid")
            )
        ),
        # aggregates
        "signed_sum": on(lambda L: L.splits.groupBy("aid").agg(signed_sum().alias("s"))),
        "debit_sum": on(lambda L: L.splits.groupBy("aid").agg(debit_sum().alias("s"))),
        "credit_sum": on(lambda L: L.splits.groupBy("aid").agg(credit_sum().alias("s"))),
        "external_sums": on(lambda L: reports.external_sums(L)),
        "counter_list": on(
            lambda L: counters.with_counter(L.splits, L).select("sid", F.coalesce("counter", F.lit("")).alias("counter"))
        ),
        "counter_list_nullable": on(lambda L: counters.with_counter(L.splits, L).select("sid", "counter")),
        "account_sums": on(reports.account_sums),
        "imbalanced_transactions": on(reports.imbalances),
        "opposite_split_count": on(lambda L: counters.counter_splits(L.splits).select("sid", "opposite_count")),
        "min_tid": on(lambda L: L.transactions.agg(F.min("tid").alias("tid"))),
        # running totals
        "running_balance": on(lambda L: _running(L, "balance")),
        "running_debits": on(lambda L: _running(L, "debit_balance")),
        "running_credits": on(lambda L: _running(L, "credit_balance")),
        "running_cash": on(
            lambda L: reports.cash_statement(L, ordered=False).select("sid", "date", "balance", "debit_balance", "credit_balance")
        ),
        # scalar functions
        "money_text_5": on(lambda L: L.splits.select("sid", money_text(F.col("amount")).alias("shown"))),
        "money_text_6": on(
            lambda L: reports.account_sums(L).select("aid", money_text(F.col("balance"), 6).alias("shown"))
        ),
        "signed_amount": on(lambda L: L.splits.select("sid", signed_amount().alias("amount"))),
        "default_account_name": tables(
            lambda t: t("orders").select("o_orderkey", text.default_account_name(F.col("o_orderkey")).alias("name"))
        ),
        "null_label": on(lambda L: L.splits.select("sid", text.null_label(F.col("memo")).alias("memo"))),
        "label_to_null": on(
            lambda L: L.splits.select("sid", text.label_to_null(text.null_label(F.col("memo"))).alias("memo"))
        ),
        "clip_text": tables(lambda t: t("documents").select("doc_id", text.clip_text(F.col("text"), export.SCREEN_WIDTH).alias("clipped"))),
        "parse_split_kind": tables(
            lambda t: t("lineitem")
            .select(F.when(F.col("l_returnflag") == "A", "c").when(F.col("l_returnflag") == "N", "").otherwise(F.lower("l_linestatus")).alias("value"))
            .groupBy("value", text.parse_split_kind(F.col("value")).alias("kind"))
            .agg(F.count(F.lit(1)).alias("n"))
        ),
        "parse_amount": tables(lambda t: _events_text(t).select("event_id", text.parse_amount(F.col("value")).alias("amount"))),
        "parse_tid": tables(lambda t: _events_text(t).select("event_id", text.parse_tid(F.col("value")).alias("tid"))),
        # reports
        "account_balances": on(reports.account_balances),
        "account_balance": on(lambda L: reports.account_balances(L, L.accounts.filter("kind = 'asset'"))),
        "transaction_list": on(reports.transaction_list),
        "split_list": on(reports.split_list),
        "splits_of": on(lambda L: reports.split_list(L, tids=reports.imbalances(L))),
        "split": on(lambda L: reports.split_list(L, sids=_cash_splits(L))),
        "account_statement": on(reports.account_statement),
        "account_statement_scoped": on(lambda L: reports.account_statement(L, **scope)),
        "account_statement_of_accounts": on(
            lambda L: reports.account_statement(L, L.accounts.filter(text.mentions_cash(F.col("name"))), **scope)
        ),
        "account_statement_journal": on(reports.account_statement, journal=True),
        "account_statement_rows": on(lambda L: reports.account_statement_rows(L, None, **scope)),
        "account_statement_rows_of": on(lambda L: reports.account_statement_rows(L, _cash_splits(L), **scope)),
        "cash_statement": on(reports.cash_statement),
        "cash_statement_scoped": on(lambda L: reports.cash_statement(L, "Payment%", **scope)),
        "cash_statement_journal": on(reports.cash_statement, journal=True),
        "cash_statement_rows": on(lambda L: reports.cash_statement_rows(L, None, "%", **scope)),
        "statement_history": on(reports.statement_history),
        "statement_opening": on(lambda L: reports.statement_opening(L, None, **scope)),
        "statement_opening_journal": on(lambda L: reports.statement_opening(L, None, MID_YEAR, END), journal=True),
        "account_statement_rows_journal": on(lambda L: reports.account_statement_rows(L, _cash_splits(L)), journal=True),
        "checkpoints": on(lambda L: L.checkpoints.filter(F.col("month") == 0), journal=True),
        "imbalances": on(reports.imbalances),
        "journal": on(build_journal),
        # gate
        "commit_gate": on(checks.commit_gate),
        "staged_preview": on(_preview),
        # changes
        "lookup_account": on(lambda L: edits.lookup_account(L, reports.transaction_list(L, ordered=False).select(F.col("description").alias("name")).unionByName(L.accounts.select("name")))),
        "insert_accounts": on(lambda L: kept(edits.insert_accounts(L, _numbered(L.transactions, "tid"))).accounts),
        "insert_transactions": on(lambda L: kept(edits.insert_transactions(L, _numbered(L.accounts, "aid"), TODAY)).transactions),
        "insert_splits": on(lambda L: kept(edits.insert_splits(L, _numbered(L.accounts, "aid"))).splits),
        "insert_splits_of": on(
            lambda L: kept(edits.insert_splits(L, L.transactions.select(F.col("tid").alias("seq"), (F.col("tid") + 1).alias("tid")))).splits
        ),
        "insert_splits_of_rejects": on(
            lambda L: refused(edits.insert_splits(L, L.transactions.select(F.col("tid").alias("seq"), (F.col("tid") + 1).alias("tid"))))
        ),
        "update_accounts": on(lambda L: kept(edits.update_accounts(L, account_edits(L))).accounts),
        "update_accounts_rejects": on(lambda L: refused(edits.update_accounts(L, account_edits(L)))),
        "update_transactions": on(lambda L: kept(edits.update_transactions(L, transaction_edits(L))).transactions),
        "update_transactions_rejects": on(lambda L: refused(edits.update_transactions(L, transaction_edits(L)))),
        "update_splits": on(lambda L: kept(edits.update_splits(L, split_edits(L))).splits),
        "update_splits_rejects": on(lambda L: refused(edits.update_splits(L, split_edits(L)))),
        "update_statement": on(lambda L: kept(edits.update_statement(L, statement_edits(L))).splits),
        "update_statement_transactions": on(lambda L: kept(edits.update_statement(L, statement_edits(L))).transactions),
        "update_statement_rejects": on(lambda L: refused(edits.update_statement(L, statement_edits(L)))),
        "update_two_views": on(_both_updates),
        "delete_transactions": on(
            lambda L: kept(edits.delete_transactions(L, _targets(reports.imbalances(L), "tid"))).splits
        ),
        "delete_accounts": on(lambda L: kept(edits.delete_accounts(L, _targets(L.accounts, "aid"))).accounts),
        "delete_accounts_rejects": on(lambda L: refused(edits.delete_accounts(L, _targets(L.accounts, "aid")))),
        "delete_splits": on(lambda L: kept(edits.delete_splits(L, _targets(L.splits.filter("memo is null"), "sid"))).splits),
        "delete_by_statement_row": on(
            lambda L: kept(edits.delete_by_statement_row(L, _targets(_cash_splits(L), "sid"))).transactions
        ),
        "refused_insert": on(lambda L: refused(edits.insert_statement(L, _numbered(L.splits, "sid")))),
        "refused_delete": on(lambda L: refused(edits.delete_statement(L, _targets(L.splits, "sid")))),
        "reselect_changed": on(_reselect),
        "reselect_accounts": on(
            lambda L: VIEWS["accounts"].reselect(
                edits.update_accounts(L, account_edits(L)).ledger, L.accounts.filter("kind = 'income'")
            )
        ),
        "reselect_transactions": on(
            lambda L: VIEWS["transactions"].reselect(
                edits.update_transactions(L, transaction_edits(L)).ledger, L.transactions.filter("description = 'Transfer'")
            )
        ),
        "reselect_splits": on(
            lambda L: _reselect_splits(L, "splits", L.splits)
        ),
        "reselect_scoped_splits": on(lambda L: project_view(_reselect_splits(L, "scoped_splits", L.splits.filter("memo is null")), "scoped_splits")),
        "reselect_cash_statement": on(_reselect_cash),
        "session_cells": on(_session_cells),
        "insert_returned": on(_insert_returned),
        "insert_gapless": on(_insert_gapless),
        "batch_rejects": on(_batch_rejects),
        "change_imbalances": on(_change_imbalances),
        "change_problems": on(_change_problems),
    }


def oracle_sql() -> dict[str, str]:
    return oracle_queries.oracle_sql() | _training_data()[1]
