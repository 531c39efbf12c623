"""What the plans must look like to hold at size."""

import contextlib

import pytest
from micro_ledger import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallybook.operators import counters, edits, scopes, skew
from tallybook.plans import reports
from tallybook.sources.synthetic import derived_ledger


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_AUTO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def book(spark):
    return entry.stored_ledger(spark, SMALL)


@pytest.fixture(scope="module")
def journaled(spark):
    return entry.stored_ledger(spark, SMALL, journal=True)


REPORTS = {
    "statement": lambda b: reports.account_statement(b),
    "statement of one": lambda b: reports.account_statement(b, [15]),
    "rows": lambda b: reports.account_statement_rows(b),
    "cash": lambda b: reports.cash_statement(b),
    "cash rows": lambda b: reports.cash_statement_rows(b),
    "opening": lambda b: reports.statement_opening(b, None, "1996-01-01", "1998-01-01"),
    "balances": lambda b: reports.account_balances(b),
}


@pytest.mark.parametrize("name", REPORTS)
def test_no_quadratic_join_and_no_python(spark, book, journaled, name):
    for ledger in (book, journaled):
        with settings(spark, **NO_AUTO_BROADCAST):
            text = plan(REPORTS[name](ledger))
        for word in ("NestedLoop", "Cartesian", "Python", "ArrowEval"):
            assert word not in text


def test_no_registered_query_has_a_quadratic_join(spark):
    """Joins without an equality: none, over all registered queries that only read."""
    for name, query in entry.ledger_queries().items():
        if name in ("publish_round_trip", "publish_conflict", "bulk_load", "bulk_load_violations", "export_report"):
            continue  # these run jobs of their own; their reads are covered above
        with settings(spark, **NO_AUTO_BROADCAST):
            text = plan(query(spark, SMALL))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_filters_and_columns_reach_the_scan(journaled, book):
    text = plan(reports.account_statement(journaled, [15], "1996-01-01", "1997-01-01"))
    assert "EqualTo(aid,15)" in text and "GreaterThanOrEqual(date,1996-01-01)" in text
    text = plan(reports.imbalances(book))
    assert "ReadSchema: struct<tid:bigint,kind:string,amount:decimal(18,2)>" in text


def test_journal_leaves_only_the_day_totals_to_join(spark, journaled):
    """With a stored journal a cash statement shuffles day totals, never splits (but for the sort)."""
    text = plan(reports.cash_statement(journaled, ordered=False))
    assert "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning") == 1  # totals per date


def test_stored_tables_match_the_rules(book, spark):
    assert (book.accounts.count(), book.transactions.count(), book.splits.count()) == (164, 2043, 6895)


TINY = {
    **NO_AUTO_BROADCAST,
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "4k",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.0",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "4k",
    "spark__sql__shuffle__partitions": "16",
}


def test_hot_transaction_is_split_by_adaptive_execution(spark, book):
    """Two thirds of the splits in one transaction: they meet its facts in several tasks."""
    with settings(spark, **TINY):
        hot = F.when(F.col("sid") % 3 > 0, F.lit(4)).otherwise(F.col("tid"))
        splits = book.splits.withColumn("tid", hot.cast("long")).repartition(8)
        for df in (counters.counter_splits(splits), counters.with_counter(splits, book.stage(splits=splits))):
            df.collect()
            assert "skew=true" in plan(df)


def test_hot_target_of_edits_is_split_by_adaptive_execution(spark, book):
    with settings(spark, **TINY):
        batch = book.splits.select(
            F.col("sid").alias("seq"), F.when(F.col("sid") % 3 > 0, F.lit(256)).otherwise(F.col("sid")).cast("long").alias("target_id"), F.lit("memo").alias("field"), F.lit("x").alias("value")
        )
        df = edits.update_splits(book, batch.repartition(8)).rejects
        df.collect()
        assert "skew=true" in plan(df)


def jobs_while(spark, build):
    """Jobs that run while a plan is built."""
    tracker, group = spark.sparkContext.statusTracker(), "building"
    spark.sparkContext.setJobGroup(group, group)
    before = set(tracker.getJobIdsForGroup(group))
    build()
    return len(set(tracker.getJobIdsForGroup(group)) - before)


def test_building_a_batch_reads_nothing(spark, book):
    batches = {"splits": entry.split_edits(book), "statement": entry.statement_edits(book)}
    assert jobs_while(spark, lambda: edits.apply_edits(book, batches)) == 0
    assert jobs_while(spark, lambda: reports.account_statement(book, None, "1996-01-01", "1998-01-01")) == 0
    assert jobs_while(spark, lambda: reports.cash_statement(book, "Payment%", "1996-01-01", "1998-01-01")) == 0


def test_scoped_statements_collect_names_in_scope_only(spark, book):
    """The scope's transactions filter the splits below the list of names."""
    for df in (
        reports.account_statement(book, None, "1996-01-01", "1998-01-01", ordered=False),
        reports.cash_statement(book, "Payment%", "1996-01-01", "1998-01-01", ordered=False),
    ):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        names = text[text.index("collect_set") :]
        assert "Join LeftSemi" in names and "date" in names[names.index("Join LeftSemi") :]


def test_rows_of_a_frame_of_splits_need_few_scans(spark, book):
    chosen = book.splits.join(book.accounts.filter("name like 'Cash%'"), "aid", "left_semi")
    made = []
    jobs = jobs_while(spark, lambda: made.append(reports.account_statement_rows(book, chosen, "1996-01-01", "1998-01-01")))
    assert jobs <= 4
    assert plan(made[0]).count("Scan parquet") <= 24


def test_hot_account_is_split_by_adaptive_execution(spark, book):
    """A sales account holds over a tenth of all splits; its join partition is split."""
    with settings(spark, **TINY):
        spread = book.splits.repartition(8)
        df = reports.account_statement(book.stage(splits=spread))
        df.collect()
        assert "skew=true" in plan(df)


def test_zoom(book):
    chosen = book.splits.filter("aid = 15")
    near = scopes.zoom(book, chosen)
    assert near.splits.count() == book.splits.join(chosen.select("tid"), "tid", "left_semi").count() < book.splits.count()
    assert near.transactions.count() == chosen.select("tid").distinct().count()


def test_rows_without_a_key_pass_the_joins_by(spark):
    schema = "id long, name string, home long"
    rows = spark.createDataFrame([(1, "a", None), (2, None, 5), (3, None, None), (4, "z", None), (5, None, 6)], schema)
    named = spark.createDataFrame([("a", 10), ("b", 11)], "name string, aid int")
    homes = spark.createDataFrame([(5, True)], "home long, known boolean")
    with settings(spark, **NO_AUTO_BROADCAST):
        joined = skew.join_some_facts(rows, {"name": named, "home": homes})
        nodes, met = [joined._jdf.queryExecution().optimizedPlan()], []
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Join":
                met.append("isnotnull" in node.left().constraints().toString())
        assert met == [True, True]
        got = sorted(tuple(r) for r in joined.select("id", "name", "home", "aid", "known").collect())
    assert got == [
        (1, "a", None, 10, None), (2, None, 5, None, True), (3, None, None, None, None), (4, "z", None, None, None), (5, None, 6, None, None)
    ]


def test_only_naming_edits_are_looked_up_by_name(spark, book):
    judged = edits.update_splits(book, entry.split_edits(book)).rejects
    with settings(spark, **NO_AUTO_BROADCAST):
        text = judged._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Union") >= 1
    assert sorted(judged.groupBy("field").count().collect()) == sorted(
        edits.update_splits(book, scopes.stored_columns(entry.split_edits(book))).rejects.groupBy("field").count().collect()
    )


def test_last_texts_are_fetched_where_the_edits_lie(spark, book):
    """The last edits of a key are not laid out by their places to meet the texts, and back."""
    with settings(spark, **NO_AUTO_BROADCAST):
        splits = edits.update_splits(book, entry.split_edits(book)).ledger.splits
        moved = [line for line in plan(splits).splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "place" in line]


def test_accounts_in_use_are_looked_up_once(spark, micro):
    """Deleted accounts meet the accounts of splits directly, without finding those that are asked for first."""
    asked = micro.accounts.select(F.col("aid").alias("seq"), F.col("aid").alias("target_id"))
    with settings(spark, **NO_AUTO_BROADCAST):
        staged = edits.delete_accounts(micro, asked.unionByName(asked))
        assert "LeftSemi" not in plan(staged.rejects)
    assert sorted(r.target_id for r in staged.rejects.collect()) == [i for i in range(2, 8) for _ in range(2)]
    assert sorted(r.aid for r in staged.ledger.accounts.collect()) == list(range(2, 8))


def test_a_large_batch_meets_its_table_directly(spark, book):
    """Rows that a batch points at are not found first where that takes a shuffle of the batch and of the rows."""
    new = book.transactions.select(F.col("tid").alias("seq"), (F.col("tid") + 1).alias("tid"))
    with settings(spark, **NO_AUTO_BROADCAST):
        inserted = edits.insert_splits(book, new).rejects
        assert "LeftSemi" not in plan(inserted)
        assert plan(inserted).count("Exchange hashpartitioning") == 2


def test_a_small_batch_spares_its_table_the_shuffle(spark, book):
    lines = spark.createDataFrame([(1, 256, "memo", "x"), (2, 7, "memo", "y"), (3, None, "memo", "z")], "seq long, target_id long, field string, value string")
    lines = scopes.stored_columns(lines.coalesce(1))  # of known size
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="16k"):
        df = edits.update_splits(book, lines).rejects
        got = df.select("seq", "reason").collect()
        text = plan(df)
    assert "LeftSemi, BuildRight" in text  # the table is not shuffled to find them
    assert sorted(tuple(r) for r in got) == [(2, edits.NO_SPLIT), (3, edits.NO_SPLIT)]


def test_sums_of_orders_are_not_moved_by_customer(spark):
    """Orders meet their customer's region while they are narrow, and their sums by class last."""
    with settings(spark, **NO_AUTO_BROADCAST):
        text = plan(derived_ledger(spark, SMALL).splits)
    joins = [line for line in text.splitlines() if "SortMergeJoin" in line]
    assert "o_orderkey" in joins[0] and "o_custkey" in joins[1]


def test_a_large_batch_over_views_meets_each_table_once(spark, book):
    batches = {"accounts": entry.account_edits(book), "transactions": entry.transaction_edits(book), "splits": entry.split_edits(book)}
    with settings(spark, **NO_AUTO_BROADCAST):
        text = plan(edits.apply_edits(book, batches).rejects)
    assert text.count("LeftSemi") == 1  # the names that are looked up
