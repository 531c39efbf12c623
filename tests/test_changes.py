"""Checks that look at what changed, against the checks of whole ledgers."""

import random
import zlib
from dataclasses import replace

import pytest
from micro_ledger import make_ledger, money, rows
from pyspark.sql import functions as F

from tallybook.ledger import Change
from tallybook.operators import checks, edits
from tallybook.operators.changes import change_imbalances, change_problems, merged, near_keys
from tallybook.operators.session import Session
from tallybook.sources import book
from tallybook.sources.schema import KEYS, TABLES

ACCOUNTS = [(a, "asset", f"A{a}", None) for a in range(1, 7)]
TRANSACTIONS = [(t, "2017-01-05", "") for t in range(1, 13)]
SPLITS = [(10 * t + i, t, 1 + (t + i) % 6, ("debit", "credit")[i % 2], str(t), None) for t in range(1, 12) for i in range(4)]


@pytest.fixture(scope="module")
def sound(spark, tmp_path_factory):
    return book.store_unchecked(make_ledger(spark, ACCOUNTS, TRANSACTIONS, SPLITS), str(tmp_path_factory.mktemp("sound")), journal=False)


def found(df):
    return sorted(map(str, map(tuple, df.collect())))


def change(spark, name, new, gone=()):
    return Change(spark.createDataFrame(list(new), TABLES[name]), spark.createDataFrame([(k,) for k in gone], f"{KEYS[name]} long"))


def random_changes(spark, seed):
    """Rows changed, added, repeated and pointing nowhere; keys deleted, some with what hangs on them."""
    r = random.Random(zlib.crc32(str(seed).encode()))
    pick = lambda some, n: r.sample(some, r.randint(0, n))
    splits = [(s, r.choice([t, 12, 13]), r.choice([a, 7]), r.choice([k, k, "due"]), money(r.choice([m, "3"])), x) for s, t, a, k, m, x in pick(SPLITS, 4)]
    splits += [(900 + i, r.randint(1, 13), r.randint(1, 6), "debit", money("0"), None) for i in range(r.randint(0, 2))]
    splits += splits[:1] * r.randint(0, 1)
    lost = [t for t, *_ in pick(TRANSACTIONS, 2)]
    orphans = [s for s, t, *_ in SPLITS if t in lost[:1]]
    return {
        "accounts": change(spark, "accounts", [(a, "cash", n, x) for a, _, n, x in pick(ACCOUNTS, 1)], [a for a, *_ in pick(ACCOUNTS, 1)]),
        "transactions": change(spark, "transactions", [], lost),
        "splits": change(spark, "splits", splits, orphans),
    }


@pytest.mark.parametrize("seed", range(6))
def test_changes_are_judged_as_the_whole_ledger_is(spark, sound, seed):
    changes = random_changes(spark, seed)
    if seed == 5:
        changes = {"splits": changes["splits"]}
    after = merged(sound, changes)
    assert found(change_problems(sound, changes)) == found(checks.validate_schema(after).union(checks.validate_keys(after)))
    assert found(change_imbalances(sound, changes)) == found(checks.imbalances(after))


def test_a_key_deleted_and_taken_again(spark, sound):
    changes = {"accounts": change(spark, "accounts", [(1, "asset", "again", None)], [1, 2])}
    after = merged(sound, changes)
    assert found(change_problems(sound, changes)) == found(checks.validate_keys(after)) != []
    assert change_imbalances(sound, changes).isEmpty()


def test_no_change_is_no_problem(spark, sound):
    assert change_problems(sound, {}).isEmpty() and change_imbalances(sound, {}).isEmpty()
    assert merged(sound, {}) is sound


def published(spark, sound, tmp_path):
    book.publish(sound, str(tmp_path / "books"), journal=False)
    return book.read_book(spark, str(tmp_path / "books"))


def batch(spark, *changes):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(changes)], "seq long, target_id long, field string, value string")


def test_publishing_a_batch_checks_what_it_touched(spark, sound, tmp_path, monkeypatch):
    first = published(spark, sound, tmp_path)
    root = first.version.root
    for name in ("require_valid", "require_balanced"):
        monkeypatch.setattr(book, name, lambda ledger: pytest.fail("the whole ledger was checked"))
    with pytest.raises(checks.Refused, match="Imbalances"):
        book.publish(edits.update_splits(first, batch(spark, (11, "amount", "9"))), root)
    with pytest.raises(checks.Refused, match="splits.tid: no such row"):
        gone = Session(first).delete_transactions(spark.createDataFrame([(1, 3)], "seq long, target_id long")).staged
        book.publish(replace(gone, rows={**gone.rows, "splits": sound.splits.filter("sid = 31")}), root)
    done = book.publish(edits.update_splits(first, batch(spark, (11, "amount", "9"), (10, "amount", "9"), (12, "memo", "x"))), root)
    assert rows(done.splits.filter("tid = 1").orderBy("sid"), "sid", "amount", "memo") == [(10, money("9"), None), (11, money("9"), None), (12, money("1"), "x"), (13, money("1"), None)]
    assert done.splits.count() == len(SPLITS) and done.journal is not None
    session = Session(done).edit({"accounts": batch(spark, (2, "name", "Two"))}).delete_transactions(spark.createDataFrame([(1, 5)], "seq long, target_id long"))
    third = book.publish(session.staged, root, journal=False)
    assert (third.version.number, third.splits.count(), third.transactions.count()) == (3, len(SPLITS) - 4, 11)
    assert not list(tmp_path.glob("books/book_year=2017/*/changes"))


def test_a_ledger_staged_in_two_steps_is_checked_whole(spark, sound, tmp_path):
    """The second step's change set starts from a ledger that nobody checked."""
    first = published(spark, sound, tmp_path)
    off = edits.update_splits(first, batch(spark, (11, "amount", "9"))).ledger
    assert first.published and not off.published
    with pytest.raises(checks.Refused, match="Imbalances"):
        book.publish(edits.update_accounts(off, batch(spark, (2, "name", "Two"))), first.version.root)


def test_few_changes_read_few_files(spark, tmp_path):
    """The rows that a change set of one transaction takes from the splits come from its key range."""
    many = spark.range(0, 200_000).select(
        (F.col("id")).alias("sid"), (F.col("id") / 2).cast("long").alias("tid"), F.lit(1).cast("long").alias("aid"),
        F.when(F.col("id") % 2 == 0, "debit").otherwise("credit").alias("kind"), F.lit(1).cast("decimal(18,2)").alias("amount"), F.lit(None).cast("string").alias("memo"),
    )
    many.repartitionByRange(8, "tid").write.parquet(str(tmp_path / "splits"))
    read = spark.read.schema(TABLES["splits"]).parquet(str(tmp_path / "splits"))
    near = near_keys(read, "tid", spark.createDataFrame([(7,), (9,)], "tid long"))
    assert sorted(r.sid for r in near.collect()) == [14, 15, 18, 19]
    scans = scans_of(near._jdf.queryExecution().executedPlan())
    assert min(scan.metrics().apply("numOutputRows").value() for scan in scans) < 100_000


def scans_of(plan):
    """The scans of files in a plan that ran."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return scans_of(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return scans_of(plan.plan())
    if plan.getClass().getSimpleName() == "FileSourceScanExec":
        return [plan]
    children = plan.children()
    return [scan for i in range(children.size()) for scan in scans_of(children.apply(i))]
