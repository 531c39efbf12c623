"""Books on storage, bulk files, checks and exports."""

import threading
import zlib
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from micro_ledger import MICRO_ACCOUNTS, MICRO_SPLITS, MICRO_TRANSACTIONS, day, make_ledger, money, rows
from pyspark.sql import functions as F

from tallybook import Ledger
from tallybook.operators import checks
from tallybook.operators.edits import delete_splits, update_splits, update_transactions
from tallybook.plans import reports
from tallybook.plans.views import VIEWS, project_view
from tallybook.sources import book as B
from tallybook.sources import export
from tallybook.sources.store import put_new


@pytest.fixture()
def balanced(spark, micro):
    return delete_splits(micro, spark.createDataFrame([(1, 81)], "seq long, target_id long")).ledger


def content(ledger, name):
    return sorted(map(tuple, getattr(ledger, name).collect()), key=str)


def test_publish_and_read_back(spark, balanced, tmp_path):
    root = str(tmp_path / "books")
    B.publish(balanced, root)
    back = B.read_book(spark, root)
    for name in ("accounts", "transactions", "splits"):
        assert content(back, name) == content(balanced, name)
    direct = reports.account_statement(balanced, [2])
    stored = reports.account_statement(back, [2])
    assert stored.collect() == direct.collect()
    assert reports.cash_statement(back).collect() == reports.cash_statement(balanced).collect()


def test_unbalanced_book_is_refused_and_leaves_the_old_version(spark, micro, balanced, tmp_path):
    root = str(tmp_path / "books")
    with pytest.raises(checks.Refused, match="Imbalances will prevent commit"):
        B.publish(micro, root)
    with pytest.raises(ValueError):
        B.read_book(spark, root)
    B.publish(balanced, root, journal=False)
    with pytest.raises(checks.Refused):
        B.publish(micro, root)
    assert content(B.read_book(spark, root), "splits") == content(balanced, "splits")
    assert B.read_book(spark, root).journal is None


def test_versions_and_years(spark, balanced, tmp_path):
    root = str(tmp_path / "books")
    B.publish(balanced, root)
    first = B.read_book(spark, root)
    edit = spark.createDataFrame([(1, 11, "memo", "later")], "seq long, target_id long, field string, value string")
    B.publish(update_splits(first, edit), root)
    assert rows(B.read_book(spark, root).splits.filter("sid = 11"), "memo") == [("later",)]
    assert rows(B.read_book(spark, root, version=1).splits.filter("sid = 11"), "memo") == [("first",)]
    B.publish(balanced, root, year="2018")
    assert B.published_versions(spark, root, "2018").count() == 1
    with pytest.raises(ValueError):
        B.read_book(spark, root, "2019")


def test_fatal_rejects_block_publishing(spark, balanced, tmp_path):
    edits = spark.createDataFrame([(1, 999, "memo", "x")], "seq long, target_id long, field string, value string")
    staged = update_splits(balanced, edits)
    with pytest.raises(checks.Refused, match="Unexpected query result"):
        B.publish(staged, str(tmp_path / "books"))


def test_shared_folder_is_the_session_s(spark):
    assert B.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_without_a_named_folder_nothing_is_written():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="local[2]")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError):
        B.shared_folder(session)


def test_broken_keys_are_refused(spark, micro, balanced, tmp_path):
    root = str(tmp_path / "books")
    twice = balanced.stage(transactions=balanced.transactions.union(balanced.transactions.filter("tid = 1")))
    with pytest.raises(checks.Refused, match="repeated key"):
        B.publish(twice, root)
    nowhere = balanced.stage(transactions=balanced.transactions.filter("tid <> 1"))
    with pytest.raises(checks.Refused, match="no such row"):
        B.publish(nowhere, root)
    with pytest.raises(ValueError):
        B.read_book(spark, root)


def edited(ledger, memo):
    batch = ledger.splits.select(F.col("sid").alias("seq"), F.col("sid").alias("target_id"), F.lit("memo").alias("field"), F.lit(memo).alias("value"))
    return update_splits(ledger, batch)


def folders(tmp_path):
    return [p for p in tmp_path.glob("books/book_year=2017/attempt-*/splits/*.parquet")]


def test_a_stale_ledger_is_refused(spark, balanced, tmp_path):
    root = str(tmp_path / "books")
    first = B.publish(balanced, root, journal=False)
    assert (first.version.number, B.read_book(spark, root).version) == (1, first.version)
    mine, theirs = edited(B.read_book(spark, root), "mine"), edited(B.read_book(spark, root), "theirs")
    second = B.publish(theirs, root, journal=False)
    kept = len(folders(tmp_path))
    with pytest.raises(checks.Conflict, match="Made from version 1, but version 2"):
        B.publish(mine, root, journal=False)
    with pytest.raises(checks.Conflict, match="not read from the book"):
        B.publish(balanced, root, journal=False)
    assert len(folders(tmp_path)) == kept
    assert content(B.read_book(spark, root), "splits") == content(second, "splits")
    # an older version may be published anew when that is said
    again = B.publish(first, root, journal=False, overwrite=True)
    assert again.version.number == 3 and content(B.read_book(spark, root), "splits") == content(balanced, "splits")
    assert [tuple(r) for r in B.published_versions(spark, root).select("version", "base").orderBy("version").collect()] == [(1, 0), (2, 1), (3, 2)]


def test_of_publishers_at_once_one_succeeds(spark, balanced, tmp_path):
    """All start from one version and pass the first check; the number goes to one of them."""
    root = str(tmp_path / "books")
    B.publish(balanced, root, journal=False)
    start = threading.Barrier(3)

    def run(name):
        staged = edited(B.read_book(spark, root), name)
        start.wait()
        try:
            return B.publish(staged, root, journal=False)
        except checks.Conflict as error:
            return error

    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(run, ["one", "two", "three"]))
    done = [f for f in found if not isinstance(f, checks.Conflict)]
    assert len(done) == 1 and done[0].version.number == 2
    assert content(B.read_book(spark, root), "splits") == content(done[0], "splits")
    assert len(list(tmp_path.glob("books/*/attempt-*"))) == 2  # the others left nothing


def test_changes_are_applied_again_after_a_conflict(spark, balanced, tmp_path):
    root = str(tmp_path / "books")
    B.publish(balanced, root, journal=False)
    seen = []

    def change(ledger):
        seen.append(ledger.version.number)
        if len(seen) == 1:  # somebody else is faster
            batch = spark.createDataFrame([(1, 2, "description", "theirs")], "seq long, target_id long, field string, value string")
            B.publish(update_transactions(ledger, batch), root, journal=False)
        return edited(ledger, "mine")

    done = B.publish_changes(spark, root, change, journal=False)
    assert seen == [1, 2] and done.version.number == 3
    assert rows(done.splits, "memo") == [("mine",)] * 15
    assert rows(done.transactions.filter("tid = 2"), "description") == [("theirs",)]
    seen.clear()
    with pytest.raises(checks.Conflict):
        B.publish_changes(spark, root, change, attempts=1, journal=False)


def test_a_file_is_created_once(spark, tmp_path):
    path = str(tmp_path / "versions" / "7.json")
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: put_new(spark, path, f"text {i}"), range(24)))
    assert sum(made) == 1
    assert open(path).read() == f"text {made.index(True)}"
    assert [p.name for p in tmp_path.glob("versions/*")] == ["7.json"]


def stored_bytes(folder):
    return sum(p.stat().st_size for name in ("journal", "counters") for p in (folder / name).glob("*.parquet"))


def test_names_are_stored_once_a_side(spark, tmp_path):
    """One transaction of n debits and m credited accounts: bytes grow as n + m, not as n times m."""
    sizes = {}
    for n, m in ((200, 200), (200, 1600), (1600, 200), (1600, 1600)):
        names = [(1, "asset", "Purse", None)] + [(2 + i, "income", f"{zlib.crc32(b'%d' % i):08x}", None) for i in range(m)]
        splits = [(i, 1, 1, "debit", "1.00", None) for i in range(n)]
        splits += [(n + i, 1, 2 + i, "credit", "1.00", None) for i in range(m)]
        folder = tmp_path / f"{n}-{m}"
        ledger = make_ledger(spark, names, [(1, "2017-01-01", "Large")], splits)
        B.write_journal(ledger, str(folder))
        sizes[n, m] = stored_bytes(folder)
    base = sizes[200, 200]
    assert sizes[1600, 1600] - base < 1.5 * (sizes[1600, 200] - base + sizes[200, 1600] - base)
    assert sizes[1600, 1600] < 1600 * 64  # a name is 8 letters; 1,600 lists of 1,600 names would be 23 MB


def ranges_of(folder, column):
    """(least, greatest) of a column in each file, by the files' own statistics."""
    out = []
    for path in sorted(folder.glob("*.parquet")):
        meta = pq.ParquetFile(path).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        out.append((min(s.min for s in stats), max(s.max for s in stats)))
    return out


def test_dates_and_accounts_both_skip_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "FILE_BYTES", 1500)
    names = [(i, "asset", f"Account {i}", None) for i in range(1, 121)]
    days = [(i, f"20{10 + i // 360:02d}-{1 + i // 30 % 12:02d}-{1 + i % 28:02d}", "d") for i in range(3600)]
    # account 7 has a third of all splits
    splits = [(2 * i + k, i, 7 if (i + k) % 3 == 0 else 1 + (i * 37 + k * 11) % 120, kind, "1.00", None) for i in range(3600) for k, kind in enumerate(("debit", "credit"))]
    ledger = make_ledger(spark, names, days, splits)
    B.write_journal(ledger, str(tmp_path))
    dates, aids = (ranges_of(tmp_path / "journal", c) for c in ("date", "aid"))
    assert len(dates) >= 30
    month = [low <= day("2014-06-30") and high >= day("2014-06-01") for low, high in dates]
    account = [low <= 90 <= high for low, high in aids]
    assert sum(month) < 0.4 * len(dates) and sum(account) < 0.4 * len(aids)
    assert sum(a and b for a, b in zip(month, account, strict=True)) < 0.15 * len(dates)
    stored = B.read_journal(ledger, str(tmp_path))
    assert stored.journal.count() == len(splits)
    got = reports.account_statement(stored, [90], "2014-06-01", "2014-07-01")
    assert got.collect() == reports.account_statement(ledger, [90], "2014-06-01", "2014-07-01").collect()


def test_nothing_but_the_tables_is_left(spark, balanced, tmp_path):
    B.publish(balanced, str(tmp_path / "books"))
    (made,) = tmp_path.glob("books/*/attempt-*")
    assert not list(made.glob("unsorted/*"))


def test_a_table_that_a_batch_leaves_is_not_written_again(spark, balanced, tmp_path):
    root = str(tmp_path / "books")
    first = B.publish(balanced, root, journal=False)
    second = B.publish(edited(first, "a"), root, journal=False)
    third = B.publish(edited(second, "b"), root)
    made = [[p.name for p in sorted(f.iterdir()) if p.name in B.TABLES] for f in tmp_path.glob("books/book_year=2017/attempt-*")]
    assert sorted(made) == [["accounts", "splits", "transactions"], ["splits"], ["splits"]]
    for version, ledger in enumerate((first, second, third), 1):
        again = B.read_book(spark, root, version=version)
        for name in B.TABLES:
            assert content(again, name) == content(ledger, name)
    assert content(third, "transactions") == content(first, "transactions") != []


def test_a_task_sorts_so_many_rows_for_a_file_at_most(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "FILE_ROWS", 100, raising=False)
    rows = spark.range(1000).select(F.col("id").alias("tid"), F.lit(1).alias("n"))
    B._write_ranges(rows, str(tmp_path), "rows", ("tid",), ("tid",))
    assert len(list((tmp_path / "rows").glob("*.parquet"))) >= 8
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1000


def test_validate_schema(spark, micro):
    assert checks.validate_schema(micro).count() == 0
    accounts = spark.createDataFrame(
        [(1, "cash", "A", None), (2, None, None, None)], "aid long, kind string, name string, description string"
    )
    splits = micro.splits.withColumn("amount", micro.splits.amount.cast("double")).drop("memo")
    found = checks.validate_schema(Ledger(accounts, micro.transactions, splits)).collect()
    assert {tuple(r) for r in found} == {
        ("accounts", 1, "kind", "not in domain", "cash"),
        ("accounts", 2, "kind", "unexpected null", None),
        ("accounts", 2, "name", "unexpected null", None),
        ("splits", None, "amount", "incompatible type", "double"),
        ("splits", None, "memo", "missing column", None),
    }


def test_validate_keys(spark, micro):
    assert checks.validate_keys(micro).count() == 0
    broken = make_ledger(
        spark,
        [*MICRO_ACCOUNTS, (8, "asset", "Twin", None)],
        MICRO_TRANSACTIONS,
        [*MICRO_SPLITS, (100, 77, 55, "debit", "1.00", None)],
    )
    assert {tuple(r) for r in checks.validate_keys(broken).collect()} == {
        ("accounts", 8, "aid", "repeated key", "2"),
        ("splits", 100, "aid", "no such row", "55"),
        ("splits", 100, "tid", "no such row", "77"),
    }


def test_bulk_load(spark, balanced, tmp_path):
    files = {}
    for name in ("accounts", "transactions", "splits"):
        files[name] = str(tmp_path / name)
        getattr(balanced, name).write.option("header", True).csv(files[name])
    ledger, violations = B.bulk_load(spark, files)
    assert violations.count() == 0
    for name in ("accounts", "transactions", "splits"):
        assert content(ledger, name) == content(balanced, name)
    assert B.publish(ledger, str(tmp_path / "books")).splits.count() == 15


def test_bulk_load_reports_bad_lines(spark, tmp_path):
    files = {}
    for name, lines in {
        "accounts": ["aid,kind,name,description", "1,asset,A,", "2,cash,B,", "x,asset,C,"],
        "transactions": ["tid,date,description", "1,2017-01-01,ok", "2,2017-99-01,bad"],
        "splits": ["sid,tid,aid,kind,amount,memo", "1,1,1,debit,1.00,", "2,1,1,credit,one,"],
    }.items():
        path = tmp_path / f"{name}.csv"
        path.write_text("\n".join(lines) + "\n")
        files[name] = str(path)
    ledger, violations = B.bulk_load(spark, files)
    assert {(r.table_name, r.problem, r.found) for r in violations.collect()} == {
        ("accounts", "not in domain", "cash"),
        ("accounts", "unreadable value", "x"),
        ("transactions", "unreadable value", "2017-99-01"),
        ("splits", "unreadable value", "one"),
    }
    assert [t.count() for t in (ledger.accounts, ledger.transactions, ledger.splits)] == [2, 1, 1]


def load(spark, tmp_path, **texts):
    """Bulk load of one line per table, with some of the files replaced."""
    lines = {
        "accounts": "aid,kind,name,description\n1,asset,A,\n",
        "transactions": "tid,date,description\n1,2017-01-01,ok\n",
        "splits": "sid,tid,aid,kind,amount,memo\n1,1,1,debit,1.00,\n",
    }
    files = {}
    for name, text in (lines | texts).items():
        files[name] = str(tmp_path / f"{name}.csv")
        (tmp_path / f"{name}.csv").write_text(text)
    return B.bulk_load(spark, files)


def test_bulk_load_goes_by_column_names(spark, tmp_path):
    ledger, violations = load(spark, tmp_path, accounts="name,aid,description,kind\nA,7,x,asset\n")
    assert violations.count() == 0 and content(ledger, "accounts") == [(7, "asset", "A", "x")]
    for header in ("aid,kind,name", "aid,kind,name,description,more", "aid,kind,name,about", "aid,kind,name,name"):
        with pytest.raises(ValueError):
            load(spark, tmp_path, accounts=f"{header}\n")


def test_bulk_load_loses_nothing(spark, tmp_path):
    ledger, violations = load(
        spark,
        tmp_path,
        transactions='tid,date,description\n1,2017-01-01,"two\nlines, ""quoted"""\n2,2017-01-02,x,surplus\n3,2017-01-03\n',
        splits="sid,tid,aid,kind,amount,memo\n1,1,1,debit,5.005,\n2,1,1,debit,5.1000,\n3,1,1,debit,5e-3,\n4,1,1,debit,1e2,\n",
    )
    assert content(ledger, "transactions") == [(1, day("2017-01-01"), 'two\nlines, "quoted"')]
    assert rows(ledger.splits.orderBy("sid"), "sid", "amount") == [(2, money("5.10")), (4, money("100.00"))]
    assert sorted((r.table_name, r.problem, str(r.found).strip()) for r in violations.collect()) == [
        ("splits", "too many decimals", "5.005"),
        ("splits", "too many decimals", "5e-3"),
        ("transactions", "wrong number of fields", "2,2017-01-02,x,surplus"),
        ("transactions", "wrong number of fields", "3,2017-01-03"),
    ]


def test_append(spark, micro):
    more = make_ledger(spark, [(9, "asset", "New", None)], [(10, "2017-05-01", "more")], [(101, 10, 9, "debit", "1.00", None)])
    both = B.append(micro, more)
    assert (both.accounts.count(), both.transactions.count(), both.splits.count()) == (9, 10, 17)


def test_project_view(micro):
    shown = project_view(VIEWS["account_statement"].select(micro, [2]), "account_statement")
    assert shown.columns == ["date", "description", "account", "counter", "amount", "balance", "debits", "credits"]
    assert shown.first().credits == "    30.00"
    splits = project_view(VIEWS["scoped_splits"].select(micro, [5]), "scoped_splits")
    assert [tuple(r) for r in splits.collect()] == [
        (52, "credit", "Cash Wallet", "     5.00", "None"),
        (51, "debit", "Cash Jar", "     5.00", "moved"),
    ]
    assert project_view(VIEWS["accounts"].select(micro), "accounts").columns == ["aid", "kind", "name", "balance"]


def test_an_export_computes_its_report_once(spark, tmp_path):
    """Rows are counted as they are made; widths, order and an empty report are right."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    report = spark.range(0, 3000, numPartitions=7).mapInPandas(count, "id long").withColumn("name", F.repeat(F.lit("x"), F.pmod("id", F.lit(13)).cast("int")))
    export.export_report(report, str(tmp_path / "lines"), form="text")
    assert made.value == 3000
    lines = [line for part in sorted((tmp_path / "lines").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines == [f"{i:<4} | {'x' * (i % 13):<12}" for i in range(3000)]
    export.export_report(report.limit(0), str(tmp_path / "none"), form="text")
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_column_widths_and_lines(spark):
    report = spark.createDataFrame([(1, "x" * 60), (1000, None)], "id long, description string")
    assert export.column_widths(report).first().asDict() == {"id": 4, "description": 60}
    assert export.column_widths(report, 45).first().asDict() == {"id": 4, "description": 45}
    assert [r.line for r in export.text_lines(report).collect()][0] == "1    | " + "x" * 60
    lines = [r.line for r in export.text_lines(report, limit=45).collect()]
    assert lines == ["1    | " + "x" * 42 + "...", "1000 | " + "None".ljust(45)]
    assert export.header_line(report, limit=45) == "id   | " + "description".ljust(45)
    assert export.column_widths(report.limit(0)).first().asDict() == {"id": 2, "description": 11}


def test_export(spark, micro, tmp_path):
    report = project_view(reports.account_balances(micro), "accounts")
    export.export_report(report, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(str(tmp_path / "csv"))
    assert back.count() == 8
    export.export_report(report, str(tmp_path / "text"), form="text")
    assert "7   | income    | Salary      | -  150.00" in [r.value.rstrip() for r in spark.read.text(str(tmp_path / "text")).collect()]
    with pytest.raises(ValueError):
        export.export_report(report, str(tmp_path / "x"), form="pdf")
