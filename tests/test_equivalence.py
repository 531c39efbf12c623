"""Reports against plain range-join SQL on random and on skewed small ledgers."""

import random

import duckdb
import pytest
from micro_ledger import make_ledger, rows

from tallybook.operators import counters, edits
from tallybook.operators.journal import with_journal
from tallybook.plans import reports

JOURNAL = """
CREATE VIEW journal AS SELECT s.*, t.date, t.description, a.name AS account, COALESCE((
    SELECT string_agg(DISTINCT a2.name, ',' ORDER BY a2.name) FROM splits s2 JOIN accounts a2 ON a2.aid = s2.aid
    WHERE s2.tid = s.tid AND s2.kind <> s.kind), '') AS counter
FROM splits s JOIN accounts a ON a.aid = s.aid JOIN transactions t ON t.tid = s.tid"""
SIGNED = "CASE WHEN b.kind = 'debit' THEN b.amount ELSE -b.amount END"


def side(kind, internal=""):
    return f"SUM(CASE WHEN b.kind = '{kind}' {internal} THEN b.amount ELSE 0 END)"


def range_join(detail, moves, on, internal=""):
    """Every detail row joined with every movement up to its date."""
    return f"""
    SELECT d.sid, d.date, d.account, d.counter, CASE WHEN d.kind = 'credit' THEN -d.amount ELSE d.amount END,
        COALESCE(SUM({SIGNED}), 0), COALESCE({side('debit', internal)}, 0), COALESCE({side('credit', internal)}, 0)
    FROM ({detail}) d LEFT JOIN ({moves}) b ON d.date >= b.date {on}
    GROUP BY d.sid, d.date, d.account, d.counter, d.kind, d.amount ORDER BY d.date DESC, d.amount DESC, d.sid DESC"""


COLUMNS = ("sid", "date", "account", "counter", "amount", "balance", "debit_balance", "credit_balance")
NOT_INTERNAL = "AND NOT (b.account LIKE '%Cash%' AND b.counter LIKE '%Cash%')"
ACCOUNTS = [
    (1, "asset", "Cash", None),
    (2, "asset", "Cash Box", None),
    (3, "asset", "Old Cash", None),
    (4, "income", "Sales", None),
    (5, "expense", "Rent, paid", None),
    (6, "asset", "Idle", None),
]


def random_ledger(seed, days=12, transactions=60):
    rng = random.Random(seed)
    heads, splits = [], []
    for tid in range(1, transactions + 1):
        heads.append((tid, f"2017-01-{rng.randint(1, days):02d}", rng.choice(["Sale", "Sale late", "Move"])))
        for _ in range(rng.randint(0, 5)):
            amount = f"{rng.randint(0, 3)}.{rng.choice(['00', '50'])}"
            splits.append((len(splits) + 1, tid, rng.randint(1, 5), rng.choice(["debit", "credit"]), amount, None))
    return heads, splits


def skewed_ledger(n=1500):
    """One transaction, one account and one day that each hold a third of the splits or more."""
    rng = random.Random(7)
    heads = [(tid, "2017-01-05" if tid % 3 == 0 else f"2017-01-{1 + tid % 28:02d}", "Sale") for tid in range(1, 201)]
    splits = []
    for sid in range(1, n + 1):
        tid = 1 if sid % 3 == 0 else rng.randint(2, 200)
        aid = 1 if sid % 3 == 1 else rng.randint(2, 5)
        splits.append((sid, tid, aid, "credit" if sid % 7 == 0 else "debit", f"{sid % 11}.25", None))
    return heads, splits


@pytest.fixture(scope="module", params=["random 1", "random 2", "skewed"])
def pair(request, spark):
    heads, splits = skewed_ledger() if request.param == "skewed" else random_ledger(int(request.param[-1]))
    db = duckdb.connect()
    db.execute("CREATE TABLE accounts (aid BIGINT, kind VARCHAR, name VARCHAR, description VARCHAR)")
    db.execute("CREATE TABLE transactions (tid BIGINT, date DATE, description VARCHAR)")
    db.execute("CREATE TABLE splits (sid BIGINT, tid BIGINT, aid BIGINT, kind VARCHAR, amount DECIMAL(18,2), memo VARCHAR)")
    db.executemany("INSERT INTO accounts VALUES (?, ?, ?, ?)", ACCOUNTS)
    db.executemany("INSERT INTO transactions VALUES (?, ?, ?)", heads)
    db.executemany("INSERT INTO splits VALUES (?, ?, ?, ?, ?, ?)", splits)
    db.execute(JOURNAL)
    return make_ledger(spark, ACCOUNTS, heads, splits), db


@pytest.fixture()
def shuffled(spark):
    """No side is sent along, as if all were large; hot partitions of any size are split."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def same(report, db, sql):
    assert rows(report, *COLUMNS) == [tuple(r) for r in db.execute(sql).fetchall()]


SCOPE = "date >= DATE '2017-01-03' AND date < DATE '2017-01-09'"
DATES = ("2017-01-03", "2017-01-09")


def test_account_statement(pair, shuffled):
    ledger, db = pair
    scoped = f"SELECT * FROM journal WHERE {SCOPE}"
    same(reports.account_statement(ledger, None, *DATES), db, range_join(scoped, scoped, "AND d.aid = b.aid"))
    mine = f"SELECT * FROM journal WHERE {SCOPE} AND aid IN (1, 5)"
    same(reports.account_statement(ledger, [1, 5], *DATES), db, range_join(mine, mine, "AND d.aid = b.aid"))
    assert reports.account_statement(ledger, [6]).count() == 0


def test_account_statement_rows(pair, shuffled):
    ledger, db = pair
    scoped = f"SELECT * FROM journal WHERE {SCOPE}"
    sql = range_join("SELECT * FROM journal", scoped, "AND d.aid = b.aid")
    same(reports.account_statement_rows(ledger, None, *DATES), db, sql)
    some = [1, 2, 3, 40]
    sql = range_join("SELECT * FROM journal WHERE sid IN (1, 2, 3, 40)", scoped, "AND d.aid = b.aid")
    same(reports.account_statement_rows(ledger, some, *DATES), db, sql)


@pytest.mark.parametrize("pattern", ["%", "Sale%", "%o%"])
def test_cash_statement(pair, shuffled, pattern):
    ledger, db = pair
    cash = f"SELECT * FROM journal WHERE {SCOPE} AND account LIKE 'Cash%' AND description LIKE '{pattern}'"
    same(reports.cash_statement(ledger, pattern, *DATES), db, range_join(cash, cash, "", NOT_INTERNAL))


def test_cash_statement_rows(pair, shuffled):
    ledger, db = pair
    cash = f"SELECT * FROM journal WHERE {SCOPE} AND account LIKE 'Cash%'"
    sql = range_join("SELECT * FROM journal", cash, "", NOT_INTERNAL)
    same(reports.cash_statement_rows(ledger, None, "%", *DATES), db, sql)


def test_stored_journal_gives_the_same_reports(pair):
    ledger, _ = pair
    stored = with_journal(ledger)
    for report in (reports.account_statement, reports.cash_statement, reports.statement_history):
        assert report(stored).collect() == report(ledger).collect()
    assert reports.external_sums(stored).collect() == reports.external_sums(ledger).collect()


def test_opening_balance(pair, shuffled):
    ledger, db = pair
    sql = range_join(f"SELECT * FROM journal WHERE {SCOPE}", "SELECT * FROM journal", "AND d.aid = b.aid")
    want = {r[0]: (r[3] or None, r[5]) for r in db.execute(sql).fetchall()}
    got = reports.statement_opening(ledger, None, *DATES)
    assert {r.sid: (r.counter, r.balance) for r in got.collect()} == want


def test_counter_splits(pair, shuffled):
    ledger, db = pair
    sql = """SELECT s.sid, COUNT(s2.sid), CASE WHEN COUNT(s2.sid) = 1 THEN MIN(s2.sid) END FROM splits s
        LEFT JOIN splits s2 ON s2.tid = s.tid AND s2.kind <> s.kind GROUP BY s.sid ORDER BY s.sid"""
    got = counters.counter_splits(ledger.splits).orderBy("sid")
    assert rows(got, "sid", "opposite_count", "opposite_sid") == db.execute(sql).fetchall()


def test_statement_amounts(pair, shuffled, spark):
    """Amount edits through the statement, on every split, however large its transaction."""
    ledger, db = pair
    batch = ledger.splits.selectExpr("sid AS seq", "sid AS target_id", "'amount' AS field", "CAST(sid AS STRING) AS value")
    after = edits.update_statement(ledger, batch).ledger.splits.orderBy("sid")
    sql = """WITH regular AS (SELECT s.sid, s.tid FROM splits s JOIN splits s2 ON s2.tid = s.tid AND s2.kind <> s.kind
            GROUP BY s.sid, s.tid HAVING COUNT(*) = 1)
        SELECT s.sid, COALESCE(CAST((SELECT MAX(r.sid) FROM regular r WHERE r.tid = s.tid) AS DECIMAL(18,2)), s.amount)
        FROM splits s ORDER BY s.sid"""
    assert rows(after, "sid", "amount") == db.execute(sql).fetchall()


def test_invariants(pair):
    ledger, _ = pair
    balances = reports.account_balances(ledger)
    total = balances.agg({"balance": "sum"}).first()[0]
    off = reports.imbalances(ledger).agg({"s": "sum"}).first()[0] or 0
    assert total == off
    statement = reports.account_statement(ledger)
    assert statement.filter("balance <> debit_balance - credit_balance").count() == 0
    newest = statement.groupBy("account").agg({"date": "max"}).withColumnRenamed("max(date)", "date")
    last = statement.join(newest, ["account", "date"]).select("account", "balance").distinct()
    named = {r.name: r.balance for r in balances.collect()}
    assert all(named[r.account] == r.balance for r in last.collect())
