"""SQL that recomputes every registered query on the same tables, for DuckDB.

The SQL goes its own way wherever it can: counter accounts come from a self join
of the splits, running totals from window functions over the detail rows.
"""

from __future__ import annotations

START, END = "1996-01-01", "1998-01-01"
#: A first day inside a month.
MID_YEAR = "1996-05-17"
TODAY = "2017-06-01"

LEDGER = """
accounts AS (
    SELECT CAST(1 AS BIGINT) AS aid, 'equity' AS kind, 'Imbalance' AS name, CAST(NULL AS VARCHAR) AS description
    UNION ALL SELECT 2, 'liability', 'Dormant', 'never used'
    UNION ALL SELECT 15, 'asset', 'Petty Cash', NULL
    UNION ALL SELECT 10 + r_regionkey, 'asset', 'Cash ' || r_name, NULL FROM region
    UNION ALL SELECT DISTINCT
        20 + 2 * CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
           + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END,
        'income', 'Sales ' || l_returnflag || l_linestatus, NULL
    FROM lineitem
    UNION ALL SELECT 1000 + c_custkey, 'asset', c_name, NULL FROM customer
),
transactions AS (
    SELECT 4 * o_orderkey AS tid, CAST(o_orderdate AS DATE) AS date, 'Sale ' || o_orderpriority AS description FROM orders
    UNION ALL SELECT 4 * o_orderkey + 1, CAST(o_orderdate AS DATE) + 30, 'Payment ' || o_orderpriority
    FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 4 * o_orderkey + 2, CAST(o_orderdate AS DATE), 'Transfer' FROM orders WHERE o_orderkey % 50 = 0
    UNION ALL SELECT 4 * o_orderkey + 3, CAST(o_orderdate AS DATE), 'Petty' FROM orders WHERE o_orderkey % 75 = 0
),
sold AS (
    SELECT o_orderkey, o_custkey,
        2 * CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
          + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS k,
        SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS price
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
),
all_splits AS (
    SELECT 64 * o_orderkey AS sid, 4 * o_orderkey AS tid, 1000 + o_custkey AS aid, 'debit' AS kind,
        SUM(price) + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS amount, CAST(NULL AS VARCHAR) AS memo
    FROM sold GROUP BY o_orderkey, o_custkey
    UNION ALL SELECT 64 * o_orderkey + 1 + k, 4 * o_orderkey, 20 + k, 'credit', price, 'line total' FROM sold
    UNION ALL SELECT 16 * (4 * o_orderkey + 1), 4 * o_orderkey + 1, 10 + n_regionkey, 'debit', o_totalprice, NULL
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F'
    UNION ALL SELECT 16 * (4 * o_orderkey + 1) + 1, 4 * o_orderkey + 1, 1000 + o_custkey, 'credit', o_totalprice, NULL
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F'
    UNION ALL SELECT 16 * (4 * o_orderkey + 2), 4 * o_orderkey + 2, 10, 'debit', 100, NULL FROM orders WHERE o_orderkey % 50 = 0
    UNION ALL SELECT 16 * (4 * o_orderkey + 2) + 1, 4 * o_orderkey + 2, 11, 'credit', 100, NULL FROM orders WHERE o_orderkey % 50 = 0
    UNION ALL SELECT 16 * (4 * o_orderkey + 3), 4 * o_orderkey + 3, 15, 'debit', 5.25, NULL FROM orders WHERE o_orderkey % 75 = 0
    UNION ALL SELECT 16 * (4 * o_orderkey + 3) + 1, 4 * o_orderkey + 3, 10, 'credit', 5.25, NULL FROM orders WHERE o_orderkey % 75 = 0
),
splits AS MATERIALIZED (SELECT sid, tid, aid, kind, CAST(amount AS DECIMAL(18,2)) AS amount, memo FROM all_splits)
"""

JOURNAL = """
counters AS MATERIALIZED (
    SELECT s.sid, string_agg(DISTINCT a2.name, ',' ORDER BY a2.name) AS counter, COUNT(DISTINCT s2.sid) AS opposite_count,
        MIN(s2.sid) AS opposite_sid
    FROM splits s JOIN splits s2 ON s2.tid = s.tid AND s2.kind <> s.kind JOIN accounts a2 ON a2.aid = s2.aid
    GROUP BY s.sid
),
journal AS (
    SELECT s.*, t.date, t.description, a.name AS account, c.counter, c.opposite_count, c.opposite_sid,
        CASE WHEN s.kind = 'credit' THEN -s.amount ELSE s.amount END AS signed,
        CASE WHEN s.kind = 'debit' THEN s.amount ELSE 0 END AS debit,
        CASE WHEN s.kind = 'credit' THEN s.amount ELSE 0 END AS credit,
        a.name LIKE '%Cash%' AND COALESCE(c.counter LIKE '%Cash%', FALSE) AS internal
    FROM splits s LEFT JOIN accounts a ON a.aid = s.aid LEFT JOIN transactions t ON t.tid = s.tid
        LEFT JOIN counters c ON c.sid = s.sid
)
"""


def money(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(28,2)) AS VARCHAR)"


def shown(x: str, width: int = 5) -> str:
    x = f"CAST({x} AS DECIMAL(28,2))"
    return (
        f"(CASE WHEN {x} < 0 THEN '-' ELSE ' ' END || CASE WHEN abs({x}) >= {10**width} THEN '{'#' * width}.##' "
        f"ELSE lpad(CAST(abs({x}) AS VARCHAR), {width + 3}, ' ') END)"
    )


def day(x: str = "date") -> str:
    return f"CAST({x} AS VARCHAR)"


def scope(start: str = START, end: str = END) -> str:
    return f"date >= DATE '{start}' AND date < DATE '{end}'"


def ledger(body: str, *steps: str) -> str:
    """A query over the ledger; ``steps`` are further common table expressions."""
    return "WITH " + ",\n".join([LEDGER, *steps]) + "\n" + body


def statement(rows: str, wide: int = 5) -> str:
    """The statement columns of ``rows``, which holds the raw running sums b, d and c."""
    return f"""SELECT sid, {day()} AS date, description, account, COALESCE(counter, '') AS counter,
        {money('signed')} AS amount, {money('b')} AS balance, {money('d')} AS debit_balance, {money('c')} AS credit_balance,
        {shown('signed')} AS amount_text, {shown('b')} AS balance_text,
        {shown('d', wide)} AS debit_balance_text, {shown('c', wide)} AS credit_balance_text FROM ({rows})"""


def running(source: str, by: str = "", counts: str = "TRUE", external: bool = False) -> str:
    """Detail rows with the running sums b, d and c over the rows that ``counts`` accepts."""
    over = f"OVER ({by} ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    side = f"({counts}) AND NOT internal" if external else counts
    return f"""SELECT *, SUM(CASE WHEN {counts} THEN signed ELSE 0 END) {over} AS b,
        SUM(CASE WHEN {side} THEN debit ELSE 0 END) {over} AS d,
        SUM(CASE WHEN {side} THEN credit ELSE 0 END) {over} AS c FROM {source}"""


PER_ACCOUNT = "PARTITION BY aid"
CASH = "account LIKE 'Cash%'"


def batch(rows: str, key: str, *changes: tuple[str, str]) -> str:
    """Edits as (seq, target_id, field, value), several per row."""
    return "\nUNION ALL ".join(
        f"SELECT {key} * 8 + {place} AS seq, {key} AS target_id, '{field}' AS field, CAST({value} AS VARCHAR) AS value FROM {rows}"
        for place, (field, value) in enumerate(changes)
    )


ACCOUNT_EDITS = "edits AS (" + batch(
    "accounts",
    "aid",
    ("name", "name || ' *'"),
    ("kind", "CASE kind WHEN 'asset' THEN 'asset' WHEN 'liability' THEN 'loan' ELSE 'expense' END"),
    ("description", "CASE WHEN name LIKE 'Cash%' THEN 'None' ELSE name END"),
    ("balance", "'0'"),
) + ")"
TRANSACTION_EDITS = "edits AS (" + batch(
    "transactions",
    "tid",
    ("date", "CASE WHEN description LIKE 'Sale%' THEN CAST(date + 1 AS VARCHAR) ELSE 'soon' END"),
    ("description", "description || '?'"),
    ("description", "description || '!'"),
    ("tid", "'1'"),
) + ")"
SPLIT_EDITS = "edits AS (" + batch(
    "splits",
    "sid",
    ("amount", "CASE WHEN kind = 'debit' THEN CAST(amount + 1 AS VARCHAR) ELSE 'n/a' END"),
    ("memo", "CASE WHEN memo IS NULL THEN 'checked' ELSE 'None' END"),
    ("account", "CASE WHEN kind = 'debit' THEN 'Nobody' ELSE 'Dormant' END"),
    ("kind", "CASE WHEN kind = 'debit' THEN 'c' ELSE 'D' END"),
    ("tid", "tid - tid % 4"),
    ("sid", "'0'"),
) + ")"
STATEMENT_EDITS = "edits AS (" + batch(
    "splits",
    "sid",
    ("amount", "amount + 1"),
    ("account", "CASE WHEN kind = 'debit' THEN 'Petty Cash' ELSE 'Nobody' END"),
    ("counter", "'Dormant'"),
    ("date", "CASE WHEN kind = 'debit' THEN '2000-02-29' ELSE '2001-02-29' END"),
    ("description", "'sid ' || sid"),
    ("balance", "'0'"),
) + ")"

#: Splits after the statement edits: each amount is the last regular split's of
#: the transaction; an account is the last of the split's own and its counter edits.
STATEMENT_AFTER = """
regular AS (SELECT * FROM journal WHERE opposite_count = 1),
amounts AS (SELECT tid, arg_max(amount + 1, sid) AS new_amount FROM regular GROUP BY tid),
moves AS (
    SELECT sid, sid * 8 + 1 AS seq, 15 AS new_aid FROM splits WHERE kind = 'debit'
    UNION ALL SELECT opposite_sid, sid * 8 + 2, 2 FROM regular
),
last_moves AS (SELECT sid, arg_max(new_aid, seq) AS new_aid FROM moves GROUP BY sid),
after AS (
    SELECT s.sid, s.tid, COALESCE(m.new_aid, s.aid) AS aid, s.kind, COALESCE(a.new_amount, s.amount) AS amount, s.memo
    FROM splits s LEFT JOIN amounts a ON a.tid = s.tid LEFT JOIN last_moves m ON m.sid = s.sid
),
after_transactions AS (
    SELECT t.tid, CASE WHEN e.tid IS NULL THEN t.date WHEN e.debits > 0 THEN DATE '2000-02-29' ELSE t.date END AS date,
        CASE WHEN e.tid IS NULL THEN t.description ELSE 'sid ' || e.last END AS description
    FROM transactions t LEFT JOIN (
        SELECT tid, SUM(CASE WHEN kind = 'debit' THEN 1 ELSE 0 END) AS debits, MAX(sid) AS last FROM splits GROUP BY tid
    ) e ON e.tid = t.tid
)
"""

SPLIT_COLUMNS = f"sid, tid, aid, kind, {money('amount')} AS amount, memo"
IMBALANCES = """
imbalances AS (
    SELECT tid, SUM(CASE WHEN kind = 'credit' THEN -amount ELSE amount END) AS s FROM splits GROUP BY tid HAVING s <> 0
)
"""


def balances(where: str = "TRUE") -> str:
    b = "COALESCE(b, 0)"
    return f"""SELECT a.aid, kind, name, description, {money(b)} AS balance, {shown(b)} AS balance_text
        FROM accounts a LEFT JOIN (SELECT aid, SUM(CASE WHEN kind = 'credit' THEN -amount ELSE amount END) AS b
            FROM splits GROUP BY aid) s ON s.aid = a.aid WHERE {where}"""


def split_list(where: str = "TRUE") -> str:
    return f"""SELECT sid, tid, account, kind, {money('amount')} AS amount, {shown('amount')} AS amount_text, memo
        FROM journal WHERE {where}"""


def rejects(reasons: str, fatal: str, join: str = "") -> str:
    return f"""SELECT seq, target_id, field, value, reason, {fatal} AS fatal FROM
        (SELECT *, {reasons} AS reason FROM edits {join}) WHERE reason IS NOT NULL"""


def grouped(measure: str) -> str:
    return ledger(f"SELECT aid, {money(f'SUM({measure})')} AS s FROM journal GROUP BY aid", JOURNAL)


def view(body: str, *columns: tuple[str, str]) -> str:
    return "SELECT " + ", ".join(f"{c} AS {label}" for label, c in columns) + f" FROM ({body})"


STATEMENT_VIEW = (
    ("date", "date"),
    ("description", "description"),
    ("account", "account"),
    ("counter", "counter"),
    ("amount", "amount_text"),
    ("balance", "balance_text"),
    ("debits", "debit_balance_text"),
    ("credits", "credit_balance_text"),
)


def oracle_sql() -> dict[str, str]:
    s = scope()
    r7 = statement(running("journal", PER_ACCOUNT))
    r7_scoped = statement(running(f"(SELECT * FROM journal WHERE {s})", PER_ACCOUNT))
    r8 = statement(running("journal", PER_ACCOUNT, s))
    r9 = statement(running(f"(SELECT * FROM journal WHERE {CASH})", external=True), 6)
    cash_scope = f"{s} AND {CASH}"
    payments = f"{cash_scope} AND description LIKE 'Payment%'"
    plain = f"sid, {day()} AS date, description, account, counter, kind, {money('amount')} AS amount, {money('b')} AS balance"
    enriched = f"tid, aid, sid, kind, {money('amount')} AS amount, memo, account, {day()} AS date, description"
    transactions = f"SELECT tid, {day()} AS date, description FROM transactions"
    splits_shown = split_list()
    memo = "COALESCE(memo, 'None')"

    def widths(columns: dict[str, str], source: str) -> str:
        return (
            "SELECT "
            + ", ".join(f"least(greatest(max(length({x})), {len(c)}), 45) AS {c}" for c, x in columns.items())
            + f" FROM {source}"
        )

    def cell(x: str, width: str) -> str:
        clipped = f"CASE WHEN length({x}) > {width} THEN left({x}, {width} - 3) || '...' ELSE {x} END"
        return f"rpad({clipped}, CAST({width} AS INTEGER), ' ')"

    account_cells = {"aid": "CAST(aid AS VARCHAR)", "kind": "kind", "name": "name", "balance": "balance_text"}
    split_cells = {
        "sid": "CAST(sid AS VARCHAR)",
        "tid": "CAST(tid AS VARCHAR)",
        "account": "account",
        "kind": "kind",
        "amount": "amount_text",
        "memo": memo,
    }
    listed = f"listed AS ({balances()})"
    measured = "widths AS (" + widths(account_cells, "listed") + ")"
    line = " || ' | ' || ".join(cell(x, f"(SELECT {c} FROM widths)") for c, x in account_cells.items())

    off = "aid IN (SELECT aid FROM splits)"
    raw_kind = "CASE WHEN c_acctbal < 0 THEN 'liability' WHEN c_nationkey <> 3 THEN lower(c_mktsegment) END"
    raw_name = "CASE WHEN c_nationkey <> 7 THEN c_name END"
    domain = "('asset', 'liability', 'equity', 'income', 'expense')"
    name_of = "SELECT name FROM accounts UNION SELECT description FROM transactions"
    events_text = """SELECT event_id, CASE event_type WHEN 'click' THEN props WHEN 'error' THEN regexp_extract(props, '([0-9]+)', 1)
        ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS value FROM events"""
    next_tid = "insert_rows AS (SELECT tid AS seq, tid + 1 AS tid FROM transactions)"
    new_sid = "(SELECT MAX(sid) FROM splits) + 1 + seq - (SELECT MIN(seq) FROM insert_rows)"
    new_amount = "CASE WHEN kind = 'debit' THEN amount + 1 ELSE amount END"
    cash_sids = "SELECT sid FROM journal WHERE account LIKE 'Cash%'"
    after_journal = JOURNAL.replace("counters AS", "counters2 AS").replace("journal AS", "journal2 AS")
    after_journal = (
        after_journal.replace("FROM splits s JOIN splits s2", "FROM after s JOIN after s2")
        .replace("FROM splits s LEFT", "FROM after s LEFT")
        .replace("JOIN transactions", "JOIN after_transactions")
        .replace("JOIN counters c", "JOIN counters2 c")
    )

    account_rejects = rejects(
        """CASE WHEN field = 'balance' THEN 'This field cannot be updated.'
        WHEN value = 'loan' AND field = 'kind' THEN 'invalid input value for enum account_kind: "loan"' END""",
        "field = 'kind'",
    )
    transaction_rejects = rejects(
        """CASE WHEN field = 'tid' THEN 'This field cannot be updated.'
        WHEN field = 'date' AND value = 'soon' THEN 'invalid input syntax for type date: "soon"' END""",
        "field = 'date'",
    )
    split_rejects = rejects(
        """CASE WHEN field = 'sid' THEN 'This field cannot be updated.'
        WHEN field = 'account' AND value = 'Nobody' THEN 'No account named Nobody'
        WHEN field = 'kind' AND value = 'D' THEN 'D must be one of debit, credit'
        WHEN field = 'amount' AND value = 'n/a' THEN 'cannot read n/a' END""",
        "FALSE",
    )

    return {
        "accounts": ledger("SELECT * FROM accounts"),
        "transactions": ledger(transactions),
        "splits": ledger(f"SELECT {SPLIT_COLUMNS} FROM splits"),
        "validate_schema": f"""
            WITH raw AS (SELECT c_custkey AS key, {raw_kind} AS kind, {raw_name} AS name FROM customer)
            SELECT 'accounts' AS table_name, key, 'kind' AS column_name, 'unexpected null' AS problem, kind AS found FROM raw WHERE kind IS NULL
            UNION ALL SELECT 'accounts', key, 'kind', 'not in domain', kind FROM raw WHERE kind NOT IN {domain}
            UNION ALL SELECT 'accounts', key, 'name', 'unexpected null', name FROM raw WHERE name IS NULL""",
        "validate_keys": ledger("""
            SELECT 'accounts' AS table_name, aid AS key, 'aid' AS column_name, 'repeated key' AS problem, '2' AS found
            FROM accounts WHERE kind <> 'asset'
            UNION ALL SELECT 'splits', sid, 'tid', 'no such row', CAST(tid AS VARCHAR)
            FROM splits WHERE tid IN (SELECT tid FROM transactions WHERE description = 'Transfer')"""),
        "bulk_load": ledger(f"SELECT {enriched} FROM journal", JOURNAL),
        "bulk_load_violations": ledger("""
            SELECT 'transactions' AS table_name, CAST(NULL AS BIGINT) AS key, CAST(NULL AS VARCHAR) AS column_name,
                'wrong number of fields' AS problem, tid || ',' || CAST(date AS VARCHAR) || ',' || description || ',extra' AS found
            FROM transactions WHERE tid % 5 = 0
            UNION ALL SELECT 'splits', sid, 'amount', 'too many decimals', CAST(amount AS VARCHAR) || '5' FROM splits WHERE sid % 3 = 0
            UNION ALL SELECT 'transactions', tid, 'description', 'loaded whole', description || chr(10) || 'second line'
            FROM transactions WHERE tid % 5 <> 0"""),
        "publish_conflict": ledger("""SELECT aid, kind, name || ' *' AS name, kind AS description, CAST(3 AS BIGINT) AS version,
            'Made from version 1, but version 2 has been published.' AS refused FROM accounts"""),
        "publish_round_trip": ledger(
            balances().replace("FROM splits GROUP", "FROM splits WHERE tid NOT IN (SELECT tid FROM imbalances) GROUP"),
            IMBALANCES,
        ),
        "export_report": ledger(f"SELECT {line} AS line FROM listed", listed, measured),
        "column_widths": ledger(widths(split_cells, f"({splits_shown})"), JOURNAL),
        "view_accounts": ledger(view(balances(), ("aid", "aid"), ("kind", "kind"), ("name", "name"), ("balance", "balance_text"))),
        "view_transactions": ledger(transactions),
        "view_splits": ledger(
            view(splits_shown, ("sid", "sid"), ("tid", "tid"), ("account", "account"), ("kind", "kind"), ("amount", "amount_text"), ("memo", memo)),
            JOURNAL,
        ),
        "view_scoped_splits": ledger(
            view(splits_shown, ("sid", "sid"), ("kind", "kind"), ("account", "account"), ("amount", "amount_text"), ("memo", memo)),
            JOURNAL,
        ),
        "view_account_statement": ledger(view(r7, *STATEMENT_VIEW), JOURNAL),
        "view_cash_statement": ledger(view(r9, *STATEMENT_VIEW), JOURNAL),
        "scope_account": ledger(f"SELECT {SPLIT_COLUMNS} FROM splits WHERE aid IN (SELECT aid FROM accounts WHERE kind = 'income')"),
        "scope_transaction": ledger(f"SELECT {SPLIT_COLUMNS} FROM splits WHERE tid IN (SELECT tid FROM transactions WHERE description = 'Petty')"),
        "scope_split": ledger(f"SELECT {SPLIT_COLUMNS} FROM splits WHERE memo IS NULL"),
        "scope_dates": ledger(f"{transactions} WHERE {s}"),
        "like_prefix": ledger("SELECT * FROM accounts WHERE name LIKE 'Cash%'"),
        "like_contains": ledger("SELECT * FROM accounts WHERE name LIKE '%Cash%'"),
        "like_param": ledger(f"{transactions} WHERE description LIKE '%_-%G%'"),
        "not_internal_transfer": ledger("SELECT sid, account, counter FROM journal WHERE account LIKE '%Cash%' AND NOT internal", JOURNAL),
        "master_detail": ledger(f"SELECT {SPLIT_COLUMNS} FROM splits WHERE tid IN (SELECT tid FROM imbalances)", IMBALANCES),
        "parameter_binding": ledger(f"{transactions} WHERE {s} AND description LIKE 'Payment%'"),
        "enrich_splits": ledger(f"SELECT {enriched} FROM journal", JOURNAL),
        "splits_with_account": ledger(f"SELECT sid, tid, aid, kind, {money('amount')} AS amount, memo, account FROM journal", JOURNAL),
        "accounts_left_splits": ledger(
            f"""SELECT a.aid, a.kind, a.name, a.description, s.sid, s.tid, s.kind AS side, {money('s.amount')} AS amount
            FROM accounts a LEFT JOIN splits s ON s.aid = a.aid"""
        ),
        "counter_splits": ledger(
            """SELECT sid, tid, kind, COALESCE(opposite_count, 0) AS opposite_count,
            CASE WHEN opposite_count = 1 THEN opposite_sid END AS opposite_sid FROM journal""",
            JOURNAL,
        ),
        "counter_splits_inner": ledger(
            """SELECT sid, tid, kind, opposite_count, CASE WHEN opposite_count = 1 THEN opposite_sid END AS opposite_sid
            FROM journal WHERE opposite_count > 0 AND date IS NOT NULL""",
            JOURNAL,
        ),
        "asof_account": ledger(
            f"""SELECT DISTINCT aid, {day()} AS date, {money('SUM(signed) OVER (PARTITION BY aid ORDER BY date)')} AS balance
            FROM journal""",
            JOURNAL,
        ),
        "asof_global": ledger(
            f"""SELECT DISTINCT {day()} AS date, {money('SUM(signed) OVER (ORDER BY date)')} AS balance,
            {money('SUM(debit) OVER (ORDER BY date)')} AS debits FROM journal""",
            JOURNAL,
        ),
        "asof_probe": ledger(
            f"SELECT sid, aid, {day()} AS date, {money('b')} AS balance FROM ({running('journal', PER_ACCOUNT, s)})", JOURNAL
        ),
        "semi_join": ledger(f"{transactions} WHERE tid IN (SELECT tid FROM journal WHERE {CASH})", JOURNAL),
        "scalar_subquery": ledger("SELECT aid AS imbalance_aid, (SELECT MIN(tid) FROM transactions) AS lowest_tid FROM accounts WHERE name = 'Imbalance'"),
        "signed_sum": grouped("signed"),
        "debit_sum": grouped("debit"),
        "credit_sum": grouped("credit"),
        "external_sums": ledger(
            f"""SELECT account, {money('SUM(CASE WHEN internal THEN 0 ELSE debit END)')} AS debits,
            {money('SUM(CASE WHEN internal THEN 0 ELSE credit END)')} AS credits FROM journal WHERE {CASH} GROUP BY account""",
            JOURNAL,
        ),
        "counter_list": ledger("SELECT sid, COALESCE(counter, '') AS counter FROM journal", JOURNAL),
        "counter_list_nullable": ledger("SELECT sid, counter FROM journal", JOURNAL),
        "account_sums": ledger(
            f"""SELECT aid, {money('SUM(signed)')} AS balance, {money('SUM(debit)')} AS debits, {money('SUM(credit)')} AS credits
            FROM journal GROUP BY aid""",
            JOURNAL,
        ),
        "imbalanced_transactions": ledger(f"SELECT tid, {money('s')} AS s FROM imbalances", IMBALANCES),
        "opposite_split_count": ledger("SELECT sid, COALESCE(opposite_count, 0) AS opposite_count FROM journal", JOURNAL),
        "min_tid": ledger("SELECT MIN(tid) AS tid FROM transactions"),
        "running_balance": ledger(f"SELECT sid, account, date, balance FROM ({r7})", JOURNAL),
        "running_debits": ledger(f"SELECT sid, account, date, debit_balance FROM ({r7})", JOURNAL),
        "running_credits": ledger(f"SELECT sid, account, date, credit_balance FROM ({r7})", JOURNAL),
        "running_cash": ledger(f"SELECT sid, date, balance, debit_balance, credit_balance FROM ({r9})", JOURNAL),
        "money_text_5": ledger(f"SELECT sid, {shown('amount')} AS shown FROM splits"),
        "money_text_6": ledger(f"SELECT aid, {shown('SUM(signed)', 6)} AS shown FROM journal GROUP BY aid", JOURNAL),
        "signed_amount": ledger(f"SELECT sid, {money('signed')} AS amount FROM journal", JOURNAL),
        "default_account_name": """SELECT o_orderkey, 'account_' || CASE WHEN o_orderkey > 9999 THEN '####'
            ELSE lpad(CAST(o_orderkey AS VARCHAR), 4, '0') END AS name FROM orders""",
        "null_label": ledger(f"SELECT sid, {memo} AS memo FROM splits"),
        "label_to_null": ledger("SELECT sid, memo FROM splits"),
        "clip_text": "SELECT doc_id, CASE WHEN length(text) > 45 THEN substring(text, 1, 42) || '...' ELSE text END AS clipped FROM documents",
        "parse_split_kind": """
            WITH v AS (SELECT CASE l_returnflag WHEN 'A' THEN 'c' WHEN 'N' THEN '' ELSE lower(l_linestatus) END AS value FROM lineitem)
            SELECT value, CASE WHEN value IN ('credit', 'c', '') THEN 'credit' WHEN value IN ('debit', 'd') THEN 'debit' END AS kind,
            COUNT(*) AS n FROM v GROUP BY ALL""",
        "parse_amount": f"""WITH v AS ({events_text})
            SELECT event_id, {money("TRY_CAST(value AS DECIMAL(18,2))")} AS amount FROM v""",
        "parse_tid": f"""WITH v AS ({events_text})
            SELECT event_id, CASE WHEN regexp_full_match(value, '-?[0-9]+') THEN TRY_CAST(value AS BIGINT) END AS tid FROM v""",
        "account_balances": ledger(balances()),
        "account_balance": ledger(balances("kind = 'asset'")),
        "transaction_list": ledger(transactions),
        "split_list": ledger(splits_shown, JOURNAL),
        "splits_of": ledger(split_list("tid IN (SELECT tid FROM imbalances)"), JOURNAL, IMBALANCES),
        "split": ledger(split_list(CASH), JOURNAL),
        "account_statement": ledger(r7, JOURNAL),
        "account_statement_scoped": ledger(r7_scoped, JOURNAL),
        "account_statement_of_accounts": ledger(
            statement(running(f"(SELECT * FROM journal WHERE {s} AND account LIKE '%Cash%')", PER_ACCOUNT)), JOURNAL
        ),
        "account_statement_journal": ledger(r7, JOURNAL),
        "account_statement_rows": ledger(r8, JOURNAL),
        "account_statement_rows_of": ledger(f"SELECT * FROM ({r8}) WHERE {CASH}", JOURNAL),
        "cash_statement": ledger(r9, JOURNAL),
        "cash_statement_scoped": ledger(statement(running(f"(SELECT * FROM journal WHERE {payments})", external=True), 6), JOURNAL),
        "cash_statement_journal": ledger(r9, JOURNAL),
        "cash_statement_rows": ledger(statement(running("journal", "", cash_scope, external=True), 6), JOURNAL),
        "statement_history": ledger(f"SELECT {plain} FROM ({running('journal', PER_ACCOUNT)})", JOURNAL),
        "statement_opening": ledger(f"SELECT {plain} FROM ({running('journal', PER_ACCOUNT)}) WHERE {s}", JOURNAL),
        "imbalances": ledger(f"SELECT tid, {money('s')} AS s FROM imbalances", IMBALANCES),
        "statement_opening_journal": ledger(
            f"SELECT {plain} FROM ({running('journal', PER_ACCOUNT)}) WHERE {scope(MID_YEAR, END)}", JOURNAL
        ),
        "account_statement_rows_journal": ledger(f"SELECT * FROM ({r7}) WHERE {CASH}", JOURNAL),
        "checkpoints": ledger(
            f"""SELECT f.aid, CAST(0 AS INTEGER) AS month, CAST(y.year AS INTEGER) AS year, {money('SUM(signed)')} AS balance,
            {money('SUM(debit)')} AS debit_balance, {money('SUM(credit)')} AS credit_balance
            FROM (SELECT aid, MIN(year(date)) AS first FROM journal WHERE date IS NOT NULL GROUP BY aid) f
            JOIN (SELECT unnest(range(0, 10000)) AS year) y
                ON y.year > f.first AND y.year <= (SELECT MAX(year(date)) + 1 FROM transactions)
            JOIN journal j ON j.aid = f.aid AND year(j.date) < y.year GROUP BY f.aid, y.year""",
            JOURNAL,
        ),
        "journal": ledger(f"SELECT {enriched}, counter FROM journal", JOURNAL),
        "commit_gate": ledger(f"SELECT COUNT(*) = 0 AS ok, COUNT(*) AS imbalanced, {money('SUM(s)')} AS off_by FROM imbalances", IMBALANCES),
        "staged_preview": ledger(
            f"""SELECT a.aid, {money('COALESCE(x.s, 0)')} AS before, {money('COALESCE(y.s, 0)')} AS after FROM accounts a
            LEFT JOIN (SELECT aid, SUM(CASE WHEN kind = 'credit' THEN -amount ELSE amount END) AS s FROM splits GROUP BY aid) x ON x.aid = a.aid
            LEFT JOIN (SELECT CASE WHEN kind = 'debit' THEN aid ELSE 2 END AS aid,
                SUM(CASE WHEN kind = 'debit' THEN -(amount + 1) ELSE -amount END) AS s FROM splits GROUP BY 1) y ON y.aid = a.aid"""
        ),
        "lookup_account": ledger(f"SELECT name, MIN(aid) AS aid FROM accounts WHERE name IN ({name_of}) GROUP BY name HAVING COUNT(*) = 1"),
        "insert_accounts": ledger("""
            SELECT * FROM accounts UNION ALL
            SELECT aid, 'asset', 'account_' || CASE WHEN aid > 9999 THEN '####' ELSE lpad(CAST(aid AS VARCHAR), 4, '0') END, NULL FROM
            (SELECT (SELECT MAX(aid) FROM accounts) + 1 + tid - (SELECT MIN(tid) FROM transactions) AS aid FROM transactions)"""),
        "insert_transactions": ledger(f"""
            {transactions} UNION ALL
            SELECT (SELECT MAX(tid) FROM transactions) + 1 + aid - (SELECT MIN(aid) FROM accounts), '{TODAY}', '' FROM accounts"""),
        "insert_splits": ledger(f"""
            SELECT {SPLIT_COLUMNS} FROM splits UNION ALL
            SELECT (SELECT MAX(sid) FROM splits) + 1 + aid - (SELECT MIN(aid) FROM accounts), (SELECT MIN(tid) FROM transactions),
            1, 'debit', '0.00', NULL FROM accounts"""),
        "insert_splits_of": ledger(
            f"""SELECT {SPLIT_COLUMNS} FROM splits UNION ALL
            SELECT {new_sid}, tid, 1, 'debit', '0.00', NULL FROM insert_rows WHERE tid IN (SELECT tid FROM transactions)""",
            next_tid,
        ),
        "insert_splits_of_rejects": ledger(
            """SELECT seq, tid AS target_id, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS value,
            'no transaction with this id' AS reason, TRUE AS fatal FROM insert_rows WHERE tid NOT IN (SELECT tid FROM transactions)""",
            next_tid,
        ),
        "update_accounts": ledger("""
            SELECT aid, CASE kind WHEN 'asset' THEN 'asset' WHEN 'liability' THEN 'liability' ELSE 'expense' END AS kind,
            name || ' *' AS name, CASE WHEN name LIKE 'Cash%' THEN NULL ELSE name END AS description FROM accounts"""),
        "update_accounts_rejects": ledger(account_rejects, ACCOUNT_EDITS),
        "update_transactions": ledger(
            f"""SELECT tid, CAST(CASE WHEN description LIKE 'Sale%' THEN date + 1 ELSE date END AS VARCHAR) AS date,
            description || '!' AS description FROM transactions"""
        ),
        "update_transactions_rejects": ledger(transaction_rejects, TRANSACTION_EDITS),
        "update_splits": ledger(f"""
            SELECT sid, tid - tid % 4 AS tid, CASE WHEN kind = 'debit' THEN aid ELSE 2 END AS aid, 'credit' AS kind,
            {money("CASE WHEN kind = 'debit' THEN amount + 1 ELSE amount END")} AS amount,
            CASE WHEN memo IS NULL THEN 'checked' END AS memo FROM splits"""),
        "update_splits_rejects": ledger(split_rejects, SPLIT_EDITS),
        "update_statement": ledger(f"SELECT {SPLIT_COLUMNS} FROM after", JOURNAL, STATEMENT_AFTER),
        "update_statement_transactions": ledger(f"SELECT tid, {day()} AS date, description FROM after_transactions", JOURNAL, STATEMENT_AFTER),
        "update_statement_rejects": ledger(
            rejects(
                """CASE WHEN field = 'balance' THEN 'Cannot update field.'
                WHEN field = 'date' AND value = '2001-02-29' THEN 'invalid input syntax for type date: "2001-02-29"'
                WHEN field = 'account' AND value = 'Nobody' THEN 'No account named Nobody'
                WHEN field = 'counter' AND COALESCE(opposite_count, 0) <> 1 THEN 'Cannot update counter on irregular transactions.'
                WHEN field = 'amount' AND COALESCE(opposite_count, 0) <> 1 THEN 'Cannot update amount on irregular transactions.' END""",
                "field = 'date'",
                "LEFT JOIN counters ON sid = target_id",
            ),
            JOURNAL,
            STATEMENT_EDITS,
        ),
        "update_two_views": ledger(
            f"""SELECT s.sid, s.tid, s.aid, s.kind, {money('''CASE
                WHEN w.last IS NULL THEN CASE WHEN s.kind = 'debit' THEN s.amount + 1 ELSE s.amount END
                WHEN s.kind = 'debit' AND s.sid >= w.last THEN s.amount + 1 ELSE w.new_amount END''')} AS amount, s.memo
            FROM splits s LEFT JOIN wide w ON w.tid = s.tid""",
            # a statement edit of an amount needs one split opposite, in a transaction that exists
            """sides AS MATERIALIZED (SELECT tid, kind, COUNT(*) AS n FROM splits GROUP BY tid, kind),
            wide AS MATERIALIZED (SELECT s.tid, MAX(s.sid) AS last, arg_max(s.amount + 1, s.sid) AS new_amount
                FROM splits s JOIN sides o ON o.tid = s.tid AND o.kind <> s.kind AND o.n = 1
                WHERE s.tid IN (SELECT tid FROM transactions) GROUP BY s.tid)""",
        ),
        "delete_transactions": ledger(f"SELECT {SPLIT_COLUMNS} FROM splits WHERE tid NOT IN (SELECT tid FROM imbalances)", IMBALANCES),
        "delete_accounts": ledger(f"SELECT * FROM accounts WHERE {off}"),
        "delete_accounts_rejects": ledger(f"""
            SELECT aid AS seq, aid AS target_id, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS value,
            'account is still referenced from splits' AS reason, TRUE AS fatal FROM accounts WHERE {off}"""),
        "delete_splits": ledger(f"SELECT {SPLIT_COLUMNS} FROM splits WHERE memo IS NOT NULL"),
        "delete_by_statement_row": ledger(
            f"{transactions} WHERE tid NOT IN (SELECT tid FROM splits WHERE sid IN ({cash_sids}))", JOURNAL
        ),
        "refused_insert": ledger("""SELECT sid AS seq, CAST(NULL AS BIGINT) AS target_id, CAST(NULL AS VARCHAR) AS field,
            CAST(NULL AS VARCHAR) AS value, 'Cannot insert into statements.' AS reason, FALSE AS fatal FROM splits"""),
        "refused_delete": ledger("""SELECT sid AS seq, sid AS target_id, CAST(NULL AS VARCHAR) AS field,
            CAST(NULL AS VARCHAR) AS value, 'Cannot delete from statements.' AS reason, FALSE AS fatal FROM splits"""),
        "batch_rejects": ledger(
            " UNION ALL ".join(
                f"SELECT * FROM (WITH {steps} {found})"
                for steps, found in (
                    (ACCOUNT_EDITS, account_rejects),
                    (TRANSACTION_EDITS, transaction_rejects),
                    (SPLIT_EDITS, split_rejects),
                )
            )
        ),
        "insert_gapless": ledger("""
            SELECT aid * 1000003 AS seq, 'accounts' AS table_name,
                (SELECT MAX(aid) FROM accounts) + ROW_NUMBER() OVER (ORDER BY aid) AS id FROM splits
            UNION ALL SELECT tid * 4000000007 - 1000000000000, 'transactions',
                (SELECT MAX(tid) FROM transactions) + ROW_NUMBER() OVER (ORDER BY tid) FROM transactions
            UNION ALL SELECT aid, 'splits', (SELECT MAX(sid) FROM splits) + ROW_NUMBER() OVER (ORDER BY aid, tid)
                FROM splits WHERE tid + 1 IN (SELECT tid FROM transactions)"""),
        "insert_returned": ledger(
            f"""SELECT tid AS seq, 'accounts' AS table_name,
                (SELECT MAX(aid) FROM accounts) + 1 + tid - (SELECT MIN(tid) FROM transactions) AS id FROM transactions
            UNION ALL SELECT aid, 'transactions', (SELECT MAX(tid) FROM transactions) + 1 + aid - (SELECT MIN(aid) FROM accounts) FROM accounts
            UNION ALL SELECT seq, 'splits', {new_sid} FROM insert_rows WHERE tid IN (SELECT tid FROM transactions)""",
            next_tid,
        ),
        "change_imbalances": ledger(f"""
            SELECT tid - tid % 4 AS tid, {money("SUM(-CASE WHEN kind = 'debit' THEN amount + 1 ELSE amount END)")} AS s
            FROM splits GROUP BY 1 HAVING SUM(CASE WHEN kind = 'debit' THEN amount + 1 ELSE amount END) <> 0"""),
        "change_problems": ledger("""
            SELECT 'splits' AS table_name, sid AS key, 'aid' AS column_name, 'no such row' AS problem, CAST(aid * 2 AS VARCHAR) AS found
                FROM splits WHERE memo IS NULL AND aid * 2 NOT IN (SELECT aid FROM accounts WHERE kind <> 'income')
            UNION ALL SELECT 'splits', sid, 'aid', 'no such row', CAST(aid AS VARCHAR)
                FROM splits WHERE memo IS NOT NULL AND aid IN (SELECT aid FROM accounts WHERE kind = 'income')
            UNION ALL SELECT 'splits', sid, 'tid', 'no such row', CAST(tid AS VARCHAR)
                FROM splits WHERE memo IS NULL AND tid NOT IN (SELECT tid FROM transactions WHERE description <> 'Petty')
            UNION ALL SELECT 'splits', sid, 'tid', 'no such row', CAST(tid AS VARCHAR)
                FROM splits WHERE memo IS NOT NULL AND tid IN (SELECT tid FROM transactions WHERE description = 'Petty')"""),
        "reselect_accounts": ledger(
            f"""SELECT aid, 'expense' AS kind, name || ' *' AS name, CASE WHEN name LIKE 'Cash%' THEN NULL ELSE name END AS description,
            balance, balance_text FROM ({balances("kind = 'income'")})"""
        ),
        "reselect_transactions": ledger(
            f"SELECT tid, {day()} AS date, description || '!' AS description FROM transactions WHERE description = 'Transfer'"
        ),
        "reselect_splits": ledger(
            f"""SELECT sid, tid - tid % 4 AS tid, CASE WHEN kind = 'debit' THEN account ELSE 'Dormant' END AS account, 'credit' AS kind,
            {money(new_amount)} AS amount, {shown(new_amount)} AS amount_text, CASE WHEN memo IS NULL THEN 'checked' END AS memo
            FROM (SELECT s.*, a.name AS account FROM splits s JOIN accounts a ON a.aid = s.aid)"""
        ),
        "reselect_scoped_splits": ledger(
            f"""SELECT sid, 'credit' AS kind, CASE WHEN kind = 'debit' THEN account ELSE 'Dormant' END AS account, {shown(new_amount)} AS amount, 'checked' AS memo
            FROM (SELECT s.*, a.name AS account FROM splits s JOIN accounts a ON a.aid = s.aid) WHERE memo IS NULL"""
        ),
        "reselect_cash_statement": ledger(
            f"""SELECT * FROM ({statement(running('journal2', '', cash_scope, external=True), 6)})
            WHERE sid IN (SELECT sid FROM splits WHERE kind = 'debit')""",
            JOURNAL,
            STATEMENT_AFTER,
            after_journal,
        ),
        "session_cells": ledger(
            f"""SELECT 'accounts' AS table_name, aid AS key, 'name' AS column_name, name AS old, name || ' *' AS new FROM accounts
            UNION ALL SELECT 'accounts', aid, 'kind', kind, CASE WHEN kind = 'asset' THEN 'asset' ELSE 'expense' END FROM accounts
                WHERE kind NOT IN ('asset', 'liability', 'expense')
            UNION ALL SELECT 'accounts', aid, 'description', description, CASE WHEN name LIKE 'Cash%' THEN NULL ELSE name END FROM accounts
                WHERE description IS DISTINCT FROM CASE WHEN name LIKE 'Cash%' THEN NULL ELSE name END
            UNION ALL SELECT 'transactions', tid, unnest(['date', 'description']), unnest([{day()}, description]), NULL
                FROM transactions WHERE tid IN (SELECT tid FROM imbalances)
            UNION ALL SELECT 'splits', sid, column_name, old, NULL FROM (
                SELECT sid, unnest(['tid', 'aid', 'kind', 'amount', 'memo']) AS column_name,
                    unnest([tid::VARCHAR, aid::VARCHAR, kind, {money('amount')}::VARCHAR, memo]) AS old
                FROM splits WHERE tid IN (SELECT tid FROM imbalances)) WHERE old IS NOT NULL
            UNION ALL SELECT 'splits', sid, unnest(['tid', 'aid', 'kind', 'amount']), NULL, unnest([tid::VARCHAR, '1', 'debit', '0.00'])
                FROM (SELECT tid, (SELECT MAX(sid) FROM splits) + 1 + tid
                    - (SELECT MIN(tid) FROM transactions WHERE description = 'Petty') AS sid
                    FROM transactions WHERE description = 'Petty')""",
            IMBALANCES,
        ),
        "reselect_changed": ledger(
            f"SELECT * FROM ({statement(running('journal2', PER_ACCOUNT, s))}) WHERE sid IN (SELECT sid FROM splits WHERE kind = 'debit')",
            JOURNAL,
            STATEMENT_AFTER,
            after_journal,
        ),
    }
