"""Column types and value domains of the ledger tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
#: Sums need room: ten more digits cover ten billion full-width amounts.
TOTAL = T.DecimalType(28, 2)

ACCOUNTS = T.StructType([
    T.StructField("aid", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
])
TRANSACTIONS = T.StructType([
    T.StructField("tid", T.LongType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("description", T.StringType(), False),
])
SPLITS = T.StructType([
    T.StructField("sid", T.LongType(), False),
    T.StructField("tid", T.LongType(), False),
    T.StructField("aid", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("memo", T.StringType(), True),
])
#: A split with what the other tables say about it, but for the accounts opposite: of those only whether one
#: mentions cash (NULL: there are none).
JOURNAL = T.StructType(
    SPLITS.fields
    + [
        T.StructField("date", T.DateType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("account", T.StringType(), True),
        T.StructField("counter_cash", T.BooleanType(), True),
    ]
)
#: The account names of one side of a transaction, once for all splits of the other side.
COUNTERS = T.StructType([
    T.StructField("tid", T.LongType(), True),
    T.StructField("side", T.StringType(), True),
    T.StructField("date", T.DateType(), True),
    T.StructField("names", T.StringType(), True),
])
#: What an account moved before a year (month 0) and in each of its months.
CHECKPOINTS = T.StructType([
    T.StructField("aid", T.LongType(), True),
    T.StructField("month", T.IntegerType(), True),
    T.StructField("balance", TOTAL, True),
    T.StructField("debit_balance", TOTAL, True),
    T.StructField("credit_balance", TOTAL, True),
    T.StructField("year", T.IntegerType(), True),
])
TABLES = {"accounts": ACCOUNTS, "transactions": TRANSACTIONS, "splits": SPLITS}
KEYS = {"accounts": "aid", "transactions": "tid", "splits": "sid"}

EDITS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("target_id", T.LongType(), True),
    T.StructField("field", T.StringType(), True),
    T.StructField("value", T.StringType(), True),
])
REJECTS = T.StructType(
    EDITS.fields
    + [T.StructField("reason", T.StringType(), False), T.StructField("fatal", T.BooleanType(), False)]
)

# Kinds in their sort order.
ACCOUNT_KINDS = ("asset", "liability", "equity", "income", "expense")
SPLIT_KINDS = ("debit", "credit")

# Defaults of a new account, a new split, a book; and the widest range of dates, for callers who want it.
NEW_ACCOUNT_KIND = "asset"
NEW_SPLIT_KIND = "debit"
IMBALANCE_ACCOUNT = "Imbalance"
FIRST_DATE = "0001-01-01"
LAST_DATE = "9999-01-01"
DEFAULT_YEAR = "2017"

# Account-name patterns of the cash statement.
CASH_ACCOUNT = "Cash%"
CASH_ANYWHERE = "%Cash%"
