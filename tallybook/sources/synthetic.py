"""A ledger derived from the order tables: sales, payments, transfers, petty cash.

Every order is a sale to its customer, credited to one income account per
return flag and line status; a finished order is also paid into the cash
account of the customer's region. Every 50th order comes with a transfer
between two cash accounts, every 75th with a petty-cash top-up, and every 97th
sale is one unit out of balance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.ledger import Ledger
from tallybook.sources.schema import ACCOUNTS, MONEY, SPLITS, TABLES, TRANSACTIONS

# Account numbers and the offset of each transaction type.
IMBALANCE, DORMANT, CASH, PETTY_CASH, SALES, CUSTOMER = 1, 2, 10, 15, 20, 1000
CLASSES = 6
SALE, PAYMENT, TRANSFER, PETTY = 0, 1, 2, 3


def _shape(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table]])


def _sales_class() -> Column:
    """Number of the income account: two per return flag, one per line status."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return flag * 2 + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)


def _tid(kind: int) -> Column:
    return F.col("o_orderkey") * 4 + kind


def derived_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """The ledger as a plan over the Parquet tables; nothing is computed yet."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders, customer = table("orders"), table("customer")
    lines = table("lineitem").withColumn("class", _sales_class())
    nation, region = table("nation"), table("region")

    # accounts
    fixed = spark.createDataFrame(
        [
            (IMBALANCE, "equity", "Imbalance", None),
            (DORMANT, "liability", "Dormant", "never used"),
            (PETTY_CASH, "asset", "Petty Cash", None),
        ],
        ACCOUNTS,
    )
    cash = region.select(
        (F.col("r_regionkey") + CASH).alias("aid"),
        F.lit("asset").alias("kind"),
        F.concat(F.lit("Cash "), "r_name").alias("name"),
        F.lit(None).alias("description"),
    )
    sales = lines.select("class", "l_returnflag", "l_linestatus").distinct().select(
        (F.col("class") + SALES).alias("aid"),
        F.lit("income").alias("kind"),
        F.concat(F.lit("Sales "), "l_returnflag", "l_linestatus").alias("name"),
        F.lit(None).alias("description"),
    )
    customers = customer.select(
        (F.col("c_custkey") + CUSTOMER).alias("aid"),
        F.lit("asset").alias("kind"),
        F.col("c_name").alias("name"),
        F.lit(None).alias("description"),
    )
    accounts = _shape(fixed, "accounts")
    for part in (cash, sales, customers):
        accounts = accounts.unionByName(_shape(part, "accounts"))

    # transactions: one pass over the orders, one to four rows each
    paid = F.col("o_orderstatus") == "F"
    moved = F.col("o_orderkey") % 50 == 0
    topped = F.col("o_orderkey") % 75 == 0
    day = F.col("o_orderdate").cast("date")

    def entry(kind: int, date: Column, text: Column, when: Column | None = None) -> Column:
        row = F.struct(_tid(kind).alias("tid"), date.alias("date"), text.alias("description"))
        return row if when is None else F.when(when, row)

    transactions = orders.select(
        F.explode(
            F.array_compact(
                F.array(
                    entry(SALE, day, F.concat(F.lit("Sale "), "o_orderpriority")),
                    entry(PAYMENT, F.date_add(day, 30), F.concat(F.lit("Payment "), "o_orderpriority"), paid),
                    entry(TRANSFER, day, F.lit("Transfer"), moved),
                    entry(PETTY, day, F.lit("Petty"), topped),
                )
            )
        ).alias("t")
    ).select("t.*")

    # splits: likewise one pass over the orders, with each order's price per class
    def split(kind: int, place: int, aid, side: str, amount, when: Column, memo: str | None = None) -> Column:
        row = F.struct(
            (_tid(kind) * 16 + place).cast("long").alias("sid"),
            _tid(kind).cast("long").alias("tid"),
            F.lit(aid).cast("long").alias("aid"),
            F.lit(side).alias("kind"),
            F.lit(amount).cast(MONEY).alias("amount"),
            F.lit(memo).cast("string").alias("memo"),
        )
        return F.when(when, row)

    price = F.col("l_extendedprice").cast(MONEY)
    sold = lines.groupBy("l_orderkey").agg(
        F.sum(price).alias("sold"),
        *[F.sum(F.when(F.col("class") == k, price)).alias(f"sold_{k}") for k in range(CLASSES)],
    )
    home = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", "n_regionkey")
    # sums are met last, so that they are not moved by customer
    facts = orders.join(home, orders.o_custkey == home.c_custkey, "left").join(
        sold, orders.o_orderkey == sold.l_orderkey, "left"
    )
    customer_aid = F.col("o_custkey") + CUSTOMER
    planted = F.when(F.col("o_orderkey") % 97 == 0, F.lit(1)).otherwise(F.lit(0))
    settled = paid & F.col("n_regionkey").isNotNull()
    splits = facts.select(
        F.explode(
            F.array_compact(
                F.array(
                    split(SALE, 0, customer_aid, "debit", F.col("sold") + planted, F.col("sold").isNotNull()),
                    *[
                        split(
                            SALE, 1 + k, SALES + k, "credit", F.col(f"sold_{k}"), F.col(f"sold_{k}").isNotNull(), "line total"
                        )
                        for k in range(CLASSES)
                    ],
                    split(PAYMENT, 0, F.col("n_regionkey") + CASH, "debit", F.col("o_totalprice"), settled),
                    split(PAYMENT, 1, customer_aid, "credit", F.col("o_totalprice"), settled),
                    split(TRANSFER, 0, CASH, "debit", "100.00", moved),
                    split(TRANSFER, 1, CASH + 1, "credit", "100.00", moved),
                    split(PETTY, 0, PETTY_CASH, "debit", "5.25", topped),
                    split(PETTY, 1, CASH, "credit", "5.25", topped),
                )
            )
        ).alias("s")
    ).select("s.*")

    return Ledger(accounts, _shape(transactions, "transactions"), _shape(splits, "splits"))
