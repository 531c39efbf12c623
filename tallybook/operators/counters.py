"""The other side of each split: opposite-kind splits of the same transaction.

Nothing here pairs splits with each other. A transaction is summarised once, to
one row, and the summary is joined back to its splits; a transaction with very
many splits therefore costs as many rows as it has, not the square of that. The
summaries combine on the map side before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.ledger import Ledger
from tallybook.operators.joins import named_accounts
from tallybook.operators.skew import join_facts
from tallybook.sources.schema import SPLIT_KINDS


def side_names(ledger: Ledger) -> DataFrame:
    """(tid, side, names): per transaction and side, the sorted distinct names of its accounts.

    Splits are brought down to one row per account of a side by their numbers, whatever their count,
    before names are looked up and listed; a side without named accounts is absent. The lists are
    laid out by transaction, so that a join with its facts need not move them.
    """
    used = ledger.splits.select("tid", F.col("kind").alias("side"), "aid").distinct()
    listed = F.array_join(F.array_sort(F.collect_set("account")), ",").alias("names")
    return used.join(named_accounts(ledger), "aid").repartition("tid").groupBy("tid", "side").agg(listed)


def attach_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``counter``: the account names opposite each row (tid, kind), NULL when there are none.

    ``names`` holds each list once; it is copied to the rows here, so this comes after other joins.
    """
    debit, credit = SPLIT_KINDS
    kind = F.col("kind")
    other = F.when(kind == debit, credit).when(kind == credit, debit)
    lists = names.select("tid", F.col("side").alias("opposite_side"), F.col("names").alias("counter"))
    joined = join_facts(rows.withColumn("opposite_side", other), lists, ("tid", "opposite_side"))
    return joined.drop("opposite_side")


def cash_sides(cash_splits: DataFrame) -> DataFrame:
    """Per transaction, whether a side has a split of an account that mentions cash.

    Takes the splits of such accounts only; a transaction without any is absent.
    Same answer as searching the list of names, without making it.
    """
    return cash_splits.groupBy("tid").agg(*[F.max(F.col("kind") == k).alias(f"{k}_cash") for k in SPLIT_KINDS])


def side_counts(splits: DataFrame) -> DataFrame:
    """Per transaction, the number of splits of each side and the lowest sid among them."""
    measures = []
    for k in SPLIT_KINDS:
        sid = F.when(F.col("kind") == k, F.col("sid"))
        measures += [F.count(sid).alias(f"{k}_count"), F.min(sid).alias(f"{k}_sid")]
    return splits.groupBy("tid").agg(*measures)


def opposite(measure: str) -> Column:
    """The measure of the other side, for a split joined with its summary."""
    debit, credit = SPLIT_KINDS
    return F.when(F.col("kind") == debit, F.col(f"{credit}_{measure}")).when(
        F.col("kind") == credit, F.col(f"{debit}_{measure}")
    )


def with_counter(splits: DataFrame, ledger: Ledger) -> DataFrame:
    """Add ``counter``: the account names opposite each split, NULL when there are none."""
    return attach_names(splits, side_names(ledger))


def counter_splits(splits: DataFrame, required: bool = False) -> DataFrame:
    """Each split with the number of opposite splits and, if there is one only, its sid.

    ``required`` leaves out splits that have none.
    """
    counted = join_facts(splits, side_counts(splits), "tid").select(
        "sid",
        "tid",
        "kind",
        opposite("count").alias("opposite_count"),
        F.when(opposite("count") == 1, opposite("sid")).alias("opposite_sid"),
    )
    return counted.filter("opposite_count > 0") if required else counted
