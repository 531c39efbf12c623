"""Balances stored ahead, so that an opening balance does not read all history before it.

Sums are kept in blocks of a year: what each account had moved before the year (``month`` 0), for every year
after its first one up to the one after the book's last, and what it moved in each month of the year.
Totals before a month are then the block's opening and the months before that one: at most thirteen rows an
account, in the files of one year. The table grows with accounts times years, not with splits.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.money import amount_of, signed_amount, total
from tallybook.ledger import Ledger
from tallybook.operators.joins import dated_splits
from tallybook.operators.skew import join_facts
from tallybook.sources.schema import CHECKPOINTS, TOTAL

#: What is summed, named as in the reports.
MEASURES = ("balance", "debit_balance", "credit_balance")


def build_checkpoints(ledger: Ledger) -> DataFrame:
    """Openings of years and sums of months, per account; splits combine before they are shuffled."""
    measures = dict(zip(MEASURES, (signed_amount(), amount_of("debit"), amount_of("credit")), strict=True))
    moves = dated_splits(ledger).select(
        "aid", F.year("date").alias("year"), F.month("date").alias("month"), *[m.alias(n) for n, m in measures.items()]
    )
    months = moves.groupBy("aid", "year", "month").agg(*[total(F.col(m)).alias(m) for m in MEASURES])
    years = months.groupBy("aid", "year").agg(*[F.sum(m).cast(TOTAL).alias(m) for m in MEASURES])
    by_year = Window.partitionBy("aid").orderBy("year")
    upto = by_year.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = ledger.transactions.agg(F.max(F.year("date"))).scalar()
    # what was moved up to a year opens those after it, up to the next one with moves
    opened = F.sequence(F.col("year") + 1, F.coalesce(F.lead("year").over(by_year), last + F.lit(1)))
    openings = years.select(
        "aid", opened.alias("years"), *[F.sum(m).over(upto).cast(TOTAL).alias(m) for m in MEASURES]
    ).select("aid", F.explode("years").alias("year"), F.lit(0).alias("month"), *MEASURES)
    return openings.unionByName(months).select(*CHECKPOINTS.names)


def month_of(date) -> dt.date:
    """The first day of a date's month."""
    return dt.date.fromisoformat(str(date)[:10]).replace(day=1)


def openings_before(checkpoints: DataFrame, month: dt.date) -> DataFrame:
    """Totals of each account before ``month``, a first day, as rows of the day before it; one year is read."""
    last = checkpoints.agg(F.max("year")).scalar()
    block = checkpoints.filter(F.col("year") == F.least(F.lit(month.year), last))
    before = block.filter((F.col("year") < month.year) | (F.col("month") < month.month))
    day = F.lit(month - dt.timedelta(days=1)).cast("date") if month > dt.date.min else F.lit(month)
    sums = before.groupBy("aid").agg(*[F.sum(m).cast(TOTAL).alias(m) for m in MEASURES])
    return sums.withColumn("date", day)


def openings_of(checkpoints: DataFrame, wanted: DataFrame) -> DataFrame:
    """Totals before each ``wanted`` (aid, first), ``first`` being the first day of a month; rows of the day before.

    Only the years that are wanted are read, as Spark prunes them when it knows them.
    """
    asked = wanted.select("aid", "first", F.year("first").alias("year"), F.month("first").alias("upto"))
    met = asked.join(checkpoints, ["aid", "year"]).filter(F.col("month") < F.col("upto"))
    sums = met.groupBy("aid", "first").agg(*[F.sum(m).cast(TOTAL).alias(m) for m in MEASURES])
    return sums.withColumn("date", F.date_sub("first", 1))


def moves_of_months(moves: DataFrame, wanted: DataFrame) -> DataFrame:
    """Dated splits of the wanted (aid, first) months, with ``first``; none before the earliest is read."""
    earliest, latest = (wanted.agg(f("first")).scalar() for f in (F.min, F.max))
    near = moves.filter((F.col("date") >= earliest) & (F.col("date") <= F.last_day(latest)))
    return join_facts(near.withColumn("first", F.trunc("date", "month")), wanted.select("aid", "first"), ("aid", "first"), "left_semi")
