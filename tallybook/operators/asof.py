"""Running totals as of a date.

All splits of one day share their day's total, so the movements are first summed
per day. That sum combines on the map side, and leaves at most one row per
calendar day (and account): even an account that holds a third of all splits
reaches the window as some thousand rows. The detail rows then pick up their
day's running total by an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.money import total
from tallybook.sources.schema import MONEY, TOTAL


def running_totals(
    movements: DataFrame,
    measures: dict[str, Column],
    by: tuple[str, ...] = (),
    probes: DataFrame | None = None,
    opening: DataFrame | None = None,
) -> DataFrame:
    """Per day (and ``by`` key), each measure summed over that day and all before it.

    ``probes`` are further days that want an answer although nothing moves on
    them: before the first movement it is zero, after the last the full total.
    ``opening`` has totals to start from, as rows of a day before all movements.
    """
    keys = [*by, "date"]
    parts = movements.select(*keys, *[m.cast(MONEY).alias(name) for name, m in measures.items()])
    if probes is not None:
        nothing = [F.lit(0).cast(MONEY).alias(name) for name in measures]
        parts = parts.unionByName(probes.select(*keys, *nothing))
    days = parts.groupBy(*keys).agg(*[total(F.col(name)).alias(name) for name in measures])
    if opening is not None:
        days = days.unionByName(opening.select(*days.columns))
    # Without a ``by`` key all days meet in one task: at most 3.65 million rows,
    # the days between the years 1 and 9999.
    upto = Window.partitionBy(*by).orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return days.select(*keys, *[F.sum(name).over(upto).cast(TOTAL).alias(name) for name in measures])


def attach(detail: DataFrame, totals: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Give every detail row its day's running totals; none means zero."""
    keys = [*by, "date"]
    measures = [c for c in totals.columns if c not in keys]
    # Totals over everything are one row per calendar day: some 64 bytes for each of at
    # most 3.65 million days, and less than a megabyte for a lifetime of them. That bounds
    # the broadcast, and no detail row is shuffled. Totals per account are left to Spark.
    side = totals if by else F.broadcast(totals)
    joined = detail.join(side, keys, "left")
    return joined.withColumns({m: F.coalesce(F.col(m), F.lit(0)).cast(TOTAL) for m in measures})
