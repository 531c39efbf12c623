"""Numbering rows without gaps, in an order, by as many tasks as there are.

Values are cut into digits. Rows are counted by all digits but the last, by all but the last two, and so on;
a row's number is the sum, over its digits, of the rows that agree in the digits before and are lower in
this one. Every window runs over one digit of one group, so it holds at most ``1 << BITS`` rows, whatever
the values are. Nothing is sampled, so the numbers are the same whenever they are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a digit; three digits make a long.
BITS = 22
#: Rows that one row is multiplied into at a time.
_CHUNK = 1 << 16


def _digits(value: Column) -> list[Column]:
    """The digits of a long, highest first; the first has its sign."""
    low = F.lit((1 << BITS) - 1).cast("long")
    return [F.shiftright(value, 2 * BITS), F.shiftright(value, BITS).bitwiseAND(low), value.bitwiseAND(low)]


def numbered_groups(counted: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Add ``number``: how many rows come before the group, where ``counted`` has one row per group and its ``count``.

    Groups are ordered by ``columns``, which are longs.
    """
    digits = [d for c in columns for d in _digits(F.coalesce(F.col(c), F.lit(0)).cast("long"))]
    names = [f"digit_{i}" for i in range(len(digits))]
    level = counted.withColumns(dict(zip(names, digits, strict=True)))
    levels = []
    for depth in range(len(names) - 1, -1, -1):
        lower = Window.partitionBy(*names[:depth]).orderBy(names[depth]).rowsBetween(Window.unboundedPreceding, -1)
        levels.append(level.withColumn("lower", F.coalesce(F.sum("count").over(lower), F.lit(0))))
        level = level.groupBy(*names[:depth]).agg(F.sum("count").alias("count"))
    number = levels.pop().withColumnRenamed("lower", "number")
    for depth in range(1, len(names)):
        above = number.select(*names[:depth], "number")
        level = levels.pop().join(above, names[:depth])
        number = level.withColumn("number", F.col("number") + F.col("lower")).drop("lower")
    return number.drop(*names)


def numbered(rows: DataFrame, *columns: str) -> DataFrame:
    """The ``columns`` of all rows with ``number``, from 0 without gaps, in the order of the columns, which are longs.

    Rows that agree in all columns are one row and their count until they are numbered, so many equal rows burden no task.
    """
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
    groups = numbered_groups(counted, columns)
    chunks = groups.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(_CHUNK).cast("long"))))
    # the chunks of a large group go to different tasks
    chunks = chunks.repartition(*columns, "at")
    each = F.explode(F.sequence("at", F.least(F.col("at") + _CHUNK, F.col("count")) - 1))
    return chunks.select(*columns, "number", each.alias("place")).select(*columns, (F.col("number") + F.col("place")).alias("number"))
