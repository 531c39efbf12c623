"""Joining rows with per-key facts when a few keys own a large part of the rows.

Adaptive execution splits a hot partition only where both sides of the join come straight from
a shuffle made for that join. Facts that were aggregated by the join key are already laid out
by it, so Spark would not shuffle them again, and the rows of a hot key would stay together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def laid_out_anew(facts: DataFrame, *keys: str) -> DataFrame:
    """``facts`` with their layout by the keys forgotten, so that a join on them shuffles them itself.

    A key makes a detour that does not change it but that hides where it came from.
    """
    for key in keys:
        facts = _detoured(facts, key)
    return facts


def _detoured(facts: DataFrame, key: str) -> DataFrame:
    if isinstance(facts.schema[key].dataType, StringType):
        return facts.withColumn(key, F.concat(F.col(key), F.lit("")))
    return facts.withColumn(key, F.col(key).cast("string").cast(facts.schema[key].dataType))


def join_facts(rows: DataFrame, facts: DataFrame, key: str | tuple[str, ...], how: str = "left") -> DataFrame:
    """Join ``rows`` with ``facts``, which has one row per ``key``, a column or several.

    Building the join reads nothing. A key that holds a large part of the rows, or rows without a
    key, are split at run time; small facts are sent along, as Spark measures them.
    """
    keys = (key,) if isinstance(key, str) else key
    return rows.join(laid_out_anew(facts, *keys), list(keys), how)


def join_some_facts(rows: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Left join of ``rows`` with facts by several keys, of which a row has at most one.

    Only the rows that have a key are shuffled by it; the others pass by, instead of meeting as the rows of no key.
    """
    none = reduce(lambda a, b: a & b, [F.col(key).isNull() for key in facts])
    parts = [join_facts(rows.filter(F.col(key).isNotNull()), found, key) for key, found in facts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, rows.filter(none))
