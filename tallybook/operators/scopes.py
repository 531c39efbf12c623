"""Scopes: which rows a report looks at.

A scope of keys is either a short list (it becomes an IN filter and reaches the
file scan) or a DataFrame of any size holding the key column (a semi join).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.ledger import Ledger
from tallybook.operators.skew import join_facts
from tallybook.session import shuffles_dropped


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or else the context's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return folder


Keys = DataFrame | Iterable[int] | None


def stored_keys(keys: Keys, key: str) -> Keys:
    """A frame of keys written once, each key once, for use in several scopes. Lists stay lists.

    What is read back has a known size, by which Spark decides whether to send it along.
    """
    if not isinstance(keys, DataFrame):
        return keys
    return stored_columns(keys.select(key).distinct())


def stored_columns(df: DataFrame) -> DataFrame:
    """A working copy in the folder the session names for them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallybook/scope-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_keys(df: DataFrame, key: str, keys: Keys) -> DataFrame:
    """Rows whose ``key`` is wanted; None means all of them."""
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        return join_facts(df, keys.select(key).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(list(keys)))


def not_in_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``key`` is not among ``keys``."""
    return join_facts(df, keys.select(key).distinct(), key, "left_anti")


def in_dates(start=None, end=None, column: str = "date") -> Column:
    """Half-open range of dates: ``start`` counts, ``end`` does not; None is open."""
    test = F.lit(True)
    if start is not None:
        test = test & (F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        test = test & (F.col(column) < F.lit(end).cast("date"))
    return test


def detail_of(child: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The detail rows of a set of parent rows."""
    return in_keys(child, key, parents)


def cut(ledger: Ledger, transactions: DataFrame) -> Ledger:
    """The ledger of some of its transactions, with all their splits."""
    kept = transactions.select("tid")
    return ledger.stage(
        transactions=transactions, splits=ledger.splits.join(kept, "tid", "left_semi")
    )


def zoom(ledger: Ledger, chosen: DataFrame) -> Ledger:
    """The transactions of some chosen splits, best a stored frame of known size, with all their splits."""
    tids = chosen.select("tid").distinct()
    return ledger.stage(
        transactions=ledger.transactions.join(tids, "tid", "left_semi"),
        splits=ledger.splits.join(tids, "tid", "left_semi"),
    )
