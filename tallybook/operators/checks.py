"""Data checks: column contract, keys and references, and the balance gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import signed_sum
from tallybook.ledger import Ledger
from tallybook.sources.schema import ACCOUNT_KINDS, KEYS, SPLIT_KINDS, TABLES, TOTAL

DOMAINS = {("accounts", "kind"): ACCOUNT_KINDS, ("splits", "kind"): SPLIT_KINDS}
# Fixed value: why an unbalanced ledger is refused.
IMBALANCE_MESSAGE = "Imbalances will prevent commit from succeeding."

VIOLATIONS = "table_name string, key long, column_name string, problem string, found string"


class Refused(Exception):
    """A ledger that must not be published."""


class Conflict(Refused):
    """A ledger made from a version of its book that is no longer the newest one."""


def _type_problems(table: str, df: DataFrame) -> list[tuple]:
    """Columns that are absent or of another type; read off the schema, no job runs."""
    found = {f.name: f.dataType for f in df.schema}
    problems = []
    for field in TABLES[table]:
        if field.name not in found:
            problems.append((table, None, field.name, "missing column", None))
        elif found[field.name] != field.dataType:
            problems.append((table, None, field.name, "incompatible type", found[field.name].simpleString()))
    return problems


def validate_table(table: str, df: DataFrame) -> DataFrame:
    """Rows breaking the column contract of one table, one row per problem, in one scan."""
    bad_types = _type_problems(table, df)
    absent = {p[2] for p in bad_types if p[3] == "missing column"}

    def problem(column: str, text: str):
        return F.struct(
            F.lit(column).alias("column_name"),
            F.lit(text).alias("problem"),
            F.col(column).cast("string").alias("found"),
        )

    tests = []
    for field in TABLES[table]:
        if field.name in absent:
            continue
        if not field.nullable:
            tests.append(F.when(F.col(field.name).isNull(), problem(field.name, "unexpected null")))
        domain = DOMAINS.get((table, field.name))
        if domain:
            tests.append(F.when(~F.col(field.name).isin(*domain), problem(field.name, "not in domain")))

    key = KEYS[table]
    key_value = F.lit(None) if key in absent else F.col(key)
    rows = df.select(key_value.cast("long").alias("key"), F.explode(F.array_compact(F.array(*tests))).alias("p"))
    rows = rows.select(F.lit(table).alias("table_name"), "key", "p.*")
    if bad_types:
        rows = rows.unionByName(df.sparkSession.createDataFrame(bad_types, VIOLATIONS))
    return rows


def validate_schema(ledger: Ledger) -> DataFrame:
    """Violations of the column contract in all three tables; empty when the ledger is sound."""
    parts = [validate_table(t, getattr(ledger, t)) for t in TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def repeated_keys(table: str, counted: DataFrame) -> DataFrame:
    """The keys of a table that come more than once; ``counted`` has the key and its ``count``."""
    key = KEYS[table]
    return counted.filter("count > 1").select(
        F.lit(table).alias("table_name"),
        F.col(key).alias("key"),
        F.lit(key).alias("column_name"),
        F.lit("repeated key").alias("problem"),
        F.col("count").cast("string").alias("found"),
    )


def lost_references(splits: DataFrame, column: str, lost: DataFrame) -> DataFrame:
    """The splits whose ``column`` is one of the ``lost`` keys, which have no row."""
    return splits.join(lost.select(column), column, "left_semi").select(
        F.lit("splits").alias("table_name"),
        F.col("sid").alias("key"),
        F.lit(column).alias("column_name"),
        F.lit("no such row").alias("problem"),
        F.col(column).cast("string").alias("found"),
    )


def validate_keys(ledger: Ledger) -> DataFrame:
    """Repeated keys, and splits that point at no account or no transaction.

    Dearer than ``validate_schema``: the keys of each table are counted across the cluster once,
    and the counts of accounts and transactions also answer which references exist.
    """
    counted = {t: getattr(ledger, t).groupBy(key).count() for t, key in KEYS.items()}
    parts = [repeated_keys(table, counted[table]) for table in KEYS]
    for column, parent in (("aid", "accounts"), ("tid", "transactions")):
        # references are brought down to one row per key before they meet their table
        used = ledger.splits.groupBy(column).agg(F.count(F.lit(1)).alias("uses"))
        parts.append(lost_references(ledger.splits, column, used.join(counted[parent], column, "left_anti")))
    return reduce(DataFrame.unionByName, parts)


def imbalances(ledger: Ledger) -> DataFrame:
    """Transactions whose splits do not add up to zero; one without splits does."""
    return ledger.splits.groupBy("tid").agg(signed_sum().alias("s")).filter(F.col("s") != 0)


def commit_gate(ledger: Ledger) -> DataFrame:
    """One row: may the ledger be published, how many transactions are off, and by how much."""
    return imbalances(ledger).agg(
        (F.count(F.lit(1)) == 0).alias("ok"),
        F.count(F.lit(1)).alias("imbalanced"),
        F.coalesce(F.sum("s"), F.lit(0)).cast(TOTAL).alias("off_by"),
    )


def refuse_imbalances(found: DataFrame) -> None:
    """Raise if a transaction is off balance."""
    if not found.isEmpty():
        raise Refused(IMBALANCE_MESSAGE)


def refuse_problems(*found: DataFrame) -> None:
    """Raise if there is a violation, naming one."""
    for problems in found:
        for worst in problems.take(1):
            raise Refused("Invalid ledger: {table_name}.{column_name}: {problem}".format(**worst.asDict()))


def require_balanced(ledger: Ledger) -> None:
    """Raise unless the splits of every transaction add up to zero."""
    refuse_imbalances(imbalances(ledger))


def require_valid(ledger: Ledger) -> None:
    """Raise when a row breaks the column contract, repeats a key or points nowhere, naming one such row."""
    refuse_problems(validate_schema(ledger), validate_keys(ledger))


def require_no_fatal(rejects: DataFrame | None) -> None:
    """Raise when a batch of edits met an error that stops work until it is rolled back."""
    worst = [] if rejects is None else rejects.filter("fatal").take(1)
    if worst:
        raise Refused(worst[0]["reason"])
