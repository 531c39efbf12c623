"""Change sets: a ledger as another one and what differs, and the checks that only look at that.

The ledger a change set starts from is taken to be sound and balanced, as a published version is. Then
whatever can be wrong afterwards meets a changed row or a deleted key, and only transactions whose
splits were touched can be off balance. Reads of the large tables are cut by the least and greatest
key and joined with the keys before anything is grouped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.ledger import Change, Ledger
from tallybook.operators.checks import VIOLATIONS, imbalances, lost_references, repeated_keys, validate_table
from tallybook.operators.scopes import in_keys, not_in_keys
from tallybook.sources.schema import KEYS

#: Columns of the splits that refer to another table.
PARENTS = {"aid": "accounts", "tid": "transactions"}


def replaced_keys(name: str, change: Change) -> DataFrame:
    """Keys of a table whose rows are no longer those of the first ledger; new ones among them."""
    key = KEYS[name]
    return change.rows.select(key).unionByName(change.gone.select(key)).distinct()


def merged(base: Ledger, changes: dict[str, Change]) -> Ledger:
    """The ledger after the changes, put together when it is read."""
    if not changes:
        return base
    return base.stage(
        merged=True,
        **{
            name: not_in_keys(getattr(base, name), KEYS[name], replaced_keys(name, change)).unionByName(change.rows)
            for name, change in changes.items()
        },
    )


def near_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``key`` is wanted; files that end before the least or begin after the greatest are skipped.

    A job finds the two: scans are only cut by values that are known when they are planned.
    """
    low, high = keys.agg(F.min(key), F.max(key)).first()
    return in_keys(df.filter(F.lit(False) if low is None else F.col(key).between(low, high)), key, keys)


def change_problems(base: Ledger, changes: dict[str, Change]) -> DataFrame:
    """What ``validate_schema`` and ``validate_keys`` would find on the merged ledger, if ``base`` is sound.

    New and changed rows are judged whole; their keys are counted among themselves, as a merged row replaces the one
    it shares its key with. References are looked up for changed splits, and for deleted accounts and
    transactions the splits that still point at them.
    """
    after = merged(base, changes)
    parts = [base.splits.sparkSession.createDataFrame([], VIOLATIONS)]
    for name, change in changes.items():
        parts += [validate_table(name, change.rows), repeated_keys(name, change.rows.groupBy(KEYS[name]).count())]
    splits = changes.get("splits")
    for column, parent in PARENTS.items():
        if splits is not None:
            used = splits.rows.select(column).distinct()
            known = near_keys(getattr(after, parent).select(column), column, used)
            parts.append(lost_references(splits.rows, column, used.join(known, column, "left_anti")))
        if parent in changes:
            # a key may be deleted and taken again
            gone = not_in_keys(changes[parent].gone.select(column).distinct(), column, changes[parent].rows)
            left = near_keys(base.splits, column, gone)
            if splits is not None:
                left = not_in_keys(left, "sid", replaced_keys("splits", splits))
            parts.append(lost_references(left, column, gone))
    return reduce(DataFrame.unionByName, parts)


def change_imbalances(base: Ledger, changes: dict[str, Change]) -> DataFrame:
    """Transactions that are off balance after the changes, among those with a split that is new, changed or gone."""
    splits = changes.get("splits")
    if splits is None:
        return imbalances(base.stage(splits=base.splits.limit(0)))
    was = near_keys(base.splits.select("sid", "tid"), "sid", replaced_keys("splits", splits))
    touched = was.select("tid").unionByName(splits.rows.select("tid")).distinct()
    after = merged(base.stage(splits=near_keys(base.splits, "tid", touched)), {"splits": splits})
    return imbalances(after)
