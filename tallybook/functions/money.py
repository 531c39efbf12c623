"""Signs, sums and the fixed-width text of money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.sources.schema import TOTAL


def signed_amount(kind: str = "kind", amount: str = "amount") -> Column:
    """Debits count up, credits count down."""
    return F.when(F.col(kind) == "credit", -F.col(amount)).otherwise(F.col(amount))


def amount_of(wanted: str, unless: Column | None = None) -> Column:
    """The amount of splits of one kind, zero for every other split."""
    keep = F.col("kind") == wanted
    if unless is not None:
        keep = keep & ~unless
    return F.when(keep, F.col("amount")).otherwise(F.lit(0))


def total(value: Column) -> Column:
    """Sum as money; no rows (or only NULLs) make zero."""
    return F.coalesce(F.sum(value), F.lit(0)).cast(TOTAL)


def signed_sum() -> Column:
    return total(signed_amount())


def debit_sum(unless: Column | None = None) -> Column:
    return total(amount_of("debit", unless))


def credit_sum(unless: Column | None = None) -> Column:
    return total(amount_of("credit", unless))


def money_text(value: Column, width: int = 5) -> Column:
    """Two decimals under a sign column and ``width`` integer places.

    The sign stands first (``-`` or a blank) and the number is padded behind it:
    -5.5 becomes ``-    5.50``. A number with more than ``width`` integer digits
    shows as ``#`` in every digit place.
    """
    rounded = value.cast(TOTAL)  # rounds half away from zero; nothing to do for sums
    size = F.abs(rounded)
    digits = F.lpad(size.cast("string"), width + 3, " ")
    body = F.when(size >= F.lit(10**width), F.lit("#" * width + ".##")).otherwise(digits)
    return F.concat(F.when(rounded < 0, F.lit("-")).otherwise(F.lit(" ")), body)
