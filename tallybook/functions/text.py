"""Labels, clipping, name defaults, pattern matching and the parsers of edited text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.sources.schema import CASH_ACCOUNT, CASH_ANYWHERE, MONEY

# The word shown for NULL, and the words for the kind of a split.
NULL_LABEL = "None"
CREDIT_WORDS = ("credit", "c", "")
DEBIT_WORDS = ("debit", "d")


def null_label(value: Column) -> Column:
    """NULL as a visible word."""
    return F.coalesce(value, F.lit(NULL_LABEL))


def label_to_null(value: Column) -> Column:
    """The visible word for NULL back to NULL."""
    return F.nullif(value, F.lit(NULL_LABEL))


def clip_text(value: Column, size: int) -> Column:
    """At most ``size`` characters, the last three of a cut text being dots."""
    cut = F.concat(F.substring(value, 1, size - 3), F.lit("..."))
    return F.when(F.length(value) > size, cut).otherwise(value)


def default_account_name(aid: Column) -> Column:
    """``account_0042``; an id of more than four digits shows as ``####``."""
    digits = F.when(aid > 9999, F.lit("####")).otherwise(F.lpad(aid.cast("string"), 4, "0"))
    return F.concat(F.lit("account_"), digits)


def like(value: Column, pattern: str) -> Column:
    """LIKE where a backslash before an ordinary character is simply dropped.

    Spark refuses such a pattern; PostgreSQL lets it match the bare character.
    """
    return value.like(re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], pattern, flags=re.S))


def is_cash_account(name: Column) -> Column:
    """Belongs to the cash statement: the name starts with the cash word."""
    return like(name, CASH_ACCOUNT)


def mentions_cash(name: Column) -> Column:
    """Counts as cash on the other side of a transfer: the word stands anywhere."""
    return like(name, CASH_ANYWHERE)


def parse_split_kind(value: Column) -> Column:
    """Full word, first letter, or nothing (a credit); anything else gives NULL."""
    return F.when(value.isin(*CREDIT_WORDS), F.lit("credit")).when(value.isin(*DEBIT_WORDS), F.lit("debit"))


def parse_amount(value: Column) -> Column:
    """Decimal text, exponent allowed, rounded to cents; anything else gives NULL."""
    shaped = value.rlike(r"^\s*[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$")
    return F.when(shaped, F.trim(value).try_cast(MONEY))


def parse_tid(value: Column) -> Column:
    """Whole-number text; anything else gives NULL."""
    return F.when(value.rlike(r"^\s*-?[0-9]+\s*$"), F.trim(value).try_cast("bigint"))


def parse_date(value: Column) -> Column:
    """Year-month-day text; anything else gives NULL."""
    shaped = value.rlike(r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s*$")
    return F.when(shaped, F.trim(value).try_cast("date"))


def kind_rank(kind: Column, order: tuple[str, ...]) -> Column:
    """Position of a kind in its declared order, for sorting."""
    return F.array_position(F.array(*[F.lit(k) for k in order]), kind)
