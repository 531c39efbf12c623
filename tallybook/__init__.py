"""Double-entry ledger analytics as Spark DataFrame jobs."""

from tallybook.ledger import Ledger, Staged

__all__ = ["Ledger", "Staged"]
