"""All queries of the document engine and their SQL."""

from folio.plans import books, fixtures, streams, texts, units  # noqa: F401
from folio.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
