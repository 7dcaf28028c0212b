"""All queries of the library by name, and their SQL."""

from tidemark.plans import records  # noqa: F401  registers its queries
from tidemark.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
