"""All queries and their SQL."""

from namewright.plans import concepts, exports, lookups, merging  # noqa: F401  each registers its queries
from namewright.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
