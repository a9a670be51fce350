"""Every registered query of the library, and its SQL twin."""

from lattica.plans import io_queries, rule_queries  # noqa: F401  (they register themselves)
from lattica.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
