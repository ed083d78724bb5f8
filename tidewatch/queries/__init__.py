"""All registered queries. Importing a module registers its queries."""

from tidewatch.queries import analyst, decisions, evaluation, features, keyed, lifecycle, monitoring, quality, streams, summaries  # noqa: F401
from tidewatch.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
