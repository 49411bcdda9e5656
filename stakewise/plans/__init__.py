"""The registered queries and their SQL."""

from stakewise.plans import builders, decisions, relational, sequential, smooths, sources, statistics, streams
from stakewise.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "builders", "decisions", "relational", "sequential", "smooths", "sources", "statistics", "streams"]
