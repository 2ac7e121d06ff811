"""The registered queries and their SQL."""

from . import activity, columns, merges, pages, search, streams, tagging  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
