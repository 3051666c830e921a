"""The SQL-like front end: text to plan."""

from .query import SqlQuery, parse

__all__ = ["SqlQuery", "parse"]
