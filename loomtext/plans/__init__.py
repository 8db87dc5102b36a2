"""Registered queries with the SQL that gives the same rows."""

from . import aggregates, analysis, books, functions, more, relational
from .base import QUERIES, SQL, Tables, query

__all__ = ["QUERIES", "SQL", "Tables", "aggregates", "analysis", "books", "functions", "more", "query", "relational"]
