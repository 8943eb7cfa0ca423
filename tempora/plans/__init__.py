"""Importing the package registers every query."""

from . import queries, scan_queries, answer_queries  # noqa: F401
