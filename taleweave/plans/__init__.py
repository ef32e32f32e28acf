"""Queries of the operators over the tables, and their SQL twins."""

from taleweave.plans import books, jobs, streams, text, timeline
from taleweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "books", "jobs", "streams", "text", "timeline"]
