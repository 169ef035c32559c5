"""Importing the catalog fills the registry."""

from tillwatch.catalog import incident_queries, policy_queries, stream_queries, text_queries  # noqa: F401
from tillwatch.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
