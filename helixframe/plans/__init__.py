"""Queries over derived tables, with their SQL."""

from . import io_queries
from .queries import QUERIES

__all__ = ["QUERIES", "io_queries"]
