"""Registered queries over the given tables, each with its SQL equivalent where one exists."""

from catalog import features, models, pages, sources, sql_surface, text, words  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
