"""All named queries with their oracle SQL."""

from clickloom.registry import groups, ordered, scores, tables  # noqa: F401
from clickloom.registry.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
