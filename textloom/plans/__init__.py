"""All named queries of the engine itself."""

from textloom.plans import keyed, language, numbers, search, web  # noqa: F401
from textloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
