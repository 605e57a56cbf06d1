"""All queries on the reference model, by name."""

from . import evaluations, families, hierarchies, lookups, measures, questions, selections, texts, timelines  # noqa: F401  they register their queries
from .registry import QUERIES

__all__ = ["QUERIES"]
