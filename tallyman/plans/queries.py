"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401
    access_queries,
    analytics_queries,
    event_queries,
    intake_queries,
    inventory_queries,
    legacy_queries,
    mutation_queries,
)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
