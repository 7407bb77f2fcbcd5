"""All queries of the library outside llm, with their SQL."""

from __future__ import annotations

from redactlake.plans import extensions, layout, lookups, pages, pixels, structure, texts, time_based  # noqa: F401  (they register themselves)
from redactlake.plans import media as media_plans  # noqa: F401
from redactlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
