"""All registered queries of the engine's own operators."""

from __future__ import annotations

from boardlark.plans import queries_data, queries_literal, queries_search  # noqa: F401  their import registers them
from boardlark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
