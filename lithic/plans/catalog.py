"""All registered queries: importing a module of plans registers what it holds."""

from __future__ import annotations

from lithic.plans import answers, driver, evaluation, ingestion, learning, reading, registry, retrieval, stores, tabular  # noqa: F401
from lithic.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
