"""All registered queries and their oracles."""

from __future__ import annotations

from carsift.plans import catalog_pages, catalog_scoring, catalog_streams, catalog_tables, catalog_text  # noqa: F401
from carsift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
