"""Every registered query over the given tables, with the SQL that checks it."""

from __future__ import annotations

from stoopwise.catalog.registry import all_queries

__all__ = ["all_queries"]
