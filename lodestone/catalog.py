"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from lodestone.plans import stored, upkeep  # noqa: F401
from lodestone.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
