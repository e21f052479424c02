"""Registered queries over the test tables."""

from __future__ import annotations

from plumbline.plans.queries import FLAGSHIP, oracle_sql, queries

__all__ = ["FLAGSHIP", "oracle_sql", "queries"]
