"""Registered queries of the core and their SQL."""

from __future__ import annotations

from codequarry.plans import fixtures, relational, rows, textual
from codequarry.plans.registry import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for _module in (rows, relational, textual, fixtures):
    QUERIES |= _module.R.queries
    SQL |= _module.R.sql
