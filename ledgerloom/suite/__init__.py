"""All registered queries."""

from __future__ import annotations

from ledgerloom.suite import aggregates, flows, joins, predicates, sources, warehouse_sql, windows  # noqa: F401
from ledgerloom.suite.core import QUERIES

__all__ = ["QUERIES"]
