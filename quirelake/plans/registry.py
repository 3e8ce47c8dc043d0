"""Registered queries of the document engine and their SQL statements."""

from __future__ import annotations

from quirelake.plans import book_queries, layout_queries, repair_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (layout_queries, repair_queries, book_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
