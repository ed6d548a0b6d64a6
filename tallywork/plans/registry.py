"""Every registered market query and, where SQL can express it, its SQL."""

from __future__ import annotations

from . import curriculum_queries, forecast_queries, insight_queries, market_queries, page_queries, part_queries, phrase_queries, run_queries, state_queries, text_queries, view_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (market_queries, forecast_queries, text_queries, view_queries, curriculum_queries, phrase_queries, insight_queries, state_queries, page_queries, run_queries, part_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
