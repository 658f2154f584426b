"""All registered queries of the reference operators, and their SQL twins."""

from __future__ import annotations

from pricewell.plans import file_queries, market_queries, more_queries, search_queries, stream_queries, table_queries

MODULES = (market_queries, table_queries, search_queries, stream_queries, more_queries, file_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
