"""All queries of the core, with their SQL."""

from __future__ import annotations

from ledgerloom.plans import core_data, pair_queries, portfolio

QUERIES = core_data.QUERIES | portfolio.QUERIES | pair_queries.QUERIES
ORACLES: dict[str, str] = portfolio.ORACLES | pair_queries.ORACLES
