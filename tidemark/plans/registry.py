"""All registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from tidemark.plans import experiment_queries, ledger_queries, market_queries, stream_queries, study_queries, text_queries, validation_queries  # noqa: F401
from tidemark.plans.base import ORACLES, QUERIES, result  # noqa: F401
