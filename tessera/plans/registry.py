"""The registered queries of the engine and their DuckDB texts."""

from __future__ import annotations

from . import answer_queries, eval_queries, search_queries, state_queries, text_queries  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
