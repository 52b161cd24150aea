"""Every registered query of the question bank, by name, with its DuckDB form."""

from __future__ import annotations

from lectern.plans import analytics_plans, bank_plans, quiz_plans, retrieval_plans, review_plans, segmentation_plans, stream_plans, text_plans  # noqa: F401
from lectern.plans.base import ORACLE, QUERIES  # noqa: F401

#: Hybrid search and its evaluation beside four other strategies.
FLAGSHIP = "A17_strategies"
