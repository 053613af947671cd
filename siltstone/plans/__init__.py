"""The registered plans of the engine."""

from ..registry import PLANS, SQL
from . import agreement_queries, evaluation_queries, parser_queries, record_queries, retrieval_queries, service_queries, text_queries  # noqa: F401

__all__ = ["PLANS", "SQL"]
