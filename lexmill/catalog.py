"""All registered queries and their SQL."""

from lexmill.plans import corpus_queries, evidence_queries, linking_queries, retrieval_queries, scoring_queries, search_queries, source_queries, text_queries  # noqa: F401
from lexmill.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
