"""Registered queries of the library."""

from __future__ import annotations


def registered():
    """(queries, oracle SQL), by name."""
    from clausegraph.plans import answer_queries, clause_queries, closure_queries, context_queries, eval_queries, fusion_queries, graph_queries, phrase_queries, pool_queries, review_queries, rule_queries, small_queries, text_queries  # noqa: F401  they register themselves
    from clausegraph.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
