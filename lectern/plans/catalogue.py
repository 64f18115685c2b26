"""Imports every module that registers queries."""

from lectern.plans import queries_agg, queries_catalog, queries_classify, queries_contracts, queries_evidence, queries_graph, queries_guards, queries_io, queries_join, queries_landed, queries_layout, queries_rank, queries_records, queries_relations, queries_state, queries_text  # noqa: F401
from lectern.plans.registry import QUERIES

__all__ = ["QUERIES"]
