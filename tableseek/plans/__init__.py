"""Registered queries: importing the modules fills the registry."""

from tableseek.plans import (  # noqa: F401
    batch_queries,
    corpus_queries,
    io_queries,
    lineage_queries,
    profile_queries,
    relation_queries,
    retrieval_queries,
    sampling_queries,
    text_queries,
)
from tableseek.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
