"""Runnable queries over the given tables."""

from talkmine.plans import claims, corpus, ingest, neighbors, people, search, transcripts  # noqa: F401
from talkmine.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
