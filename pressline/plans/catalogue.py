"""All queries of the engine, by name, with their oracle SQL."""

from __future__ import annotations

from pressline.plans import content, feeds, ingest, operations, stateful
from pressline.plans.feeds import flagship

_ALL = {**feeds.QUERIES, **operations.QUERIES, **content.QUERIES, **stateful.QUERIES, **ingest.QUERIES}

__all__ = ["flagship", "oracle_sql", "queries"]


def queries():
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql():
    return {name: text for name, (_, text) in _ALL.items() if text}
