"""Queries over the sample tables, each with its SQL twin where SQL can say it."""

from gleaner.queries import config, digests, extraction, feeds, items, scalars, schedule, streams
from gleaner.queries.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "config", "digests", "extraction", "feeds", "items", "scalars",
    "schedule", "streams",
]
