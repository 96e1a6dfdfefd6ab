"""Queries of the operators, and their SQL twins where SQL can say it."""

from gleaner.llm.queries import corpus, text
from gleaner.llm.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "text"]
