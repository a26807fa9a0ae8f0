"""Registered queries of the retrieval and curation operators, with SQL twins."""

from corpusforge.queries import catalog, corpus, graphs, points, retrieval, stores, syncing, tables  # noqa: F401
from corpusforge.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
