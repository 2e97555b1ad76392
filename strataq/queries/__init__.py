"""The registered queries of the core operators."""

from strataq.queries import front, graphs, kvs, relational, search, spacetime
from strataq.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "front", "graphs", "kvs", "relational", "search", "spacetime"]
