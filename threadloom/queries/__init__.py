"""Queries of the library's operators over the given tables, and their SQL for another engine."""

from threadloom.queries import accounts, agents, contexts, detections, indexed, rebuilds, streams, surfaces, timelines
from threadloom.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "accounts", "agents", "contexts", "detections", "indexed", "rebuilds", "streams", "surfaces", "timelines"]
