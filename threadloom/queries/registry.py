"""The registry of queries: functions over views of the given tables, and SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.bindings import VIEWS, bind, bind_stream, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(views: str, oracle: str | None = None, reader: Callable[[SparkSession, str, str], DataFrame] = bind):
    """Register a function of the named views, and SQL in which ``{view}`` stands for a view."""
    names = views.split()

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[reader(spark, sf_dir, v) for v in names])
        if oracle:
            parts = [f"{v} AS ({sql(v)})" for v in names if v in VIEWS]
            ORACLE_SQL[f.__name__] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + oracle
        return f

    return register


def stream_query(view: str, oracle: str | None = None):
    """Like ``query``, of a view of the tables' files as a stream; the function returns a table of results."""
    return query(view, oracle, bind_stream)
