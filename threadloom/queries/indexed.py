"""Searches that read a stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import index
from threadloom.queries.registry import query
from threadloom.queries.surfaces import _TOK
from threadloom.tables import shared_folder

_ALL = _TOK.replace("substr(content, 1, 200000)", "content")


def _indexed(rows: DataFrame, key: str = "document_id") -> index.TextIndex:
    return index.write_index(rows, f"{shared_folder(rows.sparkSession)}/index-{uuid.uuid4().hex}", key=key)


@query(
    "docs",
    f""", t AS (SELECT document_id, {_ALL} AS t FROM docs)
    SELECT 'all' AS search, document_id FROM t WHERE list_has_all(t, ['the', 'of', 'and'])
    UNION ALL SELECT 'boolean', document_id FROM t WHERE list_contains(t, 'the') AND contains(concat(' ', array_to_string(t, ' '), ' '), ' of the ') AND list_has_any(t, ['and', 'with']) AND NOT list_has_any(t, ['was'])""",
)
def n16_search_index(docs):
    held = _indexed(docs)
    both = index.match_all(held, "The of, and of").select(F.lit("all").alias("search"), "id")
    chosen = index.match_boolean(held, ["the"], ["of the"], ["and", "with"], ["was"]).select(F.lit("boolean").alias("search"), "id")
    return both.unionByName(chosen).withColumnRenamed("id", "document_id")


@query(
    "messages",
    f""", t AS (SELECT message_id, {_ALL} AS t FROM messages), h AS (SELECT message_id, unnest(t) AS token, unnest(range(len(t))) AS place FROM t WHERE list_has_all(t, ['the', 'of'])),
    w AS (SELECT *, row_number() OVER o AS nth FROM h WHERE token IN ('the', 'of') WINDOW o AS (PARTITION BY message_id ORDER BY place)),
    l AS (SELECT *, max(CASE WHEN token = 'the' THEN place END) OVER o AS a, max(CASE WHEN token = 'of' THEN place END) OVER o AS b,
                 max(CASE WHEN token = 'the' THEN nth END) OVER o AS c, max(CASE WHEN token = 'of' THEN nth END) OVER o AS d FROM w WINDOW o AS (PARTITION BY message_id ORDER BY place)),
    s AS (SELECT message_id, place, nth, least(a, b) AS begin, least(c, d) AS first, lag(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END) OVER (PARTITION BY message_id ORDER BY place) AS before
          FROM l QUALIFY a IS NOT NULL AND b IS NOT NULL)
    SELECT message_id, round(sum(0.1::double / (1 + place - begin - (nth - first))), 9) AS density FROM s WHERE before IS NULL OR begin > before GROUP BY message_id""",
)
def h5_indexed_cover_density(messages):
    found = index.cover_density(_indexed(messages, "message_id"), "the of")
    return found.select(F.col("id").alias("message_id"), F.round("density", 9).alias("density"))
