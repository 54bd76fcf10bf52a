"""Queries of what texts and records tell of."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import detect
from threadloom.queries.registry import query


@query(
    "docs",
    """SELECT document_id, CASE document_id % 4 WHEN 0 THEN concat('a/', project, '.canvas.tsx|', project, ';b/two.CANVAS.tsx|two') WHEN 1 THEN concat('x/', project, ' y.canvas.tsx|', project, ' y') ELSE '' END AS artifacts FROM docs""",
)
def i14_detect_artifacts(docs):
    said = F.when(F.col("document_id") % 4 == 0, F.concat(F.lit("see b/two.CANVAS.tsx [it](a/"), "project", F.lit(".canvas.tsx#top) and A/"), F.upper("project"), F.lit(".canvas.tsx ")))
    said = said.when(F.col("document_id") % 4 == 1, F.concat(F.lit("[x](file://x/"), "project", F.lit("%20y.canvas.tsx) ../up/no.canvas.tsx "))).when(F.col("document_id") % 4 == 2, F.lit("[../up.canvas.tsx](page) ftp://h/f.canvas.tsx "))
    found = detect.detect_artifacts(F.concat(F.coalesce(said, F.lit("")), "content"))
    return docs.select("document_id", F.array_join(F.transform(found, lambda a: F.concat_ws("|", a["path"], a["name"])), ";").alias("artifacts"))


@query(
    "docs",
    """, g AS (SELECT *, cast(floor(document_id / 8) AS bigint) AS session FROM docs),
    n AS (SELECT document_id, tool_id, session, CASE document_id % 4 WHEN 0 THEN project WHEN 1 THEN 'myapp' WHEN 2 THEN 'given' END AS own FROM g),
    t AS (SELECT tool_id, session, min(own) AS theirs FROM n WHERE own IS NOT NULL GROUP BY ALL)
    SELECT document_id, coalesce(own, theirs) AS project FROM n LEFT JOIN t USING (tool_id, session)""",
)
def i11_infer_project(docs):
    kind = F.col("document_id") % 4
    content = F.when(kind == 0, F.concat(F.lit('{"cwd": "C:\\\\work\\\\'), "project", F.lit('\\\\"} '), "content")).otherwise(F.col("content"))
    rows = docs.withColumns({
        "content": content, "category": F.lit("conversation"), "machine_id": F.lit(1), "session_id": F.floor(F.col("document_id") / 8).cast("string"),
        "project_hash": F.when(kind == 0, "-Users-me-elsewhere").when(kind == 1, "C--Users-me-myapp").when(kind == 2, " given "),
    })
    return detect.infer_project(rows)
