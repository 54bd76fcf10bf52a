"""Queries that repair stored timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import recovery
from threadloom.queries.registry import query


@query("prompt_sources prompt_history")
def c8_match_recovered_prompts(prompt_sources, prompt_history):
    return recovery.match_recovered_prompts(prompt_sources, prompt_history)


_NAME = "coalesce(nullif(trim(source_id), ''), concat(content, chr(0), cast(ts AS varchar)))"
_PLAIN = "message_type NOT IN ('agent_event', 'reasoning')"


@query(
    "parsed_rows stored_rows",
    f""", pa AS (SELECT *, count(*) OVER (PARTITION BY document_id, role, message_type, source_id) AS n FROM parsed_rows WHERE {_PLAIN}),
    sa AS (SELECT *, count(*) OVER (PARTITION BY document_id, role, message_type, source_id) AS n FROM stored_rows WHERE {_PLAIN}),
    m1 AS (SELECT p.document_id, p.position, s.line_number AS line FROM pa p JOIN sa s USING (document_id, role, message_type, source_id) WHERE p.n = 1 AND s.n = 1),
    pb AS (SELECT *, count(*) OVER (PARTITION BY document_id, role, message_type, content) AS k FROM pa p WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.document_id = p.document_id AND m1.position = p.position)),
    sb AS (SELECT *, count(*) OVER (PARTITION BY document_id, role, message_type, content) AS k FROM sa s WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.document_id = s.document_id AND m1.line = s.line_number)),
    m AS (SELECT * FROM m1 UNION ALL SELECT p.document_id, p.position, s.line_number FROM pb p JOIN sb s USING (document_id, role, message_type, content) WHERE p.k = 1 AND s.k = 1),
    x AS (SELECT * FROM parsed_rows p WHERE NOT {_PLAIN} AND NOT EXISTS
            (SELECT 1 FROM stored_rows s WHERE s.document_id = p.document_id AND s.message_type = p.message_type AND {_NAME.replace("source_id", "s.source_id").replace("content", "s.content").replace("(ts", "(s.ts")}
             = {_NAME.replace("source_id", "p.source_id").replace("content", "p.content").replace("(ts", "(p.ts")})),
    a AS (SELECT document_id, position, content, coalesce((SELECT min_by(line, m.position) FROM m WHERE m.document_id = x.document_id AND m.position > x.position),
                 (SELECT min_by(line_number, s.ts * 1000 + line_number) FROM stored_rows s WHERE s.document_id = x.document_id AND s.ts > x.ts),
                 coalesce((SELECT max(line_number) FROM stored_rows s WHERE s.document_id = x.document_id), 0) + 1) AS anchor FROM x)
    SELECT document_id, line_number + (SELECT count(*) FROM a WHERE a.document_id = s.document_id AND a.anchor <= s.line_number) AS line_number, message_type, content FROM stored_rows s
    UNION ALL
    SELECT document_id, anchor + (SELECT count(*) FROM a b WHERE b.document_id = a.document_id AND (b.anchor < a.anchor OR b.anchor = a.anchor AND b.position < a.position)),
           (SELECT any_value(message_type) FROM x WHERE x.document_id = a.document_id AND x.position = a.position), content FROM a""",
)
def n22_align_and_insert(parsed_rows, stored_rows):
    return recovery.align_and_insert(parsed_rows, stored_rows).select("document_id", "line_number", "message_type", "content")


@query("prompt_sources prompt_history")
def n25_repair_history(prompt_sources, prompt_history):
    source = prompt_sources.select("document_id", F.col("key").alias("message_id"), (F.col("key") + 1).alias("line_number"), F.lit("user").alias("role"), F.lit("text").alias("message_type"), "content", "ts")
    found = prompt_history.select("document_id", (-F.col("key") - 1).alias("message_id"), (-F.col("key") - 1).alias("line_number"), F.lit("user").alias("role"), F.lit(recovery.RECOVERED).alias("message_type"), "content", "ts")
    return recovery.repair_history(source.unionByName(found)).select("document_id", "line_number", "message_id")


@query(
    "parsed_rows stored_rows",
    """, p AS (SELECT document_id, cast(floor(position / 2) AS bigint) + 1 + CASE WHEN document_id % 3 = 0 THEN 1 ELSE 0 END AS line_number, concat(role, '|', message_type, '|', content) AS s, concat('m', position) AS model FROM parsed_rows),
    o AS (SELECT document_id, line_number, concat(role, '|', message_type, '|', content) AS s, CASE WHEN line_number % 5 = 0 THEN 'own' END AS model FROM stored_rows),
    j AS (SELECT o.*, p.model AS found FROM o LEFT JOIN p USING (document_id, line_number, s)),
    u AS (SELECT document_id, s FROM j WHERE found IS NULL GROUP BY ALL HAVING count(*) = 1),
    l AS (SELECT document_id, s, any_value(model) AS model FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.document_id = p.document_id AND o.line_number = p.line_number AND o.s = p.s) GROUP BY ALL HAVING count(*) = 1)
    SELECT j.document_id, line_number, coalesce(j.model, found, CASE WHEN u.s IS NOT NULL THEN l.model END) AS model,
           CASE WHEN found IS NOT NULL THEN 'line' WHEN u.s IS NOT NULL AND l.s IS NOT NULL THEN 'unique' END AS aligned
    FROM j LEFT JOIN u ON u.document_id = j.document_id AND u.s = j.s AND found IS NULL LEFT JOIN l ON l.document_id = j.document_id AND l.s = j.s""",
)
def n21_backfill_overlays(parsed_rows, stored_rows):
    line = F.floor(F.col("position") / 2) + 1 + F.when(F.col("document_id") % 3 == 0, 1).otherwise(0)
    parsed = parsed_rows.withColumns({"line_number": line, "model": F.concat(F.lit("m"), "position")})
    stored = stored_rows.withColumn("model", F.when(F.col("line_number") % 5 == 0, "own"))
    return recovery.backfill_overlays(stored, parsed, ["model"]).select("document_id", "line_number", "model", "aligned")
