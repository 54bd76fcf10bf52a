"""Queries over what a project is about, prompts' envelopes and shown calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import envelopes
from threadloom.operators import context
from threadloom.queries.registry import query


@query(
    "docs entities relations part lineitem",
    """, c AS (SELECT *, row_number() OVER (ORDER BY name, entity_id) AS place FROM entities WHERE contains(lower(name), 'brand#1') AND (user_id IS NULL OR user_id = 1) ORDER BY name, entity_id LIMIT 10),
    d AS (SELECT * FROM docs WHERE project = 'src3')
    SELECT 'documents' AS section, cast(NULL AS bigint) AS owner, row_number() OVER (ORDER BY category) AS place, concat(category, ': ', count(*)) AS text FROM d GROUP BY category
    UNION ALL SELECT 'note', NULL, place, concat(category, ': ', title, chr(10), substr(content, 1, 1000)) FROM (SELECT *, row_number() OVER (ORDER BY synced DESC, document_id) AS place FROM d WHERE category IN ('memory', 'plan', 'identity')) WHERE place <= 5
    UNION ALL SELECT 'entity', entity_id, place, concat(name, ' (', type, ')') FROM c
    UNION ALL SELECT 'edge', source_id, place, concat(type, ' ', far) FROM (SELECT r.source_id, r.type, e.name AS far, row_number() OVER (PARTITION BY r.source_id ORDER BY strength DESC, e.name, r.type, r.target_id) AS place
        FROM relations r JOIN c ON c.entity_id = r.source_id JOIN entities e ON e.entity_id = r.target_id) WHERE place <= 10
    UNION ALL SELECT 'fact', entity_id, place, concat('[', observed, '] ', content) FROM (SELECT l_partkey AS entity_id, cast(l_shipdate AS date) AS observed, p_name AS content,
        row_number() OVER (PARTITION BY l_partkey ORDER BY cast(l_shipdate AS date) DESC, p_name) AS place FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey IN (SELECT entity_id FROM c)) WHERE place <= 5""",
)
def l13_graph_context(docs, entities, relations, part, lineitem):
    facts = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("entity_id"), F.col("p_name").alias("content"), F.col("l_shipdate").cast("date").alias("observed"))
    return context.graph_context(docs, entities, relations, facts, "src3", "Brand#1", user_id=1)


@query(
    "docs",
    """SELECT document_id, coalesce(nullif(list_position(['memory', 'plan', 'identity', 'config', 'skill', 'learning', 'note', 'conversation'], category), 0), 9)::int AS rank,
    sha256(concat('## ', coalesce(nullif(trim(title), ''), 'Untitled'), chr(10), chr(10), CASE WHEN length(content) > 1500 THEN concat(substr(content, 1, 1500), chr(10), chr(10), '[cut]') ELSE content END, chr(10))) AS digest
    FROM docs WHERE project = 'src3'""",
)
def a12_project_sections(docs):
    rows = context.project_sections(docs.withColumn("summary", F.lit(None).cast("string")), "src3", chars=1500)
    return rows.select("document_id", F.col("rank").cast("int").alias("rank"), F.sha2("markdown", 256).alias("digest"))


@query(
    "messages",
    """SELECT message_id, CASE WHEN message_id % 4 = 3 THEN concat('<timestamp>soon</timestamp> ', content) ELSE trim(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) END AS content,
    CASE WHEN message_id % 4 = 1 THEN 1709559900 - 3600 * 8 END AS sent, CASE WHEN message_id % 4 = 2 THEN '<plugin_info>p</plugin_info>' ELSE '' END AS context FROM messages WHERE role = 'user'""",
)
def j7_split_cursor_user(messages):
    stamp = F.lit("<timestamp>Monday, Mar 4, 2024, 1:45 PM (UTC+8)</timestamp>\n")
    asked = F.concat(F.lit("<user_query>\n"), "content", F.lit("\n</user_query>"))
    kind = F.col("message_id") % 4
    text = F.when(kind == 0, asked).when(kind == 1, F.concat(stamp, asked)).when(kind == 2, F.concat(F.lit("<plugin_info>p</plugin_info>\n"), asked)).otherwise(F.concat(F.lit("<timestamp>soon</timestamp> "), "content"))
    return messages.where("role = 'user'").select("message_id", envelopes.split_cursor_user(text).alias("x")).select("message_id", "x.content", "x.sent", "x.context")


@query(
    "messages",
    """SELECT document_id, count(*) AS n, string_agg(concat(CASE role WHEN 'user' THEN 'Tool' ELSE role END, '=', substr(content, 1, 5000)), '|' ORDER BY line_number) AS calls FROM messages GROUP BY document_id""",
)
def j19_conversation_tool_calls(messages):
    call = F.struct(F.when(F.col("role") != "user", F.concat(F.lit(" "), "role")).alias("name"), F.substring("content", 1, 5000).alias("input"))
    turns = messages.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_number", call.alias("c")))), lambda x: x["c"]).alias("calls"))
    shown = turns.select("document_id", envelopes.tool_calls(F.col("calls")).alias("c"))
    return shown.select("document_id", F.size("c").cast("long").alias("n"), F.array_join(F.transform("c", lambda c: F.concat_ws("=", c["name"], c["input"])), "|").alias("calls"))
