"""Views that read the given tables as transcripts, notes and their metadata.

The statements run in Spark as in other SQL engines; ``{name}`` stands for a table.
All times are epoch seconds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.tables import PARTS

#: 2024-01-01 and 2024-02-01 UTC: the first message and the moment queries run at.
E0, NOW = 1704067200, 1706745600

VIEWS = {
    "messages": f"""
        SELECT conv_id * 1000 + turn AS message_id, conv_id AS document_id, turn + 1 AS line_number, role, text AS content,
               {E0} + conv_id * 3600 + turn * 60 AS ts
        FROM {{conversations}}""",
    "docs": f"""
        SELECT doc_id AS document_id,
               CASE CAST(substr(source, 4) AS int) % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude_code' WHEN 2 THEN 'cursor' ELSE 'obsidian' END AS tool_id,
               doc_id % 12 AS machine_id, source AS project,
               CASE doc_id % 6 WHEN 0 THEN 'memory' WHEN 1 THEN 'plan' WHEN 2 THEN 'note' WHEN 3 THEN 'learning' WHEN 4 THEN 'identity' ELSE 'config' END AS category,
               concat(source, '/d', doc_id % 300, CASE WHEN doc_id % 41 = 0 THEN '.meta.json' ELSE '.md' END) AS relative_path,
               substr(text, 1, 60) AS title, text AS content, {E0} + (doc_id % 1000) * 2500 AS synced
        FROM {{documents}}""",
    "machines": """
        SELECT s_suppkey - 1 AS machine_id,
               concat('Host', (s_suppkey - 1) % 5, CASE (s_suppkey - 1) % 3 WHEN 0 THEN ' (Windows)' WHEN 1 THEN ' (Linux)' ELSE '' END) AS name,
               CASE WHEN (s_suppkey - 1) % 4 = 3 THEN NULL ELSE (s_suppkey - 1) % 4 END AS user_id
        FROM {supplier}""",
    "projects": """
        SELECT DISTINCT source AS slug, source AS title FROM {documents} UNION ALL SELECT 'empty' AS slug, 'empty' AS title""",
    "grants": """
        SELECT c_custkey AS grant_id, c_custkey % 4 AS user_id,
               CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE concat('src', c_nationkey % 20) END AS project,
               CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'codex' WHEN c_custkey % 5 = 2 THEN 'claude_code' WHEN c_custkey % 5 = 3 THEN 'cursor' ELSE 'obsidian' END AS tool_id
        FROM {customer}""",
    "entities": """
        SELECT p_partkey AS entity_id, p_size % 3 AS user_id, p_brand AS name, p_type AS type, p_name AS summary FROM {part}""",
    "relations": """
        SELECT l_suppkey AS source_id, l_partkey AS target_id, l_returnflag AS type, count(*) AS strength FROM {lineitem} GROUP BY l_suppkey, l_partkey, l_returnflag""",
    "observations": """
        SELECT p_brand AS entity, p_name AS content, CAST(l_shipdate AS date) AS observed, l_orderkey % 1000 AS document_id, l_orderkey, l_linenumber, l_partkey
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "vectors": """
        SELECT vec_id, CAST(floor(vec_id / 5) AS bigint) AS document_id, vec_id % 5 AS chunk_index, label % 2 AS tier, embedding FROM {embeddings}""",
    "signals": """
        SELECT event_id, user_id * 10 + event_id % 10 AS activity_id, user_id % 50 AS document_id,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'running' END AS status, ts, props AS command
        FROM {events}""",
    "deliveries": """
        SELECT l_orderkey AS source, l_linenumber * 100 AS byte_offset,
               CASE WHEN l_quantity > 45 THEN -1 ELSE l_linenumber * 100 - 100 END AS base_offset,
               CASE WHEN l_linenumber = 1 THEN 'full' ELSE 'delta' END AS mode,
               concat(l_orderkey, ':', l_linenumber * 100) AS hash, CAST(l_quantity AS bigint) AS size, CAST(l_shipdate AS date) AS delivered
        FROM {lineitem}""",
    "inbox_rows": f"""
        SELECT user_id AS session, event_type = 'purchase' AND event_id % 7 = 0 AS is_document, concat(event_type, event_id % 3) AS signal_id,
               CASE event_type WHEN 'view' THEN 'activity' WHEN 'click' THEN 'interaction' ELSE 'title' END AS kind,
               concat('p', event_id) AS payload, {E0} + event_id * 260 AS ts
        FROM {{events}}""",
    "question_events": f"""
        SELECT user_id AS document_id, event_id AS place,
               CASE event_type WHEN 'purchase' THEN 'answered' WHEN 'error' THEN 'cancelled' WHEN 'signup' THEN 'human' ELSE 'pending' END AS status,
               concat(CASE WHEN event_id % 6 < 2 THEN 'a' WHEN event_id % 6 < 4 THEN 'w' ELSE 'p' END, CAST(floor(event_id / 6) AS bigint) % 2) AS interaction_id,
               CASE WHEN event_id % 6 < 2 THEN 'ask' WHEN event_id % 6 < 4 THEN 'wrapper' ELSE 'permission' END AS kind,
               concat('f', CAST(floor(event_id / 6) AS bigint) % 2) AS fingerprint, {E0} + event_id * 260 AS ts
        FROM {{events}}""",
    "title_events": f"""
        SELECT user_id AS document_id, {E0} + event_id * 260 AS ts, event_id AS place, concat('m', event_id % 3) AS machine, event_id % 50 + 1 AS revision,
               concat('t', event_id % 4) AS title,
               CASE WHEN event_type = 'view' AND event_id % 10 = 3 THEN 'custom' WHEN event_type = 'signup' AND event_id % 50 = 7 THEN 'manual'
                    WHEN event_type = 'error' THEN 'unknown' ELSE 'fallback' END AS kind
        FROM {{events}}""",
    "prompt_sources": f"""
        SELECT user_id AS document_id, event_id AS key, concat('p', event_id % 4) AS content, {E0} + event_id * 20 AS ts
        FROM {{events}} WHERE event_type <> 'error'""",
    "prompt_history": f"""
        SELECT user_id AS document_id, event_id AS key, concat('p', event_id % 4) AS content,
               CASE WHEN event_id % 97 > 0 THEN {E0} + event_id * 20 + (event_id * 37) % 500 - 250 END AS ts
        FROM {{events}} WHERE event_type <> 'click'""",
    "parsed_rows": f"""
        SELECT conv_id AS document_id, turn * 2 AS position, role, 'text' AS message_type, CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('s', turn % 5) END AS source_id,
               CASE WHEN turn % 4 = 3 THEN 'again' ELSE text END AS content, CASE WHEN turn % 5 < 4 THEN {E0} + turn * 60 END AS ts
        FROM {{conversations}}
        UNION ALL
        SELECT conv_id, turn * 2 + 1, 'assistant', CASE WHEN turn % 2 = 0 THEN 'reasoning' ELSE 'agent_event' END, CASE WHEN turn % 3 = 0 THEN concat('r', turn) END,
               concat('thought ', turn), {E0} + turn * 60 + 30
        FROM {{conversations}}""",
    "stored_rows": f"""
        SELECT conv_id AS document_id, turn + 1 AS line_number, role, 'text' AS message_type, CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('s', turn % 5) END AS source_id,
               CASE WHEN turn % 4 = 3 THEN 'again' ELSE text END AS content, CASE WHEN turn % 5 < 4 THEN {E0} + turn * 60 END AS ts
        FROM {{conversations}} WHERE (conv_id + turn) % 7 <> 3
        UNION ALL
        SELECT conv_id, 100 + turn, 'assistant', CASE WHEN turn % 2 = 0 THEN 'reasoning' ELSE 'agent_event' END, CASE WHEN turn % 3 = 0 THEN concat('r', turn) END,
               concat('thought ', turn), {E0} + turn * 60 + 30
        FROM {{conversations}} WHERE (conv_id + turn) % 4 = 1""",
    "task_events": """
        SELECT conv_id AS document_id, turn + 1 AS line_number, 'claude_code' AS source, (conv_id * 3 + turn) % 8 AS op, concat('c', turn) AS call_id, '' AS content,
               CASE (conv_id * 3 + turn) % 8 WHEN 0 THEN 'TodoWrite' WHEN 2 THEN 'TaskCreate' WHEN 4 THEN 'functions.todo_write' WHEN 5 THEN 'TaskStop' WHEN 6 THEN 'Bash'
                    WHEN 7 THEN 'update_plan' ELSE 'TaskUpdate' END AS tool,
               translate(CASE (conv_id * 3 + turn) % 8
                    WHEN 0 THEN '("todos": [("id": "1", "content": "plan", "status": "pending"), ("id": "2", "content": "b", "status": "In-Progress"), ("id": "2")])'
                    WHEN 1 THEN '("taskId": "1", "status": "done")' WHEN 2 THEN '("id": "3", "subject": " new ")' WHEN 3 THEN '("taskId": "9", "status": "active")'
                    WHEN 4 THEN '("merge": true, "todos": [("id": "2", "content": "b2", "status": "success")])' WHEN 5 THEN '("task_id": "3")'
                    WHEN 7 THEN '("plan": [("step": "x", "status": "completed"), ("step": "y")])' ELSE 'ls' END, '()', concat(chr(123), chr(125))) AS input
        FROM {conversations}""",
    "agent_nodes": f"""
        SELECT document_id, 'codex' AS tool_id, concat('t', g) AS root, concat('t', CASE WHEN k = 15 THEN document_id - 1 ELSE document_id END) AS thread_id,
               CASE WHEN k = 0 THEN NULL WHEN k = 5 THEN 'gone' WHEN k = 6 THEN concat('t', g + 7) WHEN k = 7 THEN concat('t', g + 6)
                    WHEN k = 11 THEN concat('t', document_id) ELSE concat('t', g + CAST(floor(k / 2) AS bigint)) END AS parent_thread_id,
               concat('a', document_id) AS agent_id, CAST(floor(k / 4) AS bigint) AS depth, {E0} + (document_id * 100) % 777 AS activity, document_id % 3 > 0 AS has_state
        FROM (SELECT DISTINCT conv_id AS document_id, conv_id % 16 AS k, conv_id - conv_id % 16 AS g FROM {{conversations}}) d""",
    "agent_tasks": """
        SELECT conv_id AS document_id, turn AS task_place,
               CASE (conv_id + turn) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' WHEN 3 THEN 'blocked' ELSE 'cancelled' END AS status
        FROM {conversations}""",
    "planted": """
        SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(substr(text, 1, 30), ' sk-', md5(CAST(doc_id AS string)), '.', substr(text, 31))
                            WHEN doc_id % 5 = 1 THEN concat(substr(text, 1, 30), '-----BEGIN RSA PRIVATE KEY-----', substr(text, 31)) ELSE text END AS text
        FROM {documents} WHERE text IS NOT NULL""",
    "file_records": """
        SELECT doc_id AS source, 1 AS record, substr(t.text, 1, 40) AS text FROM {planted} t UNION ALL SELECT doc_id, 2, substr(t.text, 41, 12) FROM {planted} t
        UNION ALL SELECT doc_id, 3, substr(t.text, 53) FROM {planted} t""",
    "versions": """
        SELECT o_custkey AS document_id, concat('v', o_orderkey) AS hash, o_totalprice AS size, CAST(o_orderdate AS date) AS synced, o_orderkey FROM {orders}""",
    "children": """
        SELECT DISTINCT conv_id AS document_id, conv_id - conv_id % 8 AS root, CASE WHEN conv_id % 2 = 0 THEN concat('call', conv_id) END AS tool_use_id,
               concat('t', conv_id) AS agent_id, concat('s', conv_id) AS thread_id, concat('m', conv_id % 5) AS runtime,
               CASE conv_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' END AS status, concat('child ', conv_id) AS title
        FROM {conversations} WHERE conv_id % 8 >= 2""",
    "launches": f"""
        SELECT conv_id * 1000 + turn AS event_id, conv_id AS document_id, conv_id - conv_id % 8 AS root, turn + 1 AS line_number,
               CASE WHEN turn % 3 < 2 THEN concat('call', conv_id - conv_id % 8 + turn % 8) END AS tool_use_id,
               CASE turn % 3 WHEN 0 THEN concat('t', conv_id - conv_id % 8 + turn % 8) WHEN 1 THEN concat('agent-t', conv_id - conv_id % 8 + (turn + 1) % 8)
                    ELSE concat('s', conv_id - conv_id % 8 + turn % 8) END AS thread_id,
               CASE WHEN conv_id % 11 > 0 THEN concat('i', CAST(floor(turn / 3) AS bigint)) END AS identity,
               CASE WHEN turn % 9 < 5 THEN 'started' ELSE 'result' END AS kind, CASE WHEN turn % 2 = 0 THEN 'Subagent' ELSE concat('step ', turn) END AS label,
               {E0} - turn % 4 AS started_at, CASE WHEN turn % 3 = 1 THEN concat('m', turn) END AS model,
               CASE WHEN (conv_id + turn) % 7 = 0 THEN 'failed' WHEN turn % 5 = 4 THEN 'completed' ELSE 'running' END AS status
        FROM {{conversations}}""",
    "conv_docs": f"""
        SELECT *, CASE WHEN tool_id <> 'codex' AND k >= 2 THEN concat('p/t', root, '/subagents/', thread, '.jsonl') ELSE concat('p/', thread, '.jsonl') END AS relative_path
        FROM (SELECT DISTINCT conv_id AS document_id, conv_id % 8 AS k, conv_id - conv_id % 8 AS root,
              CASE CAST(floor((conv_id - conv_id % 8) / 8) AS bigint) % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude_code' ELSE 'cursor' END AS tool_id,
              concat('t', CASE WHEN conv_id % 8 = 7 THEN conv_id - 1 WHEN conv_id % 8 = 1 THEN conv_id - 1 ELSE conv_id END) AS thread,
              CASE WHEN conv_id % 8 >= 2 THEN concat('t', conv_id - conv_id % 8) ELSE NULL END AS root_session_id,
              100 + (conv_id * 7) % 50 AS file_size, {E0} + conv_id * 4000 AS synced,
              {E0} + conv_id * 4000 + (conv_id % 5 - 2) * 900 AS mtime, (conv_id % 8) % 3 AS depth,
              CASE WHEN conv_id % 4 = 3 THEN NULL ELSE {E0} + conv_id * 3600 + 300 END AS activity
              FROM {{conversations}}) c
        WHERE NOT (k <= 1 AND CAST(floor(root / 8) AS bigint) % 5 = 4)""",
}


VIEWS["file_records"] = VIEWS["file_records"].replace("{planted}", f"({VIEWS.pop('planted')})")


#: Views that group nearly unique rows: the table and the keys by which Spark deals its rows first.
DEALT = {"relations": ("lineitem", ["l_suppkey", "l_partkey", "l_returnflag"])}


def sql(view: str) -> str:
    """A view's statement with plain table names, for other engines."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[view])


def bind(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view, or a table itself, of the tables in ``sf_dir``."""
    return _bound(spark, view, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def bind_stream(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """The same of the tables' files as they arrive."""

    def arriving(name: str) -> DataFrame:
        path = f"{sf_dir}/{name}.parquet"
        # as a pattern, the path may also name a single file
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")

    return _bound(spark, view, arriving)


def _bound(spark: SparkSession, view: str, table: Callable[[str], DataFrame]) -> DataFrame:
    if view not in VIEWS:
        return table(view)
    tables = {n: table(n) for n in set(re.findall(r"\{(\w+)\}", VIEWS[view]))}
    if view in DEALT:
        name, keys = DEALT[view]
        tables[name] = tables[name].repartition(PARTS, *keys)
    return spark.sql(VIEWS[view], **tables)
