"""Queries over task lists and forests of agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import tasks
from threadloom.queries.registry import query, stream_query
from threadloom.streaming.runs import run_available

_SNAPSHOTS = """, t(op, place, id, content, status) AS (VALUES (0, 0, '1', 'plan', 'pending'), (0, 1, '2', 'b', 'in_progress'), (1, 0, '1', NULL, 'completed'), (2, 0, '3', 'new', 'pending'),
        (3, 0, '9', NULL, 'in_progress'), (4, 0, '2', 'b2', 'completed'), (5, 0, '3', NULL, 'cancelled'),
        (7, 0, concat('task-1-', substr(sha256('x'), 1, 16)), 'x', 'completed'), (7, 1, concat('task-2-', substr(sha256('y'), 1, 16)), 'y', 'pending')),
    r AS (SELECT document_id, line_number, op, row_number() OVER w AS revision, count(*) FILTER (op IN (0, 7)) OVER w AS epoch FROM task_events WHERE op <> 6
          WINDOW w AS (PARTITION BY document_id ORDER BY line_number)),
    e AS (SELECT r.document_id, r.line_number AS line, r.epoch, t.* FROM r JOIN t USING (op)),
    s AS (SELECT r.document_id, r.line_number, r.revision, e.id, min(line * 10 + place) AS first,
                 coalesce(max_by(content, line) FILTER (content IS NOT NULL), concat('Task #', any_value(e.id))) AS content, max_by(status, line) AS status,
                 min_by(CASE WHEN content IS NULL THEN 1 ELSE 0 END, line) AS unknown
          FROM r JOIN e ON e.document_id = r.document_id AND e.epoch = r.epoch AND e.line <= r.line_number GROUP BY ALL)
    SELECT document_id, line_number, revision, CASE WHEN max(unknown) = 1 THEN 'partial' ELSE 'authoritative' END AS quality,
           count(*) FILTER (status = 'completed') AS completed, count(*) AS total,
           coalesce(min_by(id, first) FILTER (status = 'in_progress'), min_by(id, first) FILTER (status = 'pending'), '') AS active_task_id,
           string_agg(concat(id, ':', content, ':', status), '|' ORDER BY first) AS tasks
    FROM s GROUP BY document_id, line_number, revision"""


def _shown(snapshots: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform("tasks", lambda t: F.concat_ws(":", t["id"], t["content"], t["status"])), "|")
    return snapshots.select("document_id", "line_number", "revision", "quality", "completed", "total", "active_task_id", listed.alias("tasks"))


@query("task_events", _SNAPSHOTS)
def j16_track_tasks(task_events):
    return _shown(tasks.track_tasks(task_events))


@stream_query("task_events", _SNAPSHOTS)
def o6_task_state(task_events):
    return _shown(run_available(tasks.task_state(task_events), "o6"))


_FOREST = """, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool_id, root, thread_id ORDER BY has_state DESC, activity DESC, document_id DESC) AS n FROM agent_nodes) WHERE n = 1),
    p AS (SELECT c.*, q.thread_id AS up FROM c LEFT JOIN c q ON q.tool_id = c.tool_id AND q.root = c.root AND q.thread_id = c.parent_thread_id),
    d AS (SELECT tool_id, root, thread_id FROM p WHERE up IS NULL UNION ALL SELECT p.tool_id, p.root, p.thread_id FROM p JOIN d ON d.tool_id = p.tool_id AND d.root = p.root AND d.thread_id = p.up),
    h AS (SELECT p.* EXCLUDE (up), CASE WHEN d.thread_id IS NOT NULL THEN up END AS up,
                 CASE WHEN d.thread_id IS NULL THEN 'cycle' WHEN parent_thread_id IS NOT NULL AND p.up IS NULL THEN 'missing_parent' ELSE 'complete' END AS quality
          FROM p LEFT JOIN d USING (tool_id, root, thread_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY tool_id, root, up ORDER BY depth, activity, thread_id) AS rank FROM h),
    f AS (SELECT document_id, tool_id, root, thread_id, parent_thread_id, quality, 0 AS level, [rank] AS path FROM k WHERE up IS NULL
          UNION ALL SELECT k.document_id, k.tool_id, k.root, k.thread_id, k.parent_thread_id, k.quality, level + 1, list_append(path, k.rank)
          FROM f JOIN k ON k.tool_id = f.tool_id AND k.root = f.root AND k.up = f.thread_id),
    forest AS (SELECT * EXCLUDE (path), row_number() OVER (PARTITION BY tool_id, root ORDER BY path) AS place FROM f)"""


@query("agent_nodes", f"{_FOREST} SELECT * FROM forest")
def k8_task_forest(agent_nodes):
    return tasks.task_forest(agent_nodes)


_OPEN = "status IN ('pending', 'in_progress', 'blocked')"
_ROOTS = f"""SELECT tool_id, root, max(activity) AS activity FROM agent_nodes WHERE document_id IN (SELECT document_id FROM agent_tasks WHERE {_OPEN}) GROUP BY tool_id, root
    ORDER BY activity DESC, tool_id DESC, root DESC LIMIT 10"""


@query(
    "agent_nodes agent_tasks",
    f"""{_FOREST}, page AS (SELECT *, row_number() OVER (ORDER BY activity DESC, tool_id DESC, root DESC) AS page FROM ({_ROOTS}))
    SELECT document_id, root, task_place FROM (SELECT a.document_id, root, task_place, row_number() OVER (ORDER BY page, place, task_place) AS n
    FROM agent_tasks a JOIN forest USING (document_id) JOIN page USING (tool_id, root) WHERE {_OPEN}) WHERE n <= 100""",
)
def k8_tasks_within_budget(agent_nodes, agent_tasks):
    page = tasks.select_tasks(agent_nodes, agent_tasks)
    return tasks.tasks_within_budget(tasks.task_forest(agent_nodes), agent_tasks, page.select("tool_id", "root", "page"))


@query(
    "agent_nodes agent_tasks",
    """SELECT root, max(activity) AS activity, count(*) OVER () > 1 AS ambiguous FROM agent_nodes
    WHERE document_id IN (SELECT document_id FROM agent_tasks WHERE status = 'blocked') AND (thread_id = 't3' OR root = 't3') AND tool_id = 'codex' GROUP BY root""",
)
def k9_select_tasks(agent_nodes, agent_tasks):
    return tasks.select_tasks(agent_nodes, agent_tasks, thread="t3", tool="codex", status="blocked").select("root", "activity", "ambiguous")
