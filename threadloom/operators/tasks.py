"""Task lists of conversations: how they change, and the forest of agents that hold them."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadloom.tables import written

#: Tasks of a list, and characters of a task's text and id.
MAX_TASKS, TEXT_CHARS, ID_CHARS = 200, 4000, 256
#: Words for a status; others mean pending.
STATUSES = {
    "complete": "completed", "completed": "completed", "done": "completed", "succeeded": "completed", "success": "completed",
    "inprogress": "in_progress", "in_progress": "in_progress", "active": "in_progress", "working": "in_progress",
    "cancelled": "cancelled", "canceled": "cancelled", "blocked": "blocked",
}
OUTSTANDING = ("pending", "in_progress", "blocked")
#: Names (without marks, at their end) of the tools that change a list, and of results.
TOOLS = r"(updateplan|todowrite|tasklist|taskcreate|taskupdate|taskstop|taskprogress.*|^toolresult|^taskresult)$"
#: What a result says of a new task, and a line of a listing.
CREATED = re.compile(r"Task\s+#([^\s:]+)\s+created\s+successfully(?:\s*:\s*(.*))?", re.I)
LISTED = re.compile(r"^#(\S+)\s+\[(" + "|".join(w.replace("_", "[_ -]") for w in ["pending", *STATUSES]) + r")\]\s+(.+)$", re.I | re.M)
TASK = "struct<id: string, content: string, status: string, active_form: string>"
SNAPSHOT = f"document_id long, line_number long, revision long, quality string, is_current boolean, completed long, total long, active_task_id string, tasks array<{TASK}>"


def status_of(word: Any) -> str:
    return STATUSES.get(re.sub(r"[ -]", "_", str(word or "").strip().lower()), "pending")


def _first(item: dict, keys: str, chars: int | None) -> str:
    """The first filled field among ``keys``, trimmed and cut."""
    return next((t[:chars] for k in keys.split() if (t := str(item.get(k) or "").strip())), "")


def _mapping(text: Any) -> dict:
    try:
        value = json.loads(text) if text else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


class TaskList:
    """A conversation's list of tasks; ``apply`` moves it by one row of its transcript."""

    def __init__(self, saved: str | None = None, bounded: bool = True):
        kept = json.loads(saved) if saved else {}
        self.tasks: dict[str, dict] = kept.get("tasks", {})
        self.unnamed: list[str] = kept.get("unnamed", [])  # created, their number not told yet
        self.asked: list[str] = kept.get("asked", [])  # calls whose result lists tasks
        self.revision, self.partial = kept.get("revision", 0), kept.get("partial", False)
        self.most, self.chars, self.id_chars = (MAX_TASKS, TEXT_CHARS, ID_CHARS) if bounded else (None, None, None)

    def saved(self) -> str:
        return json.dumps({"tasks": self.tasks, "unnamed": self.unnamed, "asked": self.asked, "revision": self.revision, "partial": self.partial})

    def _task(self, item: Any, place: int, name: str = "") -> dict | None:
        content = _first(item, "content step subject title description", self.chars) if isinstance(item, dict) else ""
        if not content:
            return None
        key = _first(item, "id taskId task_id", self.id_chars) or name or f"task-{place + 1}-{hashlib.sha256(content.encode()).hexdigest()[:16]}"
        return {"id": key, "content": content, "status": status_of(item.get("status")), "active_form": _first(item, "activeForm active_form", self.chars)}

    def _put(self, items: list, replace: bool) -> bool:
        fresh = {t["id"]: t for i, item in enumerate(items[: self.most]) if (t := self._task(item, i))}
        self.tasks = fresh if replace else self.tasks | fresh
        self.partial = self.partial and not replace
        return replace or bool(fresh)

    def _change(self, payload: dict, stop: bool) -> bool:
        key = _first(payload, "taskId task_id id", self.id_chars)
        if not key:
            return False
        self.partial = self.partial or key not in self.tasks
        task = self.tasks.get(key) or {"id": key, "content": f"Task #{key}", "status": "pending", "active_form": ""}
        if stop:
            task = task | {"status": "cancelled"}
        else:
            told = {"content": _first(payload, "content subject description", self.chars), "active_form": _first(payload, "activeForm active_form", self.chars)}
            task = task | {k: v for k, v in told.items() if v} | ({"status": status_of(payload["status"])} if "status" in payload else {})
        self.tasks[key] = task
        return True

    def _result(self, call: str, content: str, source: str) -> bool:
        changed, said = False, CREATED.search(content)
        if said and self.unnamed:
            old, key = self.unnamed.pop(0), said[1][: self.id_chars]
            if old in self.tasks:
                renamed = self.tasks[old] | {"id": key} | ({"content": t[: self.chars]} if (t := (said[2] or "").strip()) else {})
                self.tasks = {(key if k == old else k): (renamed if k == old else v) for k, v in self.tasks.items() if k == old or k != key}
                changed = True
        lines = [x for line in content.splitlines() if (x := line.strip())]
        alone = source == "claude_code" and bool(lines) and all(LISTED.fullmatch(x) for x in lines)
        if call in self.asked:
            self.asked.remove(call)
            alone = True
        listed = [{"id": m[1], "status": m[2], "content": m[3], "active_form": self.tasks.get(m[1], {}).get("active_form")} for m in LISTED.finditer(content)] if alone else []
        if listed:
            partial = self.partial
            changed, self.partial, self.unnamed = self._put(listed, True), partial, []
        return changed

    def apply(self, row: Any) -> dict | None:
        """The snapshot behind ``row`` (source, tool, call_id, input, content), None if nothing changed."""
        match = re.search(TOOLS, re.sub(r"[^a-z0-9]", "", (row["tool"] or "").lower()))
        if not match:
            return None
        name, payload, call = match[1], _mapping(row["input"]), (row["call_id"] or "")[: self.id_chars]
        given = payload.get("plan") if name == "updateplan" else payload.get("tasks", payload.get("todos"))
        if name == "todowrite" and not isinstance(given, list):
            told = _mapping(row["content"])
            given = told.get("finalTodos", told.get("final_todos"))
        if name == "tasklist" and call:
            self.asked.append(call)
        if name.endswith("result"):
            changed = self._result(call, row["content"] or "", row["source"] or "")
        elif name in ("taskupdate", "taskstop"):
            changed = self._change(payload, name == "taskstop")
        elif name == "taskcreate":
            named = _first(payload, "id taskId task_id", self.id_chars)
            task = self._task(payload, len(self.tasks), named or call or f"pending-{len(self.unnamed) + 1}-{len(self.tasks) + 1}")
            changed = task is not None
            if task:
                self.tasks[task["id"]] = task
                self.unnamed += [] if named else [task["id"]]
        else:
            changed = isinstance(given, list) and self._put(given, name in ("updateplan", "tasklist") or not payload.get("merge"))
        if not changed:
            return None
        self.revision += 1
        tasks, current = list(self.tasks.values()), bool(payload.get("is_current"))
        active = [t["id"] for s in ("in_progress", "pending") for t in tasks if t["status"] == s]
        return {
            "revision": self.revision, "quality": "partial" if self.partial else "explicit_current" if current else "authoritative", "is_current": current,
            "completed": sum(t["status"] == "completed" for t in tasks), "total": len(tasks), "active_task_id": active[0] if active else "", "tasks": tasks,
        }


def task_rows(messages: DataFrame) -> DataFrame:
    """The rows that may change a list of tasks."""
    return messages.where(F.regexp_replace(F.lower("tool"), "[^a-z0-9]", "").rlike(TOOLS))


def track_tasks(messages: DataFrame, bounded: bool = True) -> DataFrame:
    """A snapshot of the list of tasks for each row that changes it.

    ``messages(document_id, line_number, source, tool, call_id, input, content)``: calls that replace, merge,
    create, update or stop tasks, and results that name new tasks or list them all. Returns document_id,
    line_number, revision, quality, is_current, completed, total, active_task_id, tasks. A list is
    partial from a change of an unknown task until it is replaced. ``bounded=False`` lifts the bounds on tasks and texts.

    A partition is read as one sorted stream and holds one document's list at a time.
    """

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, tasks = None, TaskList(bounded=bounded)
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                if row["document_id"] != document:
                    document, tasks = row["document_id"], TaskList(bounded=bounded)
                if found := tasks.apply(row):
                    out.append({"document_id": document, "line_number": row["line_number"], **found})
            if out:
                yield pd.DataFrame(out)

    rows = task_rows(messages).where("document_id is not null").select("document_id", "line_number", "source", "tool", "call_id", "input", "content")
    return rows.repartition("document_id").sortWithinPartitions("document_id", "line_number").mapInPandas(folded, SNAPSHOT)


class _TaskStream(StatefulProcessor):
    def __init__(self, bounded: bool):
        self.bounded = bounded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.list = handle.getValueState("list", "saved string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        tasks = TaskList(self.list.get()[0] if self.list.exists() else None, self.bounded)
        for row in sorted(rows, key=lambda r: r["line_number"]):
            if found := tasks.apply(row):
                found["tasks"] = [Row(**t) for t in found["tasks"]]
                yield Row(document_id=key[0], line_number=row["line_number"], **found)
        self.list.update((tasks.saved(),))

    def close(self) -> None:
        pass


def task_state(messages: DataFrame, bounded: bool = True) -> DataFrame:
    """``track_tasks`` of a stream: each document's list is kept as state and goes on where the last batch left it."""
    return task_rows(messages).groupBy("document_id").transformWithState(_TaskStream(bounded), SNAPSHOT, "Append", "None")


# --- forests of agents ------------------------------------------------------------------

NODE = ["tool_id", "root", "thread_id"]


def _climb(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes(tool_id, root, thread_id, up, path)`` with every pointer followed to its end, by doubling.

    A pointer that still points when a round ends none lies on a circle or leads to one. ``path`` grows by the paths passed.
    """
    rows, open_ = written(nodes, name), -1
    while (left := rows.where("up is not null").count()) not in (0, open_):
        open_ = left
        over = rows.select("tool_id", "root", F.col("thread_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        further = rows.join(over, ["tool_id", "root", "up"], "left")
        path = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path"))
        rows = written(further.select(*NODE, F.col("_up").alias("up"), path.alias("path")), name)
    return rows


def task_forest(agents: DataFrame) -> DataFrame:
    """The agents of each root conversation as a forest, a row for each thread.

    ``agents(document_id, tool_id, root, thread_id, parent_thread_id, depth, activity, has_state)``. Of copies of a
    thread one with a task state stays, then the newest. Returns document_id, tool_id, root, thread_id,
    parent_thread_id, quality, level (0 at the top) and place (from 1, parents before their children, siblings by depth,
    activity and thread). An agent whose parent is unknown (missing_parent) or whose line of
    parents runs into a circle (cycle) stands at the top. Trees may have any depth.
    """
    copies = Window.partitionBy(*NODE).orderBy(F.desc("has_state"), F.desc("activity"), F.desc("document_id"))
    nodes = agents.withColumn("_n", F.row_number().over(copies)).where("_n = 1").drop("_n")
    parents = nodes.select("tool_id", "root", F.col("thread_id").alias("parent_thread_id"), F.lit(True).alias("_known"))
    nodes = nodes.withColumn("parent_thread_id", F.nullif("parent_thread_id", F.lit(""))).join(parents, ["tool_id", "root", "parent_thread_id"], "left")
    nodes = written(nodes.withColumn("up", F.when(F.col("_known"), F.col("parent_thread_id"))), "agents")

    circles = _climb(nodes.select(*NODE, "up", F.array().cast("array<int>").alias("path")), "agents-up").where("up is not null").select(*NODE, F.lit(True).alias("_circle"))
    nodes = nodes.join(circles, NODE, "left").withColumn("up", F.when(F.col("_circle").isNull(), F.col("up")))
    siblings = Window.partitionBy("tool_id", "root", "up").orderBy("depth", "activity", "thread_id")
    ranked = written(nodes.withColumn("path", F.array(F.row_number().over(siblings))), "agents-ranked")
    paths = _climb(ranked.select(*NODE, "up", "path"), "agents-path").select(*NODE, F.col("path").alias("_path"))
    quality = F.when(F.col("_circle"), "cycle").when(F.col("parent_thread_id").isNotNull() & F.col("_known").isNull(), "missing_parent").otherwise("complete")
    place = F.row_number().over(Window.partitionBy("tool_id", "root").orderBy("_path"))
    return ranked.join(paths, NODE).select(
        "document_id", *NODE, "parent_thread_id", quality.alias("quality"), (F.size("_path") - 1).alias("level"), place.alias("place")
    )


def of_status(status: str) -> Column:
    """Whether a task's status is asked for: all, outstanding or one status."""
    return F.lit(True) if status == "all" else F.col("status").isin(*OUTSTANDING) if status == "outstanding" else F.col("status") == status


def tasks_within_budget(forest: DataFrame, tasks: DataFrame, roots: DataFrame, status: str = "outstanding", budget: int = 100) -> DataFrame:
    """document_id, root, task_place: the first ``budget`` tasks of a page of roots, in the order of the page and the forest.

    ``roots(tool_id, root, page)`` in page order, ``tasks(document_id, task_place, status)``. Running totals are
    taken within a root, and the totals of the roots before are added.
    """
    rows = tasks.where(of_status(status)).join(forest, "document_id").join(roots, ["tool_id", "root"])
    order = Window.partitionBy(F.lit(0)).orderBy("page")  # one row for each root of the page
    totals = rows.groupBy("page").agg(F.count("*").alias("n")).select("page", (F.sum("n").over(order) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("tool_id", "root").orderBy("place", "task_place"))
    return rows.withColumn("_n", place).join(totals, "page").where(F.col("before") + F.col("_n") <= budget).select("document_id", "root", "task_place")


def select_tasks(
    agents: DataFrame, tasks: DataFrame, thread: str | None = None, agent: str | None = None, subagent: str | None = None, tool: str | None = None, status: str = "outstanding", limit: int = 10
) -> DataFrame:
    """tool_id, root, activity, page, ambiguous: the newest ``limit`` roots that meet all selectors.

    A thread selects by the agent's or its root's thread, an agent by its id, a sub-agent by id or thread
    among agents that have a parent; a status among documents with such a task. ``ambiguous`` is set where a
    thread, agent or sub-agent names several roots.
    """
    rows = agents if status == "all" else agents.join(tasks.where(of_status(status)).select("document_id").distinct(), "document_id", "left_semi")
    if tool:
        rows = rows.where(F.col("tool_id") == tool)
    if thread:
        rows = rows.where((F.col("thread_id") == thread) | (F.col("root") == thread))
    if agent:
        rows = rows.where(F.col("agent_id") == agent)
    if subagent:
        rows = rows.where(((F.col("agent_id") == subagent) | (F.col("thread_id") == subagent)) & ((F.col("depth") > 0) | F.col("parent_thread_id").isNotNull()))
    found = rows.groupBy("tool_id", "root").agg(F.max("activity").alias("activity"))
    page = found.orderBy(F.desc("activity"), F.desc("tool_id"), F.desc("root")).limit(limit + 1)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("activity"), F.desc("tool_id"), F.desc("root"))
    named = F.lit(bool(thread or agent or subagent)) & (F.count("*").over(Window.partitionBy(F.lit(0))) > 1)
    return page.withColumns({"page": F.row_number().over(order), "ambiguous": named}).where(F.col("page") <= limit)
