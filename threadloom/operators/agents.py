"""Agents of a conversation: their sidecars, lifecycle, cards, questions and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import normalize_status

#: Statuses that end a child, and the lengths that a sidecar's fields keep.
TERMINAL = ("completed", "failed", "cancelled")
DESCRIPTION_CHARS, CALL_CHARS, TYPE_CHARS = 1024, 256, 128
#: Tasks of one snapshot, and the lengths of their fields.
MAX_TASKS, TASK_ID_CHARS, TASK_TEXT_CHARS = 200, 256, 16_000
#: Signals that one document takes from the inbox.
INBOX_SIGNALS = 256


def _filled(text: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def aliases(identity: Column) -> Column:
    """An agent's id with and without its prefix; none for a blank one."""
    plain = _filled(identity)
    other = F.when(plain.startswith("agent-"), F.regexp_replace(plain, "^agent-", "")).otherwise(F.concat(F.lit("agent-"), plain))
    return F.array_compact(F.array(plain, other))


def overlay_child_runtime(events: DataFrame, children: DataFrame) -> DataFrame:
    """event_id, document_id, runtime: the child of the event's root that a lifecycle event speaks of.

    ``events(event_id, root, tool_use_id, thread_id)`` meet
    ``children(root, document_id, tool_use_id, agent_id, thread_id, runtime)`` by the
    launching call, else by any alias of their thread; the last child of a key counts.
    """
    last = F.max_by(F.struct("document_id", "runtime"), "document_id")
    calls = children.where(_filled(F.col("tool_use_id")).isNotNull()).groupBy("root", "tool_use_id").agg(last.alias("by_call"))
    names = F.array_union(aliases(F.col("agent_id")), aliases(F.col("thread_id")))
    threads = children.withColumn("alias", F.explode(names)).groupBy("root", "alias").agg(last.alias("by_alias"))
    asked = events.select("event_id", "root", F.explode(aliases(F.col("thread_id"))).alias("alias"))
    named = asked.join(threads, ["root", "alias"]).groupBy("event_id").agg(F.max("by_alias").alias("by_alias"))
    child = F.coalesce("by_call", "by_alias")
    found = events.join(calls, ["root", "tool_use_id"], "left").join(named, "event_id", "left")
    return found.select("event_id", child["document_id"].alias("document_id"), child["runtime"].alias("runtime"))


def attach_sidecars(docs: DataFrame) -> DataFrame:
    """document_id, sidecar_id, agent_id, description, tool_use_id, agent_type of agents' transcripts.

    Transcript and sidecar of ``docs(document_id, machine_id, relative_path, content)``
    are siblings on one machine. A sidecar that is no JSON object, or names another
    agent, is passed over; fields that hold control characters are left out.
    """
    name = r"(?:^|/)subagents/(?:.*/)?agent-([A-Za-z0-9][A-Za-z0-9_-]{0,127})\.(meta\.json|jsonl)$"
    files = docs.withColumns({
        "agent_id": F.regexp_extract("relative_path", name, 1), "suffix": F.regexp_extract("relative_path", name, 2),
        "stem": F.regexp_replace("relative_path", r"\.(meta\.json|jsonl)$", ""),
    }).where("agent_id <> ''")
    side = files.where("suffix = 'meta.json'").withColumn("v", F.try_parse_json("content")).where(F.schema_of_variant("v").startswith("OBJECT"))

    def field(key: str, size: int) -> Column:
        text = F.trim(F.try_variant_get("v", f"$.{key}", "string"))
        return F.when((text != "") & ~text.rlike(r"[\x00-\x1f]"), F.substring(text, 1, size))

    side = side.where(F.coalesce(F.try_variant_get("v", "$.agentId", "string"), F.col("agent_id")) == F.col("agent_id"))
    side = side.select(
        "machine_id", "stem", F.col("document_id").alias("sidecar_id"), field("description", DESCRIPTION_CHARS).alias("description"),
        field("toolUseId", CALL_CHARS).alias("tool_use_id"), field("agentType", TYPE_CHARS).alias("agent_type"),
    )
    script = files.where("suffix = 'jsonl'").select("machine_id", "stem", "document_id", "agent_id")
    return script.join(side, ["machine_id", "stem"]).select("document_id", "sidecar_id", "agent_id", "description", "tool_use_id", "agent_type")


def apply_inbox(signals: DataFrame, docs: DataFrame, now: int, most: int = INBOX_SIGNALS) -> DataFrame:
    """document_id, signal_id, place: the unexpired signals of each document, oldest first, ``most`` at once.

    ``signals(signal_id, session, path, title_thread, received, expires)`` reach
    ``docs(document_id, session, path, thread)`` by session, else by path, else by the
    thread of a title. What is beyond ``most`` stays for the next run.
    """
    live = signals.where(F.col("expires") > now)
    rows = None
    for rank, (key, target) in enumerate((("session", "session"), ("path", "path"), ("title_thread", "thread"))):
        routes = live.where(F.col(key).isNotNull()).select("signal_id", "received", F.col(key).alias("route"))
        reached = routes.join(docs.select("document_id", F.col(target).alias("route")), "route").withColumn("rank", F.lit(rank))
        rows = reached if rows is None else rows.unionByName(reached)
    best = F.min("rank").over(Window.partitionBy("signal_id"))
    chosen = rows.withColumn("best", best).where("rank = best")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("received", "signal_id"))
    return chosen.select("document_id", "signal_id", place.alias("place")).where(F.col("place") <= most)


def associate_code_blocks(refs: DataFrame, blocks: DataFrame, reach: int = 2000) -> DataFrame:
    """ref_id, block_id: the next block at or behind a reference, within ``reach`` characters.

    ``refs(message_id, ref_id, position)`` and ``blocks(message_id, block_id, position)``
    lie in one message's text. A message's only reference may take its first block.
    """
    near = F.col("b").between(F.col("position"), F.col("position") + reach)
    spot = F.struct("b", "block_id")
    alone = F.count("*").over(Window.partitionBy("message_id")) == 1
    pairs = refs.withColumn("alone", alone).join(blocks.select("message_id", "block_id", F.col("position").alias("b")), "message_id")
    picked = pairs.groupBy("ref_id").agg(F.min(F.when(near, spot)).alias("next"), F.min(F.when(F.col("alone"), spot)).alias("first"))
    return picked.select("ref_id", F.coalesce("next.block_id", "first.block_id").alias("block_id")).where("block_id is not null")


def link_answers(rows: DataFrame) -> DataFrame:
    """document_id, line_number, answer_line, answer: each question card with its answer, if there is one.

    ``rows(document_id, line_number, kind, call_id, content)``: a question takes the
    first answer behind it with its call's id; one without a call takes the next prompt.
    """
    call = Window.partitionBy("document_id", "call_id").orderBy("line_number").rowsBetween(1, Window.unboundedFollowing)
    line = Window.partitionBy("document_id").orderBy("line_number").rowsBetween(1, Window.unboundedFollowing)
    found = F.struct("line_number", "content")
    called = F.first(F.when(F.col("kind") == "answer", found), ignorenulls=True).over(call)
    said = F.first(F.when(F.col("kind") == "prompt", found), ignorenulls=True).over(line)
    linked = rows.withColumn("said", said).where("kind <> 'prompt'").withColumn("a", F.when(F.col("call_id").isNull(), F.col("said")).otherwise(called))
    return linked.where("kind = 'question'").select("document_id", "line_number", F.col("a.line_number").alias("answer_line"), F.col("a.content").alias("answer"))


def merge_lifecycle_events(events: DataFrame) -> DataFrame:
    """Runs of adjacent events of one identity and kind as one event each.

    Of ``events(document_id, line_number, identity, kind, label, started_at, model)`` a run
    keeps its first line, the earliest start, its last label that says more than that
    there is an agent, and its last model. Events without identity stay as they are.
    """
    order = Window.partitionBy("document_id").orderBy("line_number")
    same = F.col("identity").eqNullSafe(F.lag("identity").over(order)) & F.col("kind").eqNullSafe(F.lag("kind").over(order)) & F.col("identity").isNotNull()
    runs = events.withColumn("new", (~same).cast("int")).withColumn("run", F.sum("new").over(order))
    told = F.when(_filled(F.col("label")) != "Subagent", F.trim("label"))
    return runs.groupBy("document_id", "run").agg(
        F.min("line_number").alias("line_number"), F.first("identity").alias("identity"), F.first("kind").alias("kind"),
        F.coalesce(F.max_by(told, F.when(told.isNotNull(), F.col("line_number"))), F.lit("Subagent")).alias("label"),
        F.min("started_at").alias("started_at"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("line_number"))).alias("model"),
        F.count("*").alias("merged"),
    ).drop("run")


def child_lifecycle(lines: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """document_id, status: the last end that a child's transcript shows, else its last status.

    ``stored(document_id, status)`` is what is known: an end isn't undone by a status that isn't one.
    """
    over = F.col("status").isin(*TERMINAL)
    seen = lines.where("status is not null").groupBy("document_id").agg(F.max_by("status", F.struct(over, "line_number")).alias("status"))
    if stored is None:
        return seen
    both = seen.join(stored.select("document_id", F.col("status").alias("known")), "document_id", "full")
    stays = F.col("status").isNull() | (F.col("known").isin(*TERMINAL) & ~F.col("status").isin(*TERMINAL))
    return both.select("document_id", F.when(stays, F.col("known")).otherwise(F.col("status")).alias("status"))


def clean_task_state(tasks: Column) -> Column:
    """A snapshot's tasks with an id of their own, bounded fields and usual statuses.

    Tasks without content and repeated ids go; a missing id is the task's place, an
    unknown status is pending.
    """

    def cleaned(task: Column, i: Column) -> Column:
        return F.struct(
            F.coalesce(_filled(F.substring(F.trim(task["id"]), 1, TASK_ID_CHARS)), F.concat(F.lit("task-"), (i + 1).cast("string"))).alias("id"),
            F.substring(F.trim(task["content"]), 1, TASK_TEXT_CHARS).alias("content"),
            F.coalesce(normalize_status(task["status"]), F.lit("pending")).alias("status"),
        )

    rows = F.filter(F.transform(F.slice(tasks, 1, MAX_TASKS), cleaned), lambda t: t["content"] != "")
    return F.filter(rows, lambda t, i: F.array_position(F.transform(rows, lambda x: x["id"]), t["id"]) == i + 1)


def display_title(child: Column, tool: Column, description: Column, title: Column) -> Column:
    """A child's title is what it was launched for, where its tool tells."""
    return F.coalesce(F.when(child & (tool == "claude_code"), _filled(description)), title)


def role_origin(child: Column, tool: Column) -> Column:
    """Whose words a child's user turns are."""
    return F.when(child & tool.isin("claude_code", "cursor"), "parent_agent")


def subagent_summaries(folded: DataFrame, docs: DataFrame) -> DataFrame:
    """One card for each child of a visible root: canonical_id, document_id, title, status.

    ``docs(document_id, tool_id, thread, title, description, agent_path, nickname, status)``:
    the title is the launch's description, else the agent's path in words, its
    nickname, the document's title, or the begin of its thread.
    """
    path = _filled(F.regexp_replace(F.regexp_extract(F.rtrim(F.col("agent_path"), F.lit("/")), "[^/]*$", 0), r"[_\-\s]+", " "))
    thread = F.coalesce(F.concat(F.lit("Subagent "), F.substring("thread", 1, 8)), F.lit("Subagent"))
    launched = F.when(F.col("tool_id") == "claude_code", _filled(F.col("description")))
    title = F.coalesce(launched, path, _filled(F.col("nickname")), _filled(F.col("title")), thread)
    children = folded.where(F.col("document_id") != F.col("canonical_id")).select("canonical_id", "document_id")
    return children.join(docs, "document_id").select("canonical_id", "document_id", title.alias("title"), F.coalesce("status", F.lit("unknown")).alias("status"))


def merge_event_summaries(cards: DataFrame, events: DataFrame) -> DataFrame:
    """Cards with what the newest event of their launch tells, and pending cards for launches without a document.

    ``cards(root, tool_use_id, document_id, title, status)``, ``events(root, tool_use_id,
    line_number, label, status)``. An end is final: a repeated start behind it changes nothing.
    """
    over = F.col("status").isin(*TERMINAL)
    told = F.when(_filled(F.col("label")) != "Subagent", F.trim("label"))
    newest = events.groupBy("root", "tool_use_id").agg(
        F.max_by("status", F.struct(over, "line_number")).alias("_status"), F.max_by(told, F.when(told.isNotNull(), F.col("line_number"))).alias("_label")
    )
    both = cards.join(newest, ["root", "tool_use_id"], "full")
    kept = F.col("_status").isNull() | (F.col("status").isin(*TERMINAL, "disconnected") & (F.col("_status") == "running"))
    return both.select(
        "root", "tool_use_id", "document_id", F.coalesce("_label", "title", F.lit("Subagent")).alias("title"),
        F.coalesce(F.when(kept, F.col("status")).otherwise(F.col("_status")), F.lit("unknown")).alias("status"), F.col("document_id").isNotNull().alias("ready"),
    )
