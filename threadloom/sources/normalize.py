"""Transcript records of different tools as message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "array<struct<type: string, text: string, thinking: string, name: string, id: string, tool_use_id: string, content: string>>"
CLAUDE = f"type string, uuid string, timestamp string, isMeta boolean, isCompactSummary boolean, operation string, content string, message struct<role: string, content: string, model: string, blocks: {BLOCK}>"


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "string")


def normalize_claude(lines: DataFrame) -> DataFrame:
    """``lines(document_id, line_number, text)`` as document_id, line_number, part, source_id, role, kind, content, thinking, ts.

    A user or assistant record gives a row for each tool block and one for the text
    around them; meta records become system rows, queued prompts user rows; titles
    and other records give none.
    """
    rows = lines.withColumn("r", F.try_parse_json("text")).where("r is not null")
    rows = rows.select(
        "document_id", "line_number", "r", _text(F.col("r"), "$.type").alias("type"), _text(F.col("r"), "$.uuid").alias("uuid"),
        _text(F.col("r"), "$.timestamp").alias("ts"), _text(F.col("r"), "$.message.content").alias("plain"),
        F.coalesce(F.try_variant_get("r", "$.isMeta", "boolean"), F.try_variant_get("r", "$.isCompactSummary", "boolean"), F.lit(False)).alias("meta"),
    )
    is_text = F.schema_of_variant(F.try_variant_get("r", "$.message.content", "variant")) == "STRING"
    blocks = F.from_json(F.when(~is_text, F.col("plain")), BLOCK)
    said = rows.where(F.col("type").isin("user", "assistant")).withColumn("blocks", blocks).withColumn("is_text", F.coalesce(is_text, F.lit(False)))

    def joined(kind: str, field: str) -> Column:
        return F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == kind), lambda b: b[field]), "\n")

    text = F.when(F.col("is_text"), F.col("plain")).otherwise(F.coalesce(joined("text", "text"), F.lit("")))
    thinking = F.when(F.col("is_text"), F.lit("")).otherwise(F.coalesce(joined("thinking", "thinking"), F.lit("")))
    role = F.when(F.col("meta"), "system").when(F.col("is_text") & F.col("plain").rlike("^<command-name>"), "tool").otherwise(F.col("type"))
    kind = F.when(F.col("meta"), "claude_context").when(role == "tool", "local_command").otherwise("text")
    body = said.withColumns({"content": F.when(text == "", thinking).otherwise(text), "thinking": F.when(text == "", "").otherwise(thinking)})
    messages = body.where("content <> ''").select(
        "document_id", "line_number", F.lit(0).alias("part"), F.col("uuid").alias("source_id"), role.alias("role"), kind.alias("kind"), "content", "thinking", "ts"
    )
    tools = said.select("document_id", "line_number", "uuid", "ts", F.posexplode("blocks").alias("i", "b")).where("b.type in ('tool_use', 'tool_result')")
    tools = tools.select(
        "document_id", "line_number", (F.col("i") + 1).alias("part"), F.concat_ws(":", "uuid", "b.type", "i").alias("source_id"), F.lit("tool").alias("role"),
        F.col("b.type").alias("kind"), F.coalesce("b.name", "b.content", F.lit("")).alias("content"), F.lit("").alias("thinking"), "ts",
    )
    queued = rows.where((F.col("type") == "queue-operation") & (_text(F.col("r"), "$.operation") == "enqueue")).withColumn("content", _text(F.col("r"), "$.content"))
    queued = queued.select(
        "document_id", "line_number", F.lit(0).alias("part"), F.coalesce("uuid", F.sha2(F.concat_ws("|", "document_id", "ts", "content"), 256)).alias("source_id"),
        F.lit("user").alias("role"), F.lit("queued").alias("kind"), "content", F.lit("").alias("thinking"), "ts",
    )
    return messages.unionByName(tools).unionByName(queued.where("content <> ''"))


def normalize_codex(lines: DataFrame) -> DataFrame:
    """The same columns for response items and events of the other line format.

    Calls and their outputs become tool rows told apart by the call's id, reasoning an
    assistant row with its visible summary, an interrupted turn a system row.
    """
    rows = lines.withColumn("r", F.try_parse_json("text")).where("r is not null")
    p = {k: _text(F.col("r"), f"$.payload.{k}") for k in ("type", "role", "call_id", "name", "output", "message", "last_agent_message", "reason")}
    rows = rows.select("document_id", "line_number", _text(F.col("r"), "$.timestamp").alias("ts"), _text(F.col("r"), "$.type").alias("outer"), *[v.alias(k) for k, v in p.items()],
                       _text(F.col("r"), "$.payload.content").alias("parts"), _text(F.col("r"), "$.payload.summary").alias("summary"))

    def texts(column: str) -> Column:
        items = F.from_json(column, "array<struct<type: string, text: string>>")
        return F.array_join(F.transform(items, lambda x: x["text"]), "\n")

    t, item = F.col("type"), F.col("outer") == "response_item"
    call, output = item & t.rlike("^(function_call|custom_tool_call|web_search_call)$"), item & t.rlike("^(function_call|custom_tool_call)_output$")
    said = item & (t == "message") & F.col("role").isin("user", "assistant")
    role = F.when(call | output, "tool").when(said, F.col("role")).when(t.isin("agent_message", "task_complete", "reasoning"), "assistant").when(t == "user_message", "user").when(t == "turn_aborted", "system")
    content = (
        F.when(call, F.coalesce("name", F.lit("web_search"))).when(output, F.col("output")).when(said, texts("parts")).when(item & (t == "reasoning"), texts("summary"))
        .when(t.isin("agent_message", "user_message"), F.col("message")).when(t == "task_complete", F.col("last_agent_message"))
        .when(t == "turn_aborted", F.concat_ws(": ", F.lit("Turn interrupted"), "reason"))
    )
    source_id = F.when(call, F.col("call_id")).when(output, F.concat("call_id", F.lit(":output")))
    done = rows.withColumns({"source_id": source_id, "_role": role, "_content": content}).where("_role is not null and coalesce(_content, '') <> ''")
    return done.select("document_id", "line_number", F.lit(0).alias("part"), "source_id", F.col("_role").alias("role"), t.alias("kind"), F.col("_content").alias("content"), F.lit("").alias("thinking"), "ts")


def normalize_generic(lines: DataFrame) -> DataFrame:
    """Rows of any record with a role of its own and a text."""
    rows = lines.withColumn("r", F.try_parse_json("text")).where("r is not null")
    rows = rows.select("document_id", "line_number", _text(F.col("r"), "$.role").alias("role"), _text(F.col("r"), "$.content").alias("content"), _text(F.col("r"), "$.timestamp").alias("ts"))
    return rows.where("role in ('user', 'assistant', 'system') and coalesce(content, '') <> ''").select(
        "document_id", "line_number", F.lit(0).alias("part"), F.lit(None).cast("string").alias("source_id"), "role", F.lit("text").alias("kind"), "content", F.lit("").alias("thinking"), "ts"
    )


COLUMNS = ("document_id", "line_number", "part", "source_id", "role", "kind", "content", "thinking", "ts")


def _said(record: Column, path: str) -> tuple[Column, Column]:
    """Text and thinking of a message's content, a string or a list of blocks; thinking alone is the text."""
    plain = _text(record, path)
    is_text = F.schema_of_variant(F.try_variant_get(record, path, "variant")) == "STRING"
    blocks = F.from_json(F.when(~is_text, plain), BLOCK)

    def joined(kind: str, field: str) -> Column:
        return F.trim(F.coalesce(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == kind), lambda b: b[field]), "\n"), F.lit("")))

    text, thinking = F.when(is_text, F.trim(plain)).otherwise(joined("text", "text")), F.when(is_text, "").otherwise(joined("thinking", "thinking"))
    return F.when(text == "", thinking).otherwise(text), F.when(text == "", "").otherwise(thinking)


def _rows(lines: DataFrame) -> DataFrame:
    parsed = lines.withColumn("r", F.try_parse_json("text")).where("r is not null")
    r = F.col("r")
    return parsed.select("document_id", "line_number", "r", _text(r, "$.type").alias("type"), _text(r, "$.role").alias("own_role"), _text(r, "$.timestamp").alias("ts"))


def _messages(rows: DataFrame, role: Column, kind: Column, content: Column, thinking: Column, source_id: Column | None = None) -> DataFrame:
    """Message rows of the records that have a role and a content."""
    source_id = F.lit(None).cast("string") if source_id is None else source_id
    done = rows.withColumns({"role": role, "kind": kind, "content": content, "thinking": F.coalesce(thinking, F.lit("")), "source_id": source_id, "part": F.lit(0)})
    return done.where("role is not null and trim(coalesce(content, '')) <> ''").select(*COLUMNS)


def normalize_cursor(lines: DataFrame) -> DataFrame:
    """Rows of records with a role and a message, and tool rows of exported states; an exported call's id is its source id."""
    r, t = F.col("r"), F.col("type")
    state = F.coalesce(t.isin("cursor_state_tool", "cursor_state_task", "cursor_state_status"), F.lit(False))
    text, thinking = _said(r, "$.message.content")
    told, _ = _said(r, "$.content")
    name = F.coalesce(_text(r, "$.tool_name"), F.lit("Cursor"))
    role = F.when(state, "tool").when(F.col("own_role").isin("user", "assistant", "system"), F.col("own_role"))
    content = F.when(state, F.coalesce(F.nullif(told, F.lit("")), F.concat(F.lit("["), name, F.lit("]")))).otherwise(text)
    call = F.when(state, F.coalesce(_text(r, "$.tool_call_id"), _text(r, "$.id")))
    return _messages(_rows(lines), role, F.when(state, t).otherwise("text"), content, F.when(~state, thinking), call)


def normalize_openclaw(lines: DataFrame) -> DataFrame:
    """Rows of messages, calls, results and compactions.

    Tool results are tool rows, compactions system rows. The block of facts that leads a
    user's text, and the mark of a reply, are left out. A message written as another
    language's literal isn't evaluated: its record gives no row.
    """
    r, t = F.col("r"), F.col("type")
    rows = _rows(lines)
    inner = F.when(F.schema_of_variant(F.try_variant_get(r, "$.message", "variant")) == "STRING", F.try_parse_json(_text(r, "$.message"))).otherwise(F.try_variant_get(r, "$.message", "variant"))
    rows = rows.withColumn("m", inner)
    text, thinking = _said(F.col("m"), "$.content")
    text = F.when(text.startswith("Conversation info"), F.substring_index(text, "```\n", -1)).otherwise(text)
    text = F.trim(F.replace(text, F.lit("[[reply_to_current]] "), F.lit("")))
    said = _text(F.col("m"), "$.role")
    role = F.when(t.isin("tool_call", "tool_result"), "tool").when(t == "compaction", "system").when((t == "message") & (said == "toolResult"), "tool").when((t == "message") & said.isin("user", "assistant", "tool"), said)
    content = (
        F.when(t == "tool_call", F.concat(F.lit("["), F.coalesce(_text(r, "$.name"), F.lit("tool")), F.lit("]")))
        .when(t == "tool_result", F.coalesce(_text(r, "$.data"), _text(r, "$.output"))).when(t == "compaction", _text(r, "$.summary")).otherwise(text)
    )
    return _messages(rows, role, t, content, F.when(t == "message", thinking))


def normalize_antigravity(lines: DataFrame) -> DataFrame:
    """Rows of users, assistants, tools and systems; a record's own thinking goes beside its text, or stands for it."""
    r, t = F.col("r"), F.col("type")
    text, _ = _said(r, "$.message.content")
    told, _ = _said(r, "$.content")
    thinking = F.trim(F.coalesce(_text(r, "$.thinking_text"), F.lit("")))
    kind = F.coalesce(_text(r, "$.content_source"), _text(r, "$.fallback_source"), t)
    people, tool = t.isin("user", "assistant"), t == "tool"
    role = F.when(people, F.coalesce(_text(r, "$.message.role"), t)).when(tool | (t == "system"), t)
    named = F.concat(F.lit("["), F.coalesce(_text(r, "$.tool_name"), F.lit("tool")), F.lit("]"))
    content = F.when(tool, F.coalesce(F.nullif(told, F.lit("")), named)).when(people & (F.coalesce(text, F.lit("")) == ""), thinking).otherwise(text)
    return _messages(_rows(lines), role, F.when(tool, t).otherwise(kind), content, F.when(people, thinking))


def normalize_hermes(docs: DataFrame) -> DataFrame:
    """Rows of whole sessions ``docs(document_id, text)``, one JSON object each.

    System messages give no row; a tool's row names the tool of its call as its kind. All
    rows bear the session's last time. The line number is the message's place.
    """
    session = F.from_json("text", "last_updated string, session_start string, messages array<struct<role: string, content: string, tool_call_id: string, tool_calls: array<struct<id: string, call_id: string, function: struct<name: string>>>>>")
    rows = docs.select("document_id", session.alias("s")).select("document_id", F.coalesce("s.last_updated", "s.session_start").alias("ts"), F.posexplode("s.messages").alias("place", "m"))
    calls = rows.select("document_id", "place", F.explode("m.tool_calls").alias("c")).select("document_id", "place", F.coalesce("c.id", "c.call_id").alias("tool_call_id"), "c.function.name")
    names = calls.where("name is not null").groupBy("document_id", "tool_call_id").agg(F.max_by("name", "place").alias("name"))
    said = rows.where("m.role in ('user', 'assistant', 'tool')").withColumn("tool_call_id", F.col("m.tool_call_id")).join(names, ["document_id", "tool_call_id"], "left")
    said = said.withColumn("line_number", F.col("place") + 1)
    kind = F.when(F.col("m.role") == "tool", F.coalesce("name", F.lit("tool"))).otherwise("text")
    return _messages(said, F.col("m.role"), kind, F.trim(F.col("m.content")), F.lit(""), F.when(F.col("m.role") == "tool", F.col("tool_call_id")))
