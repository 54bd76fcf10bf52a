import json

from pyspark.sql import functions as F

from threadloom.sources import normalize as N
from threadloom.sources import transcripts as S


def write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder)


def test_transcripts_keep_malformed_lines(spark, tmp_path):
    rows = ['{"type":"user","timestamp":"2024-01-02T00:00:00Z"}', "", "{broken", '{"type":"ai-title","aiTitle":"T","timestamp":"2024-01-03T00:00:00Z"}']
    lines = S.read_transcripts(spark, write(tmp_path, "a.jsonl", "\n".join(rows)))
    assert lines.count() == 3 and lines.where("not valid").count() == 1
    stats = S.transcript_files(lines).first()
    assert (stats["lines"], stats["types"], stats["ai_title"], stats["first_ts"][:10]) == (3, {"user": 1, "ai-title": 1}, "T", "2024-01-02")


def test_framing_ignores_braces_in_strings(spark):
    text = '{"a": "}{"}\n{"b": {"c": "\\"}"}} {bad} junk {"d": 1'
    found = S.frame_json_objects(spark.createDataFrame([(1, text), (2, None)], "i int, t string"), "t").collect()
    assert [(r["i"], json.loads(r["record"])) for r in found] == [(1, {"a": "}{"}), (1, {"b": {"c": '"}'}})]


def test_note_titles(spark, tmp_path):
    write(tmp_path, "one.md", "---\ntitle: 'Named'\n---\n# Head\nbody")
    write(tmp_path, "two.md", "text\n# Head two\n")
    notes = S.read_markdown_notes(spark, write(tmp_path, "three.md", "no heading"))
    assert {(r["title"], r["body"][:6]) for r in notes.collect()} == {("Named", "# Head"), ("Head two", "text\n#"), ("three", "no hea")}


def test_json_documents(spark, tmp_path):
    write(tmp_path, "a.json", '{"x": 1, "y": 2}')
    docs = S.read_json_documents(spark, write(tmp_path, "b.json", "{oops"))
    assert {(r["parsed"], tuple(r["keys"] or ())) for r in docs.collect()} == {(True, ("x", "y")), (False, ())}


def test_first_rule_classifies(spark):
    paths = spark.createDataFrame([("p/a.jsonl",), ("p/cache/a.jsonl",), ("q/x.bin",)], "path string")
    rules = spark.createDataFrame([(1, "/cache/", "", "", "", True), (2, r"\.jsonl$", "codex", "conversation", "jsonl", False)], "priority int, pattern string, tool string, category string, kind string, excluded boolean")
    assert [(r["path"], r["tool"]) for r in S.classify_paths(paths, rules).collect()] == [("p/a.jsonl", "codex")]


def lines(spark, *records):
    return spark.createDataFrame([(1, i + 1, json.dumps(r)) for i, r in enumerate(records)], "document_id int, line_number int, text string")


def test_claude_records(spark):
    rows = N.normalize_claude(lines(
        spark,
        {"type": "user", "uuid": "u", "timestamp": "t", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "uuid": "a", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Bash", "id": "x"}]}},
        {"type": "user", "uuid": "c", "isMeta": True, "message": {"content": "context"}},
        {"type": "user", "uuid": "d", "message": {"content": "<command-name>/x</command-name>"}},
        {"type": "queue-operation", "operation": "enqueue", "content": "later"},
        {"type": "ai-title", "aiTitle": "T"},
        {"type": "assistant", "uuid": "e", "message": {"content": [{"type": "thinking", "thinking": "only"}]}},
    )).orderBy("line_number", "part").collect()
    assert [(r["line_number"], r["role"], r["kind"], r["content"], r["thinking"]) for r in rows] == [
        (1, "user", "text", "hello", ""), (2, "assistant", "text", "hi", "hm"), (2, "tool", "tool_use", "Bash", ""), (3, "system", "claude_context", "context", ""),
        (4, "tool", "local_command", "<command-name>/x</command-name>", ""), (5, "user", "queued", "later", ""), (7, "assistant", "text", "only", ""),
    ]


def test_codex_records(spark):
    def item(**p):
        return {"type": "response_item", "payload": p}

    rows = N.normalize_codex(lines(
        spark, item(type="message", role="user", content=[{"type": "input_text", "text": "do"}]), item(type="message", role="developer", content=[{"text": "no"}]),
        item(type="function_call", name="shell", call_id="c"), item(type="function_call_output", output="ok", call_id="c"),
        item(type="reasoning", summary=[{"type": "summary_text", "text": "why"}]), {"type": "event_msg", "payload": {"type": "turn_aborted", "reason": "esc"}},
    )).orderBy("line_number").collect()
    assert [(r["role"], r["content"], r["source_id"]) for r in rows] == [
        ("user", "do", None), ("tool", "shell", "c"), ("tool", "ok", "c:output"), ("assistant", "why", None), ("system", "Turn interrupted: esc", None)
    ]


def test_rendered_conversation(spark):
    messages = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "user", "c")], "document_id int, line_number int, role string, content string")
    assert S.render_markdown(messages).first()["markdown"] == "## Prompt 1\n\na\n\n### Assistant\n\nb\n\n## Prompt 2\n\nc"


def test_snapshots(spark, tmp_path):
    S.snapshot_tables({"t": spark.range(3)}, "2024-01-02", str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/t").select(F.max("id")).first()[0] == 2
    dates = spark.createDataFrame([("2024-01-01",), ("2024-01-20",)], "date string")
    assert [r["date"] for r in S.kept_snapshots(dates, "2024-01-21").collect()] == ["2024-01-20"]


def rows_of(spark, normalize, records):
    lines = [("d", i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    found = normalize(spark.createDataFrame(lines, "document_id string, line_number int, text string"))
    return [(r["line_number"], r["role"], r["kind"], r["content"], r["thinking"], r["source_id"]) for r in found.orderBy("line_number").collect()]


def test_cursor_records(spark):
    blocks = [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "yes"}, {"type": "tool_use", "name": "x"}]
    found = rows_of(spark, N.normalize_cursor, [
        {"role": "user", "message": {"content": "ask "}}, {"role": "assistant", "message": {"content": blocks}}, {"role": "assistant", "message": {"content": []}},
        {"type": "cursor_state_tool", "tool_name": "Read", "tool_call_id": "c1", "content": ""}, {"type": "cursor_state_status", "content": "done", "id": "c2"}, "{broken",
    ])
    assert found == [
        (1, "user", "text", "ask", "", None), (2, "assistant", "text", "yes", "hm", None),
        (4, "tool", "cursor_state_tool", "[Read]", "", "c1"), (5, "tool", "cursor_state_status", "done", "", "c2"),
    ]


def test_openclaw_records(spark):
    found = rows_of(spark, N.normalize_openclaw, [
        {"type": "message", "message": {"role": "user", "content": "Conversation info\n```json\n{}\n```\nreal [[reply_to_current]] ask"}},
        {"type": "message", "message": json.dumps({"role": "toolResult", "content": [{"type": "text", "text": "out"}]})}, {"type": "message", "message": "{'role': 'user'}"},
        {"type": "message", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "only"}]}}, {"type": "compaction", "summary": "short"},
        {"type": "session"}, {"type": "tool_call", "name": "run"}, {"type": "tool_result", "output": "ok"},
    ])
    assert found == [
        (1, "user", "message", "real ask", "", None), (2, "tool", "message", "out", "", None), (4, "assistant", "message", "only", "", None),
        (5, "system", "compaction", "short", "", None), (7, "tool", "tool_call", "[run]", "", None), (8, "tool", "tool_result", "ok", "", None),
    ]


def test_antigravity_records(spark):
    found = rows_of(spark, N.normalize_antigravity, [
        {"type": "session_meta"}, {"type": "user", "message": {"content": "ask"}}, {"type": "assistant", "message": {"content": ""}, "thinking_text": "hm"},
        {"type": "assistant", "message": {"role": "assistant", "content": "yes"}, "thinking_text": "hm", "content_source": "pb"}, {"type": "tool", "tool_name": "grep"}, {"type": "system", "message": {"content": " "}},
    ])
    assert [f[:5] for f in found] == [
        (2, "user", "user", "ask", ""), (3, "assistant", "assistant", "hm", "hm"), (4, "assistant", "pb", "yes", "hm"), (5, "tool", "tool", "[grep]", ""),
    ]


def test_hermes_sessions(spark):
    session = {"last_updated": "t2", "session_start": "t1", "messages": [
        {"role": "system", "content": "s"}, {"role": "user", "content": " ask "}, {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "function": {"name": "run"}}]},
        {"role": "tool", "content": "out", "tool_call_id": "c1"}, {"role": "tool", "content": "lost", "tool_call_id": "c9"},
    ]}
    docs = spark.createDataFrame([("d", json.dumps(session)), ("e", "{oops"), ("f", None)], "document_id string, text string")
    found = [(r["line_number"], r["role"], r["kind"], r["content"], r["ts"]) for r in N.normalize_hermes(docs).orderBy("line_number").collect()]
    assert found == [(2, "user", "text", "ask", "t2"), (4, "tool", "run", "out", "t2"), (5, "tool", "tool", "lost", "t2")]
