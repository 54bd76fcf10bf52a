"""Task lists row by row, in batch and as a stream, and forests of any depth."""

import json
import random

import pytest

from threadloom.operators import tasks
from threadloom.streaming.runs import run_available

MESSAGE = "document_id long, line_number long, source string, tool string, call_id string, input string, content string"


def steps(rows):
    held, out = tasks.TaskList(), []
    for tool, payload, *rest in rows:
        call, content, source = (*rest, "", "", "")[:3]
        found = held.apply({"tool": tool, "input": json.dumps(payload), "call_id": call, "content": content, "source": source})
        out.append(found and ([(t["id"], t["content"], t["status"]) for t in found["tasks"]], found["quality"], found["active_task_id"]))
    return out


def test_results_name_new_tasks_and_list_them():
    out = steps([
        ("TaskCreate", {"subject": "first"}, "call1"), ("TaskCreate", {"subject": "second"}),
        ("tool_result", {}, "call1", "Task #7 created successfully: First one"), ("TaskList", {}, "call3"),
        ("tool_result", {}, "other", "#9 [pending] not asked for"), ("tool_result", {}, "call3", "#7 [in progress] go\nnoise\n#8 [done] gone"),
        ("tool_result", {}, "call3", "#1 [pending] no longer asked"), ("tool_result", {}, "", "#1 [pending] listed alone\n", "claude_code"),
    ])
    assert out[0] == ([("call1", "first", "pending")], "authoritative", "call1")
    assert out[2][0] == [("7", "First one", "pending"), ("pending-2-2", "second", "pending")]
    assert out[3] is None and out[4] is None and out[6] is None
    assert out[5] == ([("7", "go", "in_progress"), ("8", "gone", "completed")], "authoritative", "7")
    assert out[7][0] == [("1", "listed alone", "pending")]


def test_unknown_tasks_make_a_list_partial_until_it_is_replaced():
    out = steps([
        ("TaskUpdate", {"taskId": "4", "status": "ACTIVE"}), ("mcp__x__TaskStop", {"id": 5}), ("Bash", {"id": 1}), ("TaskUpdate", {"status": "done"}),
        ("TodoWrite", {"merge": True, "todos": []}), ("TodoWrite", {"merge": 1}, "", json.dumps({"finalTodos": [{"content": "end", "is_current": 1}]})), ("update_plan", {"plan": [], "is_current": True}),
    ])
    assert out[0] == ([("4", "Task #4", "in_progress")], "partial", "4")
    assert out[1][:2] == ([("4", "Task #4", "in_progress"), ("5", "Task #5", "cancelled")], "partial") and out[2:5] == [None, None, None]
    assert [t[1] for t in out[5][0]] == ["Task #4", "Task #5", "end"] and out[6] == ([], "explicit_current", "")


def test_bounds_can_be_lifted():
    many = {"todos": [{"id": str(i), "content": "x" * 5000} for i in range(250)]}
    row = {"tool": "TodoWrite", "input": json.dumps(many), "call_id": None, "content": None, "source": None}
    assert [(f["total"], len(f["tasks"][0]["content"])) for f in (tasks.TaskList().apply(row), tasks.TaskList(bounded=False).apply(row))] == [(200, 4000), (250, 5000)]


def messages(spark, rng):
    rows = []
    for d in range(6):
        for line in range(1, 15):
            tool, payload = rng.choice([
                ("TodoWrite", {"todos": [{"id": "1", "content": f"a{line}"}, {"content": "free"}]}), ("TaskCreate", {"subject": f"s{line}"}),
                ("TaskUpdate", {"taskId": rng.choice("123"), "status": "done"}), ("tool_result", {}), ("Bash", {}), (None, None),
            ])
            rows.append((d, line, "codex", tool, f"c{line}", json.dumps(payload), f"Task #{line} created successfully"))
    return spark.createDataFrame(rows, MESSAGE)


def test_stream_goes_on_where_the_last_batch_ended(spark, tmp_path):
    frame = messages(spark, random.Random(2))
    expected = sorted(map(str, tasks.track_tasks(frame.repartition(3)).collect()))
    for low in (0, 5, 10):
        frame.where(f"line_number > {low} and line_number <= {low + 5}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        found = run_available(tasks.task_state(stream), "tasks", str(tmp_path / "out"))
    assert sorted(map(str, found.collect())) == expected
    assert tasks.track_tasks(frame.limit(0)).collect() == []


def agents(spark, parents, **more):
    rows = [(i, "codex", "r", t, p, more.get("depth", {}).get(t, 0), more.get("activity", {}).get(t, 0), True) for i, (t, p) in enumerate(parents)]
    return spark.createDataFrame(rows, "document_id long, tool_id string, root string, thread_id string, parent_thread_id string, depth int, activity long, has_state boolean")


@pytest.mark.parametrize("deep", [1, 2, 7, 70])
def test_chains_of_any_depth_and_circles(spark, deep):
    chain = [("n0", "")] + [(f"n{i}", f"n{i - 1}") for i in range(1, deep)]
    circle = [("x", "y"), ("y", "z"), ("z", "x"), ("under", "x"), ("self", "self"), ("lost", "nobody"), ("child", "lost")]
    found = {r["thread_id"]: (r["level"], r["quality"]) for r in tasks.task_forest(agents(spark, chain + circle)).collect()}
    assert [found[f"n{i}"] for i in range(deep)] == [(i, "complete") for i in range(deep)]
    assert all(found[t] == (0, "cycle") for t in ("x", "y", "z", "under", "self"))
    assert found["lost"] == (0, "missing_parent") and found["child"] == (1, "complete")


def test_order_and_copies(spark):
    frame = agents(spark, [("a", None), ("c", "a"), ("b", "a"), ("d", "b"), ("b", "a"), ("e", "a")], activity={"c": 5, "b": 9, "e": 5}, depth={"e": 1})
    rows = tasks.task_forest(frame).orderBy("place").collect()
    assert [(r["thread_id"], r["place"]) for r in rows] == [("a", 1), ("c", 2), ("b", 3), ("d", 4), ("e", 5)]
    assert {r["document_id"] for r in rows if r["thread_id"] == "b"} == {4}
    assert tasks.task_forest(frame.limit(0)).collect() == []
