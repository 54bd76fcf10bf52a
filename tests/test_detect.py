"""Artifacts by reference, projects by what is told."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import detect

CASES = {
    "see [Board](out/Board.canvas.tsx?x=1) and out/board.canvas.tsx.": [("out/Board.canvas.tsx", "Board")],
    "[my.canvas.tsx](https://h/x) then b.canvas.tsx, c.canvas.tsxx": [("my.canvas.tsx", "my"), ("b.canvas.tsx", "b")],
    "C:\\a\\one.canvas.tsx ../two.canvas.tsx vbs:three.canvas.tsx": [("C:\\a\\one.canvas.tsx", "one")],
    "[a](x%20y.canvas.tsx) [b](other) https://h.org/z.canvas.tsx": [("x y.canvas.tsx", "x y"), ("https://h.org/z.canvas.tsx", "z")],
    "none": [], "": [], None: [],
}


@pytest.mark.parametrize("text", CASES)
def test_artifacts(spark, text):
    found = spark.createDataFrame([(text,)], "t string").select(detect.detect_artifacts(F.col("t")).alias("x")).first()["x"]
    assert [tuple(a) for a in found] == CASES[text]


def test_artifacts_are_bounded(spark):
    rows = spark.createDataFrame([(" ".join(f"n{i}.canvas.tsx" for i in range(30)),)], "t string")
    assert [len(r) for r in rows.select(detect.detect_artifacts(F.col("t")), detect.detect_artifacts(F.col("t"), None)).first()] == [12, 30]


def test_projects(spark):
    rows = [
        (1, "codex", 1, "conversation", 'x "cwd" : "/home/me/app/" y', None, "s"), (2, "codex", 1, "conversation", "", None, "s"), (3, "codex", 2, "conversation", "", None, "s"),
        (4, "codex", 1, "note", '"cwd": "/home/x"', None, None), (5, "codex", 1, "note", None, "plain\x01tail", None), (6, "claude_code", 1, "conversation", None, "-Users-me-site", None),
        (7, "codex", 1, "conversation", '"cwd": "\\\\?\\D:\\dev\\tool"', "0123abcd-1", None), (8, "codex", 1, "conversation", '"cwd": "/home/x"', "named", "s"),
    ]
    docs = spark.createDataFrame(rows, "document_id long, tool_id string, machine_id long, category string, content string, project_hash string, session_id string")
    found = {r["document_id"]: r["project"] for r in detect.infer_project(docs).collect()}
    assert found == {1: "app", 2: "app", 3: None, 4: None, 5: "plain", 6: "site", 7: "tool", 8: "named"}
    assert detect.infer_project(docs.limit(0)).collect() == []


def test_encoded_paths(spark):
    names = {"-Users-me-Desktop-dev-python-quant-future": "quant-future", "d--dev-1106-book": "book", "C--": "C", "Users-x-ft-data": "ft-data"}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["x"] for r in rows.select("n", detect.readable_name(F.col("n")).alias("x")).collect()} == names
