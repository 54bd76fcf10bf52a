"""Project contexts in bounded lists, and exports in reading order."""

import glob

from threadloom.operators import context

DOC = "document_id long, project string, category string, title string, content string, summary string, synced long"


def docs(spark):
    rows = [(i, "p", "note", f"n{i}", "text", None, i) for i in range(3)] + [
        (10, "p", "conversation", "talk", "long words", "short", 5), (11, "p", "zebra", None, None, None, 1), (12, "p", "memory", " ", "x" * 50, None, 1),
        (13, "p", "memory", "new", "m\nlines", None, 9), (14, "q", "memory", "other", "no", None, 1), (15, "p", None, "bare", "b", None, 1),
    ]
    return spark.createDataFrame(rows, DOC)


def test_reading_order(spark, tmp_path):
    context.export_project_markdown(docs(spark), "p", str(tmp_path / "out"), chars=40)
    text = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "out" / "part-*"))))
    titles = [line[3:] for line in text.splitlines() if line.startswith("## ")]
    assert titles == ["new", "Untitled", "n2", "n1", "n0", "talk", "bare", "Untitled"]
    assert "x" * 40 + "\n\n[cut]" in text and "short" in text and "long words" not in text
    assert context.project_sections(docs(spark), "nowhere").count() == 0


def test_lists_are_bounded(spark):
    entities = spark.createDataFrame([(i, None if i % 2 else 1, f"Proj{i:02}", "tool") for i in range(30)] + [(90, 2, "Proj99", "tool")], "entity_id long, user_id long, name string, type string")
    relations = spark.createDataFrame([(0, t, "uses", t % 3) for t in range(1, 30)], "source_id long, target_id long, type string, strength long")
    facts = spark.createDataFrame([(1, f"f{i}", f"2024-01-{i + 1:02}") for i in range(9)], "entity_id long, content string, observed string")
    found = context.graph_context(docs(spark), entities, relations, facts, "p", "proj", user_id=1).collect()
    count = {s: sum(r["section"] == s for r in found) for s in ("documents", "recent", "note", "entity", "edge", "fact")}
    assert count == {"documents": 5, "recent": 1, "note": 2, "entity": 10, "edge": 10, "fact": 5}
    assert next(r["text"] for r in found if r["section"] == "fact" and r["place"] == 1) == "[2024-01-09] f8"
    assert next(r["text"] for r in found if r["section"] == "edge" and r["place"] == 1) == "uses Proj02"
    assert context.graph_context(docs(spark), entities.limit(0), relations, facts, "nowhere", "x").collect() == []
