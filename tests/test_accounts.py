"""An account goes out, comes in elsewhere and goes out again: the same up to ids."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import accounts


def tables(spark):
    def t(rows, schema):
        return spark.createDataFrame(rows, schema)

    return {
        "machines": t([("m1", "Home", "1.0", None, 1), ("m2", "Work", None, None, 1), ("m3", "Other", None, None, 2)], accounts.COLUMNS["machines"] + ", user_id long"),
        "projects": t([("p1", "one", "One", "codex", "/x", None), ("p2", "two", None, None, None, None), ("p9", "foreign", "F", None, None, None)], accounts.COLUMNS["projects"]),
        "documents": t([
            ("d1", "codex", "p1", "m1", "a.md", "memory", "text", "A", "text a", "h1", 6, None, None, None), ("d2", "codex", None, "m2", "b.md", "note", "text", None, "text b", "h2", 6, "sum", None, None),
            ("d3", "cursor", "p2", "m1", "c.md", None, None, None, None, None, None, None, None, None), ("d9", "codex", "p9", "m3", "z.md", "memory", "text", "Z", "secret", "h9", 6, None, None, None),
        ], accounts.COLUMNS["documents"]).withColumn("rendered_html", F.lit("<p>")),
        "conversation_messages": t([("d1", 1, "text", "user", "hi", None), ("d1", 2, "text", "assistant", "yes", None), ("d9", 1, "text", "user", "no", None)], accounts.COLUMNS["conversation_messages"]),
        "document_versions": t([("d2", "h2", "+b", 6, None), ("d9", "h9", "+z", 6, None)], accounts.COLUMNS["document_versions"]),
        "daily_summaries": t([("2024-01-01", "codex", "Day", "s", ["d9", "d2", "d1"], None, 1), ("2024-01-02", None, "Day", "s", None, None, 1), ("2024-01-01", "codex", "x", "y", ["d9"], None, 2)], accounts.COLUMNS["daily_summaries"] + ", user_id long"),
        "knowledge_entities": t([("e1", "Spark", "tool", "engine", None, 1), ("e2", "Ada", "person", None, None, 1), ("e9", "Spark", "tool", None, None, 2)], accounts.COLUMNS["knowledge_entities"] + ", user_id long"),
        "knowledge_relations": t([("e1", "e2", "used_by", 2.0, None), ("e1", "e9", "like", 1.0, None), ("e1", "e2", "used_by", 1.0, None)], accounts.COLUMNS["knowledge_relations"]),
        "knowledge_observations": t([("e1", "fast", "d1", None), ("e2", "writes", "d9", None), ("e9", "no", "d1", None)], accounts.COLUMNS["knowledge_observations"]),
        "share_links": t([("timeline", "p1", "t", None, None, None, 1), ("timeline", "p9", "t", None, None, None, 1), ("daily", "2024-01-01", None, None, None, None, 1), ("daily", "x", None, None, None, None, 1),
                          ("memory", "all", None, None, None, None, 1), ("odd", "all", None, None, None, None, 1), ("memory", "all", None, None, None, None, 2)], accounts.COLUMNS["share_links"] + ", owner_user_id long"),
        "access_logs": t([("open", "10.1.2.3", "ua", "d1", None, 1), ("open", "10.1.2.3", "ua", "d9", None, 1), ("open", "1.1.1.1", "ua", "d9", None, 2)], accounts.COLUMNS["access_logs"] + ", user_id long"),
    }


def plain(rows, drop=()):
    return sorted(str(r) for r in rows.drop(*drop).collect())


def test_round_trip(spark, tmp_path):
    source = tables(spark)
    counts = accounts.export_account(source, 1, str(tmp_path / "a"), access_logs=True)
    assert counts == {
        "machines": 2, "projects": 2, "documents": 3, "conversation_messages": 2, "document_versions": 1, "daily_summaries": 2, "knowledge_entities": 2,
        "knowledge_relations": 2, "knowledge_observations": 2, "share_links": 6, "access_logs": 2,
    }
    none = {n: source[n].limit(0) for n in ("knowledge_entities", "knowledge_relations", "daily_summaries")}
    out = accounts.import_account(spark, str(tmp_path / "a"), 7, none, "batch")
    assert sorted((r[0], r[1], r[2]) for r in out["skipped"].collect()) == [("share_links", "no date", 1), ("share_links", "project not imported", 1), ("share_links", "unknown kind", 1)]
    assert {r["visibility"] for n in ("documents", "projects") for r in out[n].collect()} == {"private"}
    assert [r["imported_from"] for r in out["access_logs"].orderBy("document_id").collect()] == [None, None] and out["access_logs"].where("ip_address = '10.1.2.0'").count() == 2
    again = {n: rows.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in accounts.COLUMNS[n].split(", ") if c.split()[0] not in rows.columns]) for n, rows in out.items() if n != "skipped"}
    second = accounts.export_account(again, 7, str(tmp_path / "b"), access_logs=True)
    assert second == counts | {"machines": 3, "knowledge_relations": 1, "share_links": 3}
    ids = ("id", "project_id", "machine_id", "document_id", "entity_id", "source_document_id", "source_id", "target_id", "created_at")
    for name in ("documents", "conversation_messages", "document_versions", "knowledge_entities", "knowledge_observations"):
        a, b = (spark.read.schema(accounts.COLUMNS[name]).json(str(tmp_path / x / name)) for x in "ab")
        filled = {"category": "memory", "content_type": "text", "content": "", "file_size_bytes": 0} if name == "documents" else {}
        hidden = ("content_hash",) if name == "documents" else ()
        assert plain(a.na.fill(filled), ids + hidden) == plain(b, ids + hidden)
    days = spark.read.schema(accounts.COLUMNS["daily_summaries"]).json(str(tmp_path / "b" / "daily_summaries"))
    titles = {r["id"]: r["content"] for r in out["documents"].collect()}
    assert sorted([titles[i] for i in r["source_document_ids"]] for r in days.collect()) == [[], ["text b", "text a"]]


def test_what_the_user_has_stays(spark, tmp_path):
    source = tables(spark)
    accounts.export_account(source, 1, str(tmp_path / "a"))
    out = accounts.import_account(spark, str(tmp_path / "a"), 2, source, "batch")
    assert [r["name"] for r in out["knowledge_entities"].collect()] == ["Ada"] and out["access_logs"].count() == 0
    assert {r["source_id"] for r in out["knowledge_relations"].collect()} == {"e9"}
    assert [r["summary_date"] for r in out["daily_summaries"].collect()] == ["2024-01-02"]


def test_other_major_versions_are_refused(spark, tmp_path):
    spark.createDataFrame([("2.0", {"a": 1})], "format_version string, counts map<string,long>").write.json(str(tmp_path / "a" / "manifest"))
    with pytest.raises(ValueError):
        accounts.import_account(spark, str(tmp_path / "a"), 1, {}, "batch")
