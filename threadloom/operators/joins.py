"""Joins between messages, documents and the rows that describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which copy of a mirrored message is kept: the one of the highest priority (fixed values).
TRANSPORT_PRIORITY = {"agent_message": 3, "response_item": 2, "task_complete": 1}


def with_dimensions(docs: DataFrame, projects: DataFrame, machines: DataFrame) -> DataFrame:
    """Documents with the titles of their project and machine, where known."""
    return docs.join(projects.select(F.col("slug").alias("project"), F.col("title").alias("project_title")), "project", "left").join(
        machines.select("machine_id", F.col("name").alias("machine_name")), "machine_id", "left"
    )


def messages_with_docs(messages: DataFrame, docs: DataFrame, category: str | None = None) -> DataFrame:
    """Messages with their document's tool and project."""
    of = docs if category is None else docs.where(F.col("category") == category)
    return messages.join(of.select("document_id", "tool_id", "project"), "document_id")


def project_counts(projects: DataFrame, docs: DataFrame) -> DataFrame:
    """Every project and its number of documents, zero included."""
    counts = docs.groupBy(F.col("project").alias("slug")).agg(F.count("*").alias("n"))
    return projects.select("slug").join(counts, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n"))


def orphans(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Parents that no child refers to."""
    return parent.join(child.select(key).distinct(), key, "left_anti")


def owned(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is among the given ones."""
    return rows.join(parents.select(key).distinct(), key, "left_semi")


def is_current_revision(docs: DataFrame, delivery: DataFrame, revision: Column) -> DataFrame:
    """Whether a revision is the delivered one, or the document's own where none was delivered."""
    joined = docs.join(delivery.select("document_id", F.col("hash").alias("_hash")), "document_id", "left")
    return joined.withColumn("is_current", F.coalesce(F.col("_hash"), F.col("hash")) == revision).drop("_hash")


def drop_transport_mirrors(messages: DataFrame, lines: int = 4, seconds: int = 12) -> DataFrame:
    """Without messages whose text came nearby over a transport of higher priority."""
    priority = F.lit(0)
    for name, p in TRANSPORT_PRIORITY.items():
        priority = F.when(F.col("transport") == name, p).otherwise(priority)
    rows = messages.withColumn("_p", priority).withColumn("_key", F.sha2("content", 256))
    other = rows.select("document_id", "_key", F.col("_p").alias("_q"), F.col("line_number").alias("_line"), F.col("ts").alias("_ts"))
    near = (
        (rows["document_id"] == other["document_id"]) & (rows["_key"] == other["_key"]) & (other["_q"] > rows["_p"])
        & (F.abs(other["_line"] - rows["line_number"]) <= lines) & (F.abs(other["_ts"] - rows["ts"]) <= seconds)
    )
    return rows.join(other, near, "left_anti").drop("_p", "_key")


def anchor_asof(events: DataFrame, timeline: DataFrame) -> DataFrame:
    """Each event with the last line of its document at or before it, else 0.

    Both are laid in one order; the line is carried forward, so no range join is needed.
    """
    e = events.select("document_id", "ts", "event_id", F.lit(None).cast("bigint").alias("line"))
    t = timeline.select("document_id", "ts", F.lit(None).cast("bigint").alias("event_id"), F.col("line_number").cast("bigint").alias("line"))
    window = Window.partitionBy("document_id").orderBy("ts", F.col("event_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    carried = e.unionByName(t).withColumn("line", F.coalesce(F.max("line").over(window), F.lit(0)))
    return carried.where("event_id is not null").select("document_id", "event_id", "line")


def entity_relations(entities: DataFrame, relations: DataFrame, entity_id: int) -> DataFrame:
    """Edges out of and into an entity, with the far end's name and type."""
    far = entities.select(F.col("entity_id").alias("far_id"), F.col("name").alias("far_name"), F.col("type").alias("far_type"))
    out = relations.where(F.col("source_id") == entity_id).select(F.lit("out").alias("direction"), F.col("target_id").alias("far_id"), F.col("type").alias("relation"), "strength")
    into = relations.where(F.col("target_id") == entity_id).select(F.lit("in").alias("direction"), F.col("source_id").alias("far_id"), F.col("type").alias("relation"), "strength")
    return out.unionByName(into).join(far, "far_id")


def entities_for_project(projects: DataFrame, entities: DataFrame, per_project: int = 20) -> DataFrame:
    """Entities whose name contains the project's title, by name."""
    p = projects.select("slug", F.lower("title").alias("needle")).where("needle <> ''")
    named = entities.select("name").distinct()
    place = F.row_number().over(Window.partitionBy("slug").orderBy("name"))
    return named.join(p, F.contains(F.lower(named["name"]), p["needle"])).withColumn("place", place).where(F.col("place") <= per_project).select("slug", "name")


def union_projected_legacy(projected: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Projected rows, and legacy rows that have no projection."""
    return projected.unionByName(legacy.join(projected.select(key), key, "left_anti"))


def merge_by_id(primary: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Rows of both, the primary's where both have a key."""
    return primary.unionByName(extra.join(primary.select(key).distinct(), key, "left_anti"))


def in_any_interval(df: DataFrame, column: str, intervals: list[tuple[int, int | None]]) -> DataFrame:
    """Rows in any of the inclusive intervals; an open one has no end."""
    merged: list[list] = []
    for low, high in sorted(intervals, key=lambda x: x[0]):
        high = float("inf") if high is None else high
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    condition = F.lit(False)
    for low, high in merged:
        condition = condition | ((F.col(column) >= low) & (F.lit(True) if high == float("inf") else F.col(column) <= high))
    return df.where(condition)
