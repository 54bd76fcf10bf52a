"""Folding agent threads and copies under their root conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import subagent_root


def is_subagent() -> Column:
    """Codex children name a root; those of the other tools lie in a sub-agents' folder."""
    return F.when(F.col("tool_id") == "codex", F.col("root_session_id").isNotNull()).otherwise(F.col("relative_path").contains("/subagents/"))


def root_thread() -> Column:
    """The thread that stands for the conversation."""
    return F.when(F.col("tool_id") == "codex", F.coalesce("root_session_id", "thread")).otherwise(F.coalesce(subagent_root(F.col("relative_path")), F.col("thread")))


def fold(docs: DataFrame) -> DataFrame:
    """document_id, root, canonical_id, visible and subagents for every conversation.

    Of a root's copies the newest, then the largest is canonical. Where the root is
    missing, the shallowest newest child stands in. Children count once for each thread.
    """
    rows = docs.withColumn("root", root_thread()).withColumn("child", is_subagent())
    rank = Window.partitionBy("tool_id", "root").orderBy(
        "child", F.when(F.col("child"), F.col("depth")).otherwise(0), F.desc("synced"), F.desc("file_size"), "document_id"
    )
    group = Window.partitionBy("tool_id", "root")
    first = F.first("document_id").over(rank)
    # a child that stands in for its root doesn't count among its sub-agents
    stand_in = F.first(F.when(F.col("child"), F.col("thread"))).over(rank)
    threads = F.size(F.collect_set(F.when(F.col("child"), F.col("thread"))).over(group))
    return rows.select(
        "document_id", "root", first.alias("canonical_id"), (first == F.col("document_id")).alias("visible"),
        (threads - F.when(stand_in.isNull(), 0).otherwise(1)).alias("subagents"),
    )


def logical_activity(folded: DataFrame, activity: DataFrame) -> DataFrame:
    """Per visible root the newest activity of all its copies and children."""
    return folded.join(activity, "document_id").groupBy("canonical_id").agg(F.max("ts").alias("ts"))
