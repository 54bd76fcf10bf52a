"""Filters and projections over documents and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIVILEGED = ("admin", "owner")
NOISE_SUFFIXES = (".resolved", ".meta.json", ".metadata.json")
TOOL_NOISE = ("[Result]", "[Tool:", '{"tool_use_id"')


def scope_to_user(docs: DataFrame, machines: DataFrame, user_id: int, role: str = "member") -> DataFrame:
    """Documents of the user's machines; all documents for privileged roles."""
    if role in PRIVILEGED:
        return docs
    return docs.join(machines.where(F.col("user_id") == user_id).select("machine_id"), "machine_id", "left_semi")


def resolve_device_scope(machines: DataFrame, device_id: str) -> DataFrame:
    """machine_id of every member of a host group, else of the collector, else of the row, with that id."""
    ranked = machines.select(
        "machine_id",
        F.when(F.col("host_id") == device_id, 1)
        .when(F.col("collector_id") == device_id, 2)
        .when(F.col("machine_id").cast("string") == device_id, 3)
        .alias("rank"),
    ).where("rank is not null")
    best = ranked.agg(F.min("rank").alias("rank"))
    return ranked.join(F.broadcast(best), "rank").select("machine_id")  # one row


def visible_documents(docs: DataFrame, grants: DataFrame, user_id: int, role: str = "member") -> DataFrame:
    """Documents some grant of the user covers; a grant's null project or tool covers all."""
    if role in PRIVILEGED:
        return docs
    own = grants.where(F.col("user_id") == user_id).select("project", "tool_id").distinct()
    g = own.select(F.col("project").alias("g_project"), F.col("tool_id").alias("g_tool"))
    exact = g.where("g_project is not null")
    wide = g.where("g_project is null").select("g_tool").distinct()
    by_project = docs.join(exact, (docs["project"] == exact["g_project"]) & (exact["g_tool"].isNull() | (docs["tool_id"] == exact["g_tool"])), "left_semi")
    rest = docs.join(exact, (docs["project"] == exact["g_project"]) & (exact["g_tool"].isNull() | (docs["tool_id"] == exact["g_tool"])), "left_anti")
    return by_project.unionByName(rest.join(wide, wide["g_tool"].isNull() | (rest["tool_id"] == wide["g_tool"]), "left_semi"))


def drop_noise_paths(docs: DataFrame, path: str = "relative_path") -> DataFrame:
    """Without resolved copies and metadata sidecars."""
    keep = F.lit(True)
    for suffix in NOISE_SUFFIXES:
        keep = keep & ~F.col(path).contains(suffix)
    return docs.where(keep)


def drop_tool_noise(messages: DataFrame) -> DataFrame:
    """User and assistant messages that aren't echoes of tool calls."""
    keep = F.col("role").isin("user", "assistant")
    for start in TOOL_NOISE:
        keep = keep & ~F.col("content").startswith(start)
    return messages.where(keep)


def within_days(df: DataFrame, ts: str, days: int, now: int) -> DataFrame:
    """Rows of the last ``days`` days before ``now``."""
    return df.where(F.col(ts) >= now - days * 86400)


def as_of(df: DataFrame, ts: str, moment: int) -> DataFrame:
    """Rows up to a moment; rows without a time stay."""
    return df.where(F.col(ts).isNull() | (F.col(ts) <= moment))


def local_day(ts: Column, offset_minutes: int) -> Column:
    """The day, as text, at an offset as JavaScript gives it: minutes that local time lies behind UTC."""
    return F.date_format(F.timestamp_seconds(ts - offset_minutes * 60), "yyyy-MM-dd")


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def safe_int(text: Column) -> Column:
    """The number a text of digits stands for, else 0."""
    return F.when(text.rlike("^[0-9]+$"), F.coalesce(text.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0).cast("bigint"))


def effective_document(docs: DataFrame, delivery: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Documents with the latest delivery's values laid over their own."""
    over = delivery.select("document_id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = docs.join(over, "document_id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def effective_activity(activity: Column, mtime: Column, synced: Column) -> Column:
    """The newest activity, else the file's time bounded by its sync."""
    return F.coalesce(activity, F.least(mtime, synced))


def is_fresh(status: Column, ts: Column, now: int) -> Column:
    """A known status, at most 5 minutes ahead, and at most a day (running) or an hour (ended) old."""
    age = F.lit(now) - ts
    ended = status.isin("completed", "failed", "cancelled")
    return F.coalesce((age >= -300) & (((status == "running") & (age <= 86400)) | (ended & (age <= 3600))), F.lit(False))


def after_cursor(df: DataFrame, keys: Sequence[tuple[str, object, bool]]) -> DataFrame:
    """Rows behind a cursor; keys are (column, the cursor's value, descending) in order of sorting."""
    condition, equal = F.lit(False), F.lit(True)
    for name, value, descending in keys:
        column = F.col(name)
        condition = condition | (equal & (column < value if descending else column > value))
        equal = equal & (column == value)
    return df.where(condition)


def companions(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """Conversations whose thread, root session or sub-agent path belongs to one of ``roots(root_id)``."""
    path_root = F.nullif(F.regexp_extract("relative_path", r"([^/]+)/subagents/", 1), F.lit(""))
    ids = docs.select("document_id", F.explode(F.array_compact(F.array("thread", "root_session_id", path_root))).alias("root_id"))
    return docs.join(ids.join(roots.select("root_id"), "root_id", "left_semi").select("document_id").distinct(), "document_id", "left_semi")


def is_low_activity(user: Column, assistant: Column, chars: Column) -> Column:
    """One side is silent, or at most two turns with fewer than 120 characters."""
    return (user == 0) | (assistant == 0) | ((user + assistant <= 2) & (chars < 120))


def has_generated_title(title: Column) -> Column:
    """A title that is only an identifier, with or without an extension."""
    stem = F.regexp_replace(F.trim(title), r"\.[A-Za-z0-9]{1,8}$", "")
    uuid = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    return stem.rlike(rf"^({uuid}|(agent|session|rollout)-\S+)$")


def quiet_seconds(size: Column, synced: Column, now: int, threshold: int = 4 << 20, wait: int = 600) -> Column:
    """Seconds that a large conversation still has to stay untouched."""
    return F.when(size >= threshold, F.greatest(F.lit(0), wait - (F.lit(now) - synced))).otherwise(F.lit(0))


def retry_candidates(docs: DataFrame, now: int, stale: int = 35 * 60, attempts: int = 5, batch: int = 8) -> DataFrame:
    """Documents to process again, oldest first: pending or failed, or stuck in processing, with attempts left."""
    due = F.col("status").isin("pending", "failed") | ((F.col("status") == "processing") & (F.col("synced") < now - stale))
    return docs.where(due & (F.col("attempts") < attempts)).orderBy("synced", "document_id").limit(batch)


def recall(docs: DataFrame, category: str, days: int, now: int, project: str | None = None, limit: int = 20) -> DataFrame:
    """The newest documents of a category, with a preview of 500 characters."""
    found = within_days(docs.where(F.col("category") == category), "synced", days, now)
    if project is not None:
        found = found.where(F.lower("project").contains(project.lower()))
    ordered = found.orderBy(F.desc("synced"), "document_id").limit(limit)
    return ordered.select("document_id", "project", "synced", F.substring("content", 1, 500).alias("preview"))


def stale_sources(docs: DataFrame, per_machine: int) -> DataFrame:
    """Per machine the smallest documents whose stored revision differs from the delivered one."""
    from pyspark.sql import Window

    stale = docs.where(F.coalesce("stored_hash", F.lit("")) != F.col("hash"))
    place = F.row_number().over(Window.partitionBy("machine_id").orderBy("size", "document_id"))
    return stale.withColumn("place", place).where(F.col("place") <= per_machine)


def incremental_rows(df: DataFrame, key: str, last_key: int | None, limit: int = 1000) -> DataFrame:
    """Rows behind the high-water mark, ascending; without a mark, the newest."""
    if last_key is None:
        return df.orderBy(F.desc(key)).limit(limit)
    return df.where(F.col(key) > last_key).orderBy(key).limit(limit)
