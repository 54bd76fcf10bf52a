"""Aggregations over documents, messages and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.predicates import drop_tool_noise, local_day

#: What a lexicon term looks like (fixed pattern).
TERM = r"^[a-z][a-z0-9_'-]{2,63}$"


def activity_summary(messages: DataFrame) -> DataFrame:
    """Per document: messages, user and assistant messages, and their characters."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return messages.groupBy("document_id").agg(
        F.count("*").alias("messages"),
        F.count_if(user).alias("users"),
        F.count_if(assistant).alias("assistants"),
        F.coalesce(F.sum(F.when(user | assistant, F.length("content"))), F.lit(0)).cast("bigint").alias("chars"),
    )


def last_activity(messages: DataFrame, moment: int | None = None) -> DataFrame:
    """Per document the newest user or assistant message's time, up to a moment."""
    counts = F.col("role").isin("user", "assistant")
    if moment is not None:
        counts = counts & (F.col("ts") <= moment)
    return messages.groupBy("document_id").agg(F.max(F.when(counts, F.col("ts"))).alias("last_ts"))


def counts_by_tool_category(docs: DataFrame, today: int) -> DataFrame:
    """Documents by tool and category, and those of today."""
    return docs.groupBy("tool_id", "category").agg(F.count("*").alias("n"), F.count_if(F.col("synced") >= today).alias("n_today"))


def daily_counts(docs: DataFrame, now: int, offset_minutes: int, days: int = 7) -> DataFrame:
    """Documents of the last days, by local day and tool."""
    recent = docs.where((F.col("synced") >= now - days * 86400) & (F.col("synced") <= now))
    return recent.groupBy(local_day(F.col("synced"), offset_minutes).alias("day"), "tool_id").agg(F.count("*").alias("n"))


def dashboard_totals(docs: DataFrame, today: int) -> DataFrame:
    """All totals in one pass."""
    return docs.agg(
        F.count("*").alias("documents"), F.count_distinct("project").alias("projects"),
        F.count_if(F.col("synced") >= today).alias("today"), F.count_distinct("machine_id").alias("machines"),
    )


def active_days(messages: DataFrame, docs: DataFrame, offset_minutes: int) -> DataFrame:
    """Per local day: messages, and the tools that had any."""
    rows = drop_tool_noise(messages).join(docs.select("document_id", "tool_id"), "document_id")
    return rows.groupBy(local_day(F.col("ts"), offset_minutes).alias("day")).agg(
        F.count("*").alias("messages"), F.array_join(F.sort_array(F.collect_set("tool_id")), ",").alias("tools")
    )


def day_detail(messages: DataFrame, docs: DataFrame, day: str, offset_minutes: int) -> DataFrame:
    """Per conversation of a day: user and assistant messages and its tool."""
    rows = drop_tool_noise(messages).where(local_day(F.col("ts"), offset_minutes) == day)
    return rows.join(docs.select("document_id", "tool_id"), "document_id").groupBy("document_id", "tool_id").agg(
        F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants")
    )


def day_messages(messages: DataFrame, day: str, offset_minutes: int, offset: int, limit: int) -> DataFrame:
    """A page of a day's messages in order of time, document and line."""
    rows = drop_tool_noise(messages).where(local_day(F.col("ts"), offset_minutes) == day)
    return rows.orderBy("ts", "document_id", "line_number").offset(offset).limit(limit)


def device_stats(machines: DataFrame, docs: DataFrame) -> DataFrame:
    """Per machine: documents and tools, machines without any included."""
    per = docs.groupBy("machine_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("tool_id")), ",").alias("tools"))
    return machines.select("machine_id", "name").join(per, "machine_id", "left").select(
        "machine_id", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tools", F.lit("")).alias("tools")
    )


def host_groups(machines: DataFrame, docs: DataFrame) -> DataFrame:
    """Per owner and host name: members, and distinct files over all members."""
    files = docs.join(machines.select("machine_id", "user_id", "host"), "machine_id")
    counted = files.groupBy("user_id", "host").agg(F.count_distinct(F.struct("tool_id", "relative_path")).alias("files"))
    members = machines.groupBy("user_id", "host").agg(F.count("*").alias("members"))
    same = members["user_id"].eqNullSafe(counted["user_id"]) & (members["host"] == counted["host"])
    return members.join(counted, same, "left").select(members["user_id"], members["host"], "members", F.coalesce("files", F.lit(0)).alias("files"))


def distinct_files(docs: DataFrame, *by: str) -> DataFrame:
    """Distinct paths and the newest sync of each group."""
    return docs.groupBy(*by).agg(F.count_distinct("relative_path").alias("files"), F.max("synced").alias("last_sync"))


def build_lexicon(messages: DataFrame) -> DataFrame:
    """Terms and the number of user and assistant messages with each."""
    rows = messages.where(F.col("role").isin("user", "assistant"))
    terms = F.array_distinct(F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}_'-]+"), lambda t: t.rlike(TERM)))
    return rows.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("frequency"))


def latest_by(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Per key the value of the row that comes last in order."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order, value)).alias(value))


def transcript_stats(messages: DataFrame) -> DataFrame:
    """Per document: lines, first and last time, and how many lines have each role."""
    roles = messages.groupBy("document_id", "role").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    histogram = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "role", "n"))), ",")
    return roles.groupBy("document_id").agg(
        F.sum("n").alias("lines"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), histogram.alias("types")
    )


def digest_inputs(docs: DataFrame, day_start: int, per_tool: int = 20, preview: int = 300) -> DataFrame:
    """Per tool the first documents of a day with a preview, and how many there are."""
    day = docs.where(F.col("synced").between(day_start, day_start + 86399))
    w = Window.partitionBy("tool_id")
    ranked = day.withColumn("place", F.row_number().over(w.orderBy("synced", "document_id"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("place") <= per_tool).select("tool_id", "document_id", "place", "n", F.substring("content", 1, preview).alias("preview"))


def memory_stats(entities: DataFrame, relations: DataFrame, observations: DataFrame) -> DataFrame:
    """How many entities, relations and observations there are."""
    parts = [t.agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name, t in (("entities", entities), ("relations", relations), ("observations", observations))]
    return parts[0].union(parts[1]).union(parts[2])
