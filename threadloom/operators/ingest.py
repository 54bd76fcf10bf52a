"""Merging of deliveries: duplicates, revisions, chains of deltas and read models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import compact_title
from threadloom.operators.aggregates import activity_summary
from threadloom.operators.windows import latest_assistant_line
from threadloom.tables import PARTS

#: Transports of an assistant's message, the preferred one highest, and seconds between equal copies.
TRANSPORTS = {"agent_message": 3, "response_item": 2, "task_complete": 1}
MIRROR_SECONDS = 12


def dedup_deliveries(deliveries: DataFrame, dealt_by: tuple[str, ...] = ("source", "hash", "byte_offset")) -> DataFrame:
    """One delivery for each source, hash and offset: the earliest, the smallest among equals.

    ``dealt_by`` may name fewer of these keys, so that what follows by them needs no second shuffle.
    """
    order = Window.partitionBy("source", "hash", "byte_offset").orderBy("delivered", "size", "base_offset")
    dealt = deliveries.repartition(PARTS, *dealt_by)
    return dealt.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def guard_deltas(deltas: DataFrame, state: DataFrame) -> DataFrame:
    """Each delta's disposition against the committed offset of its source: stale, mismatched or applicable."""
    joined = deltas.join(state.select("source", F.col("byte_offset").alias("committed")), "source", "left")
    committed = F.coalesce("committed", F.lit(0))
    what = F.when(F.col("byte_offset") <= committed, "stale").when(F.col("base_offset") != committed, "mismatched").otherwise("applicable")
    return joined.withColumn("disposition", what)


def latest_full(deliveries: DataFrame) -> DataFrame:
    """Per source the full delivery that supersedes the others."""
    fulls = deliveries.where("mode = 'full'")
    newest = F.max_by(F.struct("hash", "size"), F.struct("delivered", "byte_offset", "size", "hash"))
    return fulls.groupBy("source").agg(newest.alias("x")).select("source", "x.hash", "x.size")


def coalesce_chain(deliveries: DataFrame, max_bytes: int = 16 << 20, max_jobs: int = 512) -> DataFrame:
    """Per source the longest contiguous run of deltas from its first, within bounds, as one job."""
    order = Window.partitionBy("source").orderBy("byte_offset")
    rows = deliveries.where("mode = 'delta'").repartition(PARTS, "source").withColumn("_gap", F.coalesce((F.col("base_offset") != F.lag("byte_offset").over(order)).cast("int"), F.lit(0)))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_broken", F.max("_gap").over(run)).withColumn("_bytes", F.sum("size").over(run)).withColumn("_jobs", F.count("*").over(run))
    kept = rows.where((F.col("_broken") == 0) & (F.col("_bytes") <= max_bytes) & (F.col("_jobs") <= max_jobs))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("byte_offset", "hash"))), lambda x: x["hash"])
    return kept.groupBy("source").agg(F.count("*").alias("jobs"), F.sum("size").alias("size"), F.max("byte_offset").alias("byte_offset"), F.array_join(parts, "|").alias("chain"))


def select_heads(deliveries: DataFrame) -> DataFrame:
    """Per source its next job: the last full delivery and the deltas that follow it without a gap.

    Returns head (offset of that full delivery, null without one), jobs and end of the
    chain, superseded (deliveries before the head) and waiting (behind a gap). Without a
    full delivery the chain must start at offset 0. Deliveries are told apart by offset
    and hash (``dedup_deliveries``).
    """
    order = Window.partitionBy("source").orderBy("byte_offset", "hash")
    full = F.col("mode") == "full"
    rows = deliveries.repartition(PARTS, "source").withColumn("_head", F.max(F.when(full, F.col("byte_offset"))).over(Window.partitionBy("source")))
    rows = rows.withColumn("_gap", ~full & (F.col("base_offset") != F.coalesce(F.lag("byte_offset").over(order), F.lit(0))))
    old = F.coalesce(F.col("byte_offset") < F.col("_head"), F.lit(False))
    rows = rows.withColumn("_old", old).withColumn("_broken", F.max(F.col("_gap") & ~F.col("_old")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chained = ~F.col("_old") & ~F.col("_broken")
    return rows.groupBy("source").agg(
        F.first("_head").alias("head"), F.count_if(chained).alias("jobs"), F.max(F.when(chained, F.col("byte_offset"))).alias("end"),
        F.count_if("_old").alias("superseded"), F.count_if(~F.col("_old") & F.col("_broken")).alias("waiting"),
    )


def merge_documents(target: DataFrame, batch: DataFrame, protected: tuple[str, ...] = ("manual_title", "pinned")) -> DataFrame:
    """``target`` after an upsert of ``batch``, both (document_id, title, project, hash, metadata map), with ``action``.

    A manual title stays; else the batch's title stands if it has one. A project is never
    emptied. Of the old metadata only the ``protected`` keys outlast a batch, which can't
    change them.
    """
    old, new = target.alias("o"), batch.alias("n")
    kept = F.map_filter(F.coalesce("o.metadata", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*protected))
    fresh = F.map_filter(F.coalesce("n.metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(kept, k))
    alone, arrived = F.col("n.document_id").isNull(), F.col("o.document_id").isNull()
    manual = F.coalesce(F.map_contains_key(F.col("o.metadata"), "manual_title"), F.lit(False))
    return old.join(new, F.col("o.document_id") == F.col("n.document_id"), "full").select(
        F.coalesce("o.document_id", "n.document_id").alias("document_id"),
        F.when(manual, F.col("o.title")).otherwise(F.coalesce(F.nullif("n.title", F.lit("")), "o.title")).alias("title"),
        F.coalesce("n.project", "o.project").alias("project"), F.coalesce("n.hash", "o.hash").alias("hash"),
        F.when(alone, F.col("o.metadata")).otherwise(F.map_concat(kept, fresh)).alias("metadata"),
        F.when(alone, "keep").when(arrived, "insert").when(F.col("o.hash").eqNullSafe(F.col("n.hash")), "touch").otherwise("update").alias("action"),
    )


def collapse_user_mirrors(records: DataFrame) -> DataFrame:
    """``records(document_id, record, kind, content, ts)`` of users without response items that the next record repeats.

    That is an event at most 2 records and 1 second later with the same text, or one of
    which is the start of the other. The event stays, with ``paired``.
    """
    order = Window.partitionBy("document_id").orderBy("record")

    def mirrored(item: Column, event: Column) -> Column:
        near = (event["record"] - item["record"] <= 2) & (F.abs(event["ts"] - item["ts"]) <= 1)
        same = F.startswith(item["content"], event["content"]) | F.startswith(event["content"], item["content"])
        return F.coalesce((item["kind"] == "response_item") & (event["kind"] == "user_message") & near & same, F.lit(False))

    here = F.struct("record", "kind", "content", "ts")
    rows = records.withColumn("_next", mirrored(here, F.lead(here).over(order))).withColumn("paired", mirrored(F.lag(here).over(order), here))
    return rows.where("not _next").drop("_next")


def first_prompt_title(conversations: DataFrame, messages: DataFrame, among: int = 25) -> DataFrame:
    """``conversations(document_id, title)`` with opaque titles replaced by the first that a prompt yields.

    Of each conversation the first ``among`` user rows are looked at. An opaque title is
    null, blank or an id; without a prompt that yields a title it stays.
    """
    prompts = messages.where("role = 'user'").select("document_id", "line_number", compact_title(F.col("content")).alias("_found"))
    prompts = prompts.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy("line_number"))).where(F.col("_n") <= among)
    found = prompts.where("_found is not null").groupBy("document_id").agg(F.min_by("_found", "_n").alias("_found"))
    opaque = F.col("title").isNull() | F.col("title").rlike(r"^\s*$|^(rollout-|session-)|^[0-9a-f-]{32,36}$")
    joined = conversations.join(found, "document_id", "left")
    return joined.withColumn("title", F.when(opaque, F.coalesce("_found", "title")).otherwise(F.col("title"))).drop("_found")


def update_sync_state(state: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Per source the last offset and hash after a batch; offsets never go back."""
    both = state.select("source", "byte_offset", "hash").unionByName(deliveries.select("source", "byte_offset", "hash"))
    return both.groupBy("source").agg(F.max("byte_offset").alias("byte_offset"), F.max_by("hash", F.struct("byte_offset", "hash")).alias("hash"))


def bounded_source_time(mtime: Column, observed: Column) -> Column:
    return F.least(mtime, observed)


def refresh_read_model(messages: DataFrame) -> DataFrame:
    """Per conversation its counts and its last assistant line."""
    return activity_summary(messages).join(latest_assistant_line(messages), "document_id", "left")


def merge_read_model(prior: DataFrame, delta: DataFrame) -> DataFrame:
    """The read model after new messages: equal to a full refresh over old and new ones."""
    both = prior.unionByName(delta)
    return both.groupBy("document_id").agg(*[F.sum(c).alias(c) for c in ("messages", "users", "assistants", "chars")], F.max("line_number").alias("line_number"))


def prompt_projection(messages: DataFrame) -> DataFrame:
    """Human prompts with their first 500 characters."""
    human = (F.col("role") == "user") & (F.trim("content") != "") & ~F.col("content").contains("[Subagent Context]")
    return messages.where(human).select("document_id", "line_number", "ts", F.substring("content", 1, 500).alias("prompt"))


def append_messages(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's messages behind the last line of their document."""
    last = target.groupBy("document_id").agg(F.max("line_number").alias("_last"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("line_number"))
    added = batch.join(last, "document_id", "left").withColumn("line_number", F.coalesce("_last", F.lit(0)) + place).drop("_last")
    return target.unionByName(added.select(*target.columns))


def invalidate_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents whose text changed, or that are new."""
    before = old.select("document_id", F.col("hash").alias("_hash"))
    return new.join(before, "document_id", "left").where(~F.col("hash").eqNullSafe(F.col("_hash"))).select("document_id")


def live_activities(signals: DataFrame) -> DataFrame:
    """Activities that are running: their newest signal, the latest event among equals, isn't an end."""
    last = F.max_by("status", F.struct("ts", "event_id"))
    return signals.groupBy("activity_id").agg(last.alias("status"), F.max("ts").alias("ts")).where("status = 'running'")


def collapse_assistant_mirrors(messages: DataFrame) -> DataFrame:
    """Assistant rows without the copies that other transports of one message left.

    Of ``messages(document_id, record, kind, content, ts)`` a row continues its
    predecessor if it is of another kind, at most 4 records behind, and its trimmed text
    equals within 12 seconds or begins alike within one. A chain keeps its best kind's row.
    """
    order = Window.partitionBy("document_id").orderBy("record")

    def before(column: str) -> Column:
        return F.lag(column).over(order)

    text, last = F.trim("content"), F.trim(before("content"))
    apart = F.abs(F.col("ts") - before("ts"))
    alike = ((text == last) & (apart <= MIRROR_SECONDS)) | ((text.startswith(last) | last.startswith(text)) & (apart <= 1))
    mirror = alike & (text != "") & (last != "") & (F.col("kind") != before("kind")) & (F.col("record") - before("record") <= 4)
    chains = messages.withColumn("new", (~F.coalesce(mirror, F.lit(False))).cast("int")).withColumn("chain", F.sum("new").over(order)).drop("new")
    group = Window.partitionBy("document_id", "chain")
    rank = F.try_element_at(F.create_map(*[F.lit(x) for pair in TRANSPORTS.items() for x in pair]), F.col("kind"))
    place = F.row_number().over(group.orderBy(F.desc_nulls_last(rank), "record"))
    kept = chains.withColumns({"place": place, "paired": F.count("*").over(group) > 1}).where("place = 1")
    return kept.drop("place", "chain")
