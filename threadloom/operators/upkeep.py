"""Stored tables kept in order: shares, pairing, compaction, re-pointing, purges and change rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compatible_vectors(df: DataFrame, signature: str, default_model: str) -> DataFrame:
    """Vectors of the profile ``signature``; those without one count for the default model."""
    return df.where((F.col("signature") == signature) | (F.col("signature").isNull() & (F.col("model") == default_model)))


def active_shares(links: DataFrame, viewer: Column, now: int) -> DataFrame:
    """Links neither revoked nor expired that are public, or directed to or owned by ``viewer``."""
    live = ~F.col("revoked") & (F.col("expires").isNull() | (F.col("expires") > now))
    return links.where(live & ((F.col("audience") == "public") | F.col("directed_to").eqNullSafe(viewer) | F.col("owner").eqNullSafe(viewer)))


def pair_queued_prompts(messages: DataFrame, within: int = 86400) -> DataFrame:
    """queued_id and message_id of each queued prompt and the user row that it became.

    ``messages(message_id, document_id, content, ts, queued)``. Queued rows of one text
    and the document's other rows of it are paired in their order, each once; a pair
    holds if the second comes at most ``within`` seconds later or a time is missing.
    """
    place = F.row_number().over(Window.partitionBy("document_id", "content", "queued").orderBy("ts", "message_id"))
    rows = messages.withColumn("place", place)
    queued = rows.where("queued").select("document_id", "content", "place", F.col("message_id").alias("queued_id"), F.col("ts").alias("queued_ts"))
    later = F.col("ts") - F.col("queued_ts")
    pairs = rows.where("not queued").join(queued, ["document_id", "content", "place"])
    return pairs.where(later.isNull() | later.between(0, within)).select("queued_id", "message_id")


def artifact_inventory(refs: DataFrame) -> DataFrame:
    """References by device, tool, path and outcome, and beside each count the outcome's total."""
    counts = refs.groupBy("machine_id", "tool_id", "path", "outcome").agg(F.count("*").alias("n"))
    totals = counts.groupBy("outcome").agg(F.sum("n").alias("n_outcome"))
    return counts.join(totals, "outcome")


def workspace_vote(docs: DataFrame, pattern: str, ignored: str) -> DataFrame:
    """document_id and the project root that its content names most often, the first named of several.

    ``pattern`` has the root as its first group; paths that meet ``ignored`` don't count.
    """
    named = docs.select("document_id", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("at", "root"))
    votes = named.where(~F.col("root").rlike(ignored)).groupBy("document_id", "root").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return votes.groupBy("document_id").agg(F.max_by("root", F.struct("n", -F.col("at"))).alias("root"))


def apply_compaction(observations: DataFrame, replies: DataFrame, before: Column) -> DataFrame:
    """entity, content and observed after compaction: old rows of the entities with a reply give way to it.

    ``replies(entity, content, observed)``; rows observed at ``before`` or later stay.
    """
    done = replies.select("entity").distinct()
    old = observations.where(F.col("observed") < before).join(done, "entity", "left_anti")
    kept = old.unionByName(observations.where(F.col("observed") >= before))
    return kept.select("entity", "content", "observed").unionByName(replies.select("entity", "content", "observed"))


def store_observations(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """name and type of all entities once ``rows(entity, content)`` are stored.

    A row without an entity names one by the first three words of its content; new entities are of type Note.
    """
    first = F.array_join(F.slice(F.split(F.trim("content"), r"\s+"), 1, 3), " ")
    named = rows.select(F.coalesce(F.nullif(F.trim("entity"), F.lit("")), first).alias("name")).distinct()
    known = entities.select("name", "type").distinct()
    return known.unionByName(named.join(known, "name", "left_anti").withColumn("type", F.lit("Note")))


def reset_memory(tables: dict[str, DataFrame], scope: DataFrame, key: str) -> dict[str, DataFrame]:
    """``tables`` without the rows whose ``key`` is in ``scope``; rows without a key stay."""
    gone = scope.select(key).distinct()
    return {name: table.join(gone, key, "left_anti") for name, table in tables.items()}


def repoint(rows: DataFrame, aliases: DataFrame, column: str = "document_id") -> DataFrame:
    """``rows`` whose ``column`` names an alias point to what ``aliases(alias, target)`` says instead."""
    named = aliases.select(F.col("alias").alias(column), "target")
    return rows.join(named, column, "left").withColumn(column, F.coalesce("target", column)).select(rows.columns)


def consolidate_sessions(docs: DataFrame, aliases: DataFrame, references: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Documents without the aliases, and the tables that refer to documents, re-pointed."""
    kept = docs.join(aliases.select(F.col("alias").alias("document_id")), "document_id", "left_anti")
    return kept, {name: repoint(table, aliases) for name, table in references.items()}


def reclassify_sidecars(docs: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents whose path is a sidecar's become of category state, and lose their derived rows."""
    sidecar = F.col("relative_path").endswith(".meta.json")
    changed = docs.withColumn("category", F.when(sidecar, "state").otherwise(F.col("category")))
    return changed, derived.join(docs.where(sidecar).select("document_id"), "document_id", "left_anti")


def purge_scope(docs: DataFrame, messages: DataFrame, machines: DataFrame) -> DataFrame:
    """name, n_removed and n_kept of documents and messages once the documents of ``machines`` are purged."""
    gone = docs.join(machines.select("machine_id").distinct(), "machine_id", "left_semi").select("document_id").distinct().withColumn("gone", F.lit(True))
    counted = [
        table.join(gone, "document_id", "left").agg(F.count_if("gone").alias("n_removed"), F.count_if(F.col("gone").isNull()).alias("n_kept")).withColumn("name", F.lit(name))
        for name, table in (("documents", docs), ("messages", messages))
    ]
    return counted[0].unionByName(counted[1])


def change_sets(before: DataFrame, after: DataFrame) -> DataFrame:
    """document_id and resource of everything that readers must fetch anew after an ingest.

    Both have document_id, full, n_user, n_chars, title, pending and project. Messages,
    metadata, dashboard and project always change (project only where there is one),
    prompts and search with a full delivery or new text, search with a new title too,
    and pending where the open interactions moved.
    """
    old = before.select("document_id", *[F.col(c).alias(f"_{c}") for c in ("n_user", "n_chars", "title", "pending")])
    rows = after.join(old, "document_id", "left")

    def moved(c: str) -> Column:
        return ~F.col(c).eqNullSafe(F.col(f"_{c}"))

    always = [F.lit(x) for x in ("messages", "metadata", "dashboard")]
    some = [
        F.when(F.col("project").isNotNull(), "project"),
        F.when(F.col("full") | moved("n_user"), "prompts"),
        F.when(F.col("full") | moved("n_chars") | moved("title"), "search"),
        F.when(moved("pending"), "pending"),
    ]
    return rows.select("document_id", F.explode(F.array_compact(F.array(*always, *some))).alias("resource"))
