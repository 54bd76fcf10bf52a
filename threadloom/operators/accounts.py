"""Export of one account's rows as JSON lines, and import into another account."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import anonymize_ip
from threadloom.tables import written

#: The format's version, and the columns of each table that leave the account.
MAJOR, VERSION = 1, "1.0"
COLUMNS = {
    "machines": "id string, name string, collector_version string, created_at string",
    "projects": "id string, slug string, title string, tool_id string, source_path string, created_at string",
    "documents": "id string, tool_id string, project_id string, machine_id string, relative_path string, category string, content_type string, title string, "
    "content string, content_hash string, file_size_bytes long, ai_summary string, synced_at string, created_at string",
    "conversation_messages": "document_id string, line_number long, message_type string, role string, content string, timestamp string",
    "document_versions": "document_id string, content_hash string, content_delta string, file_size_bytes long, synced_at string",
    "daily_summaries": "summary_date string, tool_id string, title string, summary string, source_document_ids array<string>, created_at string",
    "knowledge_entities": "id string, name string, entity_type string, summary string, created_at string",
    "knowledge_relations": "source_id string, target_id string, relation_type string, strength double, created_at string",
    "knowledge_observations": "entity_id string, content string, source_document_id string, observed_at string",
    "share_links": "kind string, target_id string, title string, expires_at string, revoked_at string, created_at string",
    "access_logs": "action string, ip_address string, user_agent string, document_id string, created_at string",
}
#: Kinds of shares that can be imported.
SHARES = ("timeline", "daily", "memory")


def batch_name() -> str:
    """A name for one export or import."""
    return uuid.uuid4().hex


def _within(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is one of ``ids(id)``."""
    return rows.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_semi")


def _or_null(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """All rows; ``column`` becomes its ``new`` in ``ids(id, new)``, null where there is none."""
    to = ids.select(F.col("id").alias(column), F.col("new").alias("_new"))
    return rows.join(to, column, "left").withColumn(column, F.col("_new")).drop("_new")


def _listed(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """All rows; the array ``column`` keeps, in its order, the ``new`` of those elements that ``ids(id, new)`` holds."""
    keyed = written(rows.withColumn("_row", F.monotonically_increasing_id()), "listed")
    found = keyed.select("_row", F.posexplode(column).alias("_at", "id")).join(ids, "id").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "new"))).alias("_found"))
    kept = F.coalesce(F.transform("_found", lambda x: x["new"]), F.array().cast("array<string>"))
    return keyed.join(found, "_row", "left").withColumn(column, kept).drop("_row", "_found")


def owned_tables(tables: dict[str, DataFrame], user_id: int, access_logs: bool = False) -> dict[str, DataFrame]:
    """The rows of ``tables`` that belong to a user, with the columns that may leave, closed under references.

    Machines, entities and summaries have a user_id, shares an owner_user_id, logs a user_id; the rest belongs by its
    machine, document or entity. References to rows outside become null or leave their list.
    """
    own = {n: t.where(F.col("user_id") == user_id) for n, t in tables.items() if n in ("machines", "knowledge_entities", "daily_summaries", "access_logs")}
    own["documents"] = _within(tables["documents"], "machine_id", own["machines"])
    ids = own["documents"].select("id", F.col("id").alias("new"))
    own["projects"] = _within(tables["projects"], "id", own["documents"].select(F.col("project_id").alias("id")))
    for name in ("conversation_messages", "document_versions"):
        own[name] = _within(tables[name], "document_id", ids)
    own["daily_summaries"] = _listed(own["daily_summaries"], "source_document_ids", ids)
    entities = own["knowledge_entities"]
    own["knowledge_relations"] = _within(_within(tables["knowledge_relations"], "source_id", entities), "target_id", entities)
    own["knowledge_observations"] = _or_null(_within(tables["knowledge_observations"], "entity_id", entities), "source_document_id", ids)
    own["share_links"] = tables["share_links"].where(F.col("owner_user_id") == user_id)
    own["access_logs"] = _or_null(own["access_logs"].where(F.lit(access_logs)), "document_id", ids).withColumn("ip_address", anonymize_ip(F.col("ip_address")))
    return {name: own[name].select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in COLUMNS[name].split(", ")]) for name in COLUMNS}


def export_account(tables: dict[str, DataFrame], user_id: int, path: str, access_logs: bool = False) -> dict[str, int]:
    """Write a user's rows under ``path``, a folder of JSON lines for each table and the manifest last; returns the counts."""
    counts = {}
    for name, rows in owned_tables(tables, user_id, access_logs).items():
        seen = Observation(name)
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.json(f"{path}/{name}")
        counts[name] = seen.get["n"]
    spark = next(iter(tables.values())).sparkSession
    manifest = spark.createDataFrame([(VERSION, counts, access_logs)], "format_version string, counts map<string,long>, access_logs boolean")
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return counts


def import_account(spark: SparkSession, path: str, user_id: int, existing: dict[str, DataFrame], batch: str) -> dict[str, DataFrame]:
    """The rows that an export adds to a user's account, by table, and ``skipped(table, reason, n)``.

    Ids are made anew from ``batch`` (a name of this import), so that a repeated import of one batch gives the same rows.
    Projects get a fresh slug, everything is private, machines are named as imported, documents of unknown
    machines go to a machine of their own. Entities that the user has by name and type take their ids; relations
    and summaries that exist are left out, as are shares of unknown kinds or targets. ``existing`` holds
    knowledge_entities, knowledge_relations and daily_summaries. A format of another major version is refused.
    """
    manifest = spark.read.schema("format_version string, counts map<string,long>").json(f"{path}/manifest").first()
    if manifest is None or int((manifest["format_version"] or "0").split(".")[0]) != MAJOR:
        raise ValueError("the export's format is not of this major version")
    read = {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in COLUMNS.items()}

    def fresh(table: str, key: Column) -> Column:
        return F.sha2(F.concat_ws("\x00", F.lit(batch), F.lit(table), key), 256)

    def ids(table: str, rows: DataFrame) -> DataFrame:
        return rows.where("id is not null").select("id", fresh(table, F.col("id")).alias("new")).distinct()

    user, private = F.lit(user_id).alias("user_id"), F.lit("private").alias("visibility")
    machines, projects = ids("machines", read["machines"]), ids("projects", read["projects"])
    kept = read["documents"].where("id is not null and tool_id is not null")
    documents = ids("documents", kept)
    spare = fresh("machines", F.lit(""))
    out = {}
    named = read["machines"].join(machines, "id").select(F.col("new").alias("id"), F.concat_ws(": ", F.lit("Imported"), F.nullif(F.trim("name"), F.lit(""))).alias("name"), "collector_version", user)
    out["machines"] = named.unionByName(spark.range(1).select(spare.alias("id"), F.lit("Imported").alias("name"), F.lit(None).cast("string").alias("collector_version"), user))
    slug = F.concat_ws("-", F.coalesce("slug", F.lit("project")), F.substring("new", 1, 8))
    title = F.coalesce(F.nullif(F.substring("title", 1, 500), F.lit("")), F.lit("Imported project"))
    out["projects"] = read["projects"].join(projects, "id").select(F.col("new").alias("id"), slug.alias("slug"), title.alias("title"), "tool_id", "source_path", private)
    docs = _or_null(_or_null(kept, "project_id", projects), "machine_id", machines).join(documents, "id")
    content = F.coalesce("content", F.lit(""))
    out["documents"] = docs.select(
        F.col("new").alias("id"), "tool_id", "project_id", F.coalesce("machine_id", spare).alias("machine_id"), F.coalesce("relative_path", F.concat(F.lit("imported/"), "new")).alias("relative_path"),
        F.coalesce("category", F.lit("memory")).alias("category"), F.coalesce("content_type", F.lit("text")).alias("content_type"), "title", content.alias("content"),
        F.coalesce("content_hash", F.sha2(content, 256)).alias("content_hash"), F.coalesce("file_size_bytes", F.octet_length(content).cast("long")).alias("file_size_bytes"),
        "ai_summary", "synced_at", "created_at", private,
    )
    for name in ("conversation_messages", "document_versions"):
        out[name] = _or_null(read[name], "document_id", documents).where("document_id is not null")
    day = ["summary_date", "tool_id"]
    first = F.row_number().over(Window.partitionBy(*day).orderBy("created_at", "title", "summary"))
    known = existing["daily_summaries"].where(F.col("user_id") == user_id).select(F.col("summary_date").alias("_d"), F.col("tool_id").alias("_t"))
    new_days = read["daily_summaries"].where("summary_date is not null").withColumn("_n", first).where("_n = 1").drop("_n")
    new_days = new_days.join(known, F.col("summary_date").eqNullSafe(F.col("_d")) & F.col("tool_id").eqNullSafe(F.col("_t")), "left_anti")
    out["daily_summaries"] = _listed(new_days, "source_document_ids", documents).select("*", user)

    # entities by name and type: the user's own, else one new id for each
    given = read["knowledge_entities"].where("id is not null and name <> '' and entity_type <> ''")
    have = existing["knowledge_entities"].where(F.col("user_id") == user_id).groupBy("name", "entity_type").agg(F.min("id").cast("string").alias("_have"))
    each = given.groupBy("name", "entity_type").agg(F.min(fresh("entities", F.col("id"))).alias("_new"), F.max("summary").alias("summary")).join(have, ["name", "entity_type"], "left")
    out["knowledge_entities"] = each.where("_have is null").select(F.col("_new").alias("id"), "name", "entity_type", "summary", user)
    entities = given.select("id", "name", "entity_type").join(each, ["name", "entity_type"]).select("id", F.coalesce("_have", "_new").alias("new")).distinct()
    edge = ["source_id", "target_id", "relation_type"]
    edges = _or_null(_or_null(read["knowledge_relations"], "source_id", entities), "target_id", entities).where("source_id is not null and target_id is not null and relation_type <> ''")
    edges = edges.groupBy(*edge).agg(F.max(F.coalesce("strength", F.lit(1.0))).alias("strength"))
    out["knowledge_relations"] = edges.join(existing["knowledge_relations"].select(*[F.col(c).cast("string") for c in edge]), edge, "left_anti")
    facts = _or_null(_or_null(read["knowledge_observations"], "entity_id", entities), "source_document_id", documents)
    out["knowledge_observations"] = facts.where("entity_id is not null and content <> ''")
    shares = read["share_links"].join(projects.select(F.col("id").alias("target_id"), "new"), "target_id", "left")
    reason = (
        F.when(~F.coalesce(F.col("kind").isin(*SHARES), F.lit(False)), "unknown kind").when((F.col("kind") == "timeline") & F.col("new").isNull(), "project not imported")
        .when((F.col("kind") == "daily") & (F.length(F.coalesce("target_id", F.lit(""))) != 10), "no date").when((F.col("kind") == "memory") & ~F.col("target_id").eqNullSafe("all"), "unsupported target")
    )
    shares = shares.withColumn("_reason", reason)
    target = F.when(F.col("kind") == "timeline", F.col("new")).otherwise(F.col("target_id"))
    out["share_links"] = shares.where("_reason is null").select(F.expr("replace(uuid(), '-', '')").alias("token"), "kind", target.alias("target_id"), "title", "expires_at", "revoked_at", F.lit(user_id).alias("owner_user_id"))
    logs = read["access_logs"].where("action <> ''").withColumn("imported_from", F.col("document_id"))
    out["access_logs"] = _or_null(logs, "document_id", documents).withColumn("imported_from", F.when(F.col("document_id").isNull(), F.col("imported_from"))).select("*", user)
    lost = [shares.where("_reason is not null").select(F.lit("share_links").alias("table"), F.col("_reason").alias("reason"))]
    lost.append(read["documents"].where("id is null or tool_id is null").select(F.lit("documents").alias("table"), F.lit("no id or tool").alias("reason")))
    out["skipped"] = reduce(DataFrame.unionByName, lost).groupBy("table", "reason").agg(F.count("*").alias("n"))
    return out
