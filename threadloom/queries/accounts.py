"""The round trip of an account."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import accounts
from threadloom.queries.registry import query
from threadloom.tables import shared_folder


def _filled(rows: DataFrame, table: str, *more: str) -> DataFrame:
    """The export's columns of a table, null where ``rows`` has none."""
    missing = [F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in accounts.COLUMNS[table].split(", ")) if c not in rows.columns]
    return rows.select(*[c for c in rows.columns if c in accounts.COLUMNS[table] or c in more], *missing)


_OURS = """, d AS (SELECT document_id, project FROM docs JOIN machines USING (machine_id) WHERE user_id = 1),
    e AS (SELECT entity_id, concat(name, '/', type) AS thing FROM entities WHERE user_id = 1),
    n AS (SELECT 'machines' AS name, count(*) + 1 AS n FROM machines WHERE user_id = 1 UNION ALL SELECT 'projects', count(DISTINCT project) FROM d UNION ALL SELECT 'documents', count(*) FROM d
        UNION ALL SELECT 'conversation_messages', count(*) FROM messages WHERE document_id IN (SELECT document_id FROM d)
        UNION ALL SELECT 'document_versions', count(*) FROM versions WHERE document_id IN (SELECT document_id FROM d)
        UNION ALL SELECT 'knowledge_entities', count(DISTINCT thing) FROM e
        UNION ALL SELECT 'knowledge_relations', count(DISTINCT concat(a.thing, '|', b.thing, '|', type)) FROM relations r JOIN e a ON a.entity_id = r.source_id JOIN e b ON b.entity_id = r.target_id
        UNION ALL SELECT 'knowledge_observations', count(*) FROM observations WHERE l_partkey IN (SELECT entity_id FROM e)
        UNION ALL SELECT 'share_links', count(*) FROM grants WHERE user_id = 1 AND (tool_id IS NULL OR tool_id = 'codex' AND project IN (SELECT project FROM d)))
    SELECT name, n FROM n"""


@query("docs machines messages versions entities relations observations grants", _OURS)
def a8_a9_account_round_trip(docs, machines, messages, versions, entities, relations, observations, grants):
    spark = docs.sparkSession
    none = spark.createDataFrame([], "user_id long")
    tables = {
        "machines": _filled(machines.withColumnRenamed("machine_id", "id"), "machines", "user_id"),
        "projects": _filled(docs.select(F.col("project").alias("id"), F.col("project").alias("slug"), F.col("project").alias("title")).distinct(), "projects"),
        "documents": _filled(docs.withColumnsRenamed({"document_id": "id", "project": "project_id", "synced": "synced_at"}), "documents"),
        "conversation_messages": _filled(messages.withColumnRenamed("ts", "timestamp"), "conversation_messages"),
        "document_versions": _filled(versions.withColumnsRenamed({"hash": "content_hash", "synced": "synced_at"}).drop("size"), "document_versions"),
        "daily_summaries": _filled(none, "daily_summaries", "user_id"),
        "knowledge_entities": _filled(entities.withColumnsRenamed({"entity_id": "id", "type": "entity_type"}), "knowledge_entities", "user_id"),
        "knowledge_relations": _filled(relations.withColumnRenamed("type", "relation_type"), "knowledge_relations"),
        "knowledge_observations": _filled(
            observations.select(F.col("l_partkey").alias("entity_id"), "content", F.col("document_id").alias("source_document_id"), F.col("observed").alias("observed_at")), "knowledge_observations"
        ),
        "share_links": _filled(grants.select(
            F.when(F.col("tool_id").isNull(), "memory").when(F.col("tool_id") == "codex", "timeline").otherwise("other").alias("kind"),
            F.when(F.col("tool_id").isNull(), "all").otherwise(F.col("project")).alias("target_id"), F.col("user_id").alias("owner_user_id"),
        ), "share_links", "owner_user_id"),
        "access_logs": _filled(none, "access_logs", "user_id"),
    }
    path = f"{shared_folder(spark)}/export-{accounts.batch_name()}"
    accounts.export_account(tables, 1, path)
    held = {n: tables[n].limit(0) for n in ("knowledge_entities", "knowledge_relations", "daily_summaries")}
    arrived = accounts.import_account(spark, path, 99, held, "query")
    counted = [arrived[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in accounts.COLUMNS if n not in ("daily_summaries", "access_logs")]
    return reduce(DataFrame.unionByName, counted)
