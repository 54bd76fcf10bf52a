"""The knowledge graph: entities, weighted relations and dated observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.tables import PARTS


def merge_entities(entities: DataFrame) -> DataFrame:
    """One entity for each user, name and type; the longest summary stays, the last in order among equals."""
    best = F.max_by("summary", F.struct(F.length("summary"), "summary"))
    return entities.groupBy("user_id", "name", "type").agg(best.alias("summary"), F.count("*").alias("merged"))


def merge_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations between known, different entities, repeats added up."""
    ends = entities.select("entity_id").distinct()
    known = relations.where("source_id <> target_id").join(ends.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi")
    known = known.join(ends.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    keys = ["source_id", "target_id", "type"]
    return known.repartition(PARTS, *keys).groupBy(*keys).agg(F.sum("strength").alias("strength"))


def prune_weak_relations(relations: DataFrame, least: float = 1.5) -> DataFrame:
    return relations.where(F.col("strength") >= least)


def compaction_candidates(observations: DataFrame, before: Column, least: int = 5) -> DataFrame:
    """Entities with several old observations, and how they read in order."""
    old = observations.where(F.col("observed") < before)
    bullet = F.concat(F.lit("- "), F.date_format("observed", "yyyy-MM-dd"), F.lit(": "), F.col("content"))
    lines = F.array_sort(F.collect_list(bullet))
    return old.groupBy("entity").agg(F.count("*").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest")).where(F.col("n") >= least)


def vacuum(entities: DataFrame, observations: DataFrame) -> DataFrame:
    """Entities that some observation mentions."""
    return entities.join(observations.select(F.col("entity").alias("name")).distinct(), "name", "left_semi")


def recent_graph(entities: DataFrame, relations: DataFrame, limit: int) -> DataFrame:
    """Relations among the newest entities."""
    newest = entities.orderBy(F.desc("entity_id")).limit(limit).select("entity_id")
    return relations.join(newest.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi").join(
        newest.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi"
    )


def search_graph(entities: DataFrame, observations: DataFrame, query: str, limit: int) -> DataFrame:
    """Entities by name or summary first, then observations, ``limit`` in all."""
    q = query.lower()
    hits = entities.where(F.lower("name").contains(q) | F.lower("summary").contains(q)).select(
        F.lit(1).alias("place"), F.col("name"), F.col("summary").alias("text")
    ).distinct()
    facts = observations.where(F.lower("content").contains(q)).select(F.lit(2).alias("place"), F.col("entity").alias("name"), F.col("content").alias("text")).distinct()
    return hits.union(facts).orderBy("place", "name", "text").limit(limit)


def entity_detail(observations: DataFrame, entity: str, limit: int = 20) -> DataFrame:
    """An entity's newest observations."""
    return observations.where(F.col("entity") == entity).orderBy(F.desc("observed"), "l_orderkey", "l_linenumber", "l_partkey", "content").limit(limit)


def graph_hits(entities: DataFrame, observations: DataFrame, query: str, n_entities: int = 5, n_facts: int = 3) -> DataFrame:
    """Entities that match, each with its newest facts in one text, at score 0.7."""
    names = entities.where(F.lower("name").contains(query.lower())).select("name").distinct().orderBy("name").limit(n_entities)
    facts = observations.select(F.col("entity").alias("name"), "content", "observed").distinct().join(names, "name")
    order = Window.partitionBy("name").orderBy(F.desc("observed"), "content")
    top = facts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_facts)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), "; ")
    return top.groupBy("name").agg(text.alias("text")).withColumn("score", F.lit(0.7))


def extraction_status(attempts: Column, ok: Column, most: int = 8) -> Column:
    """What becomes of an extraction."""
    return F.when(ok, "ok").when(attempts >= most, "permanent_failed").otherwise("failed")


def retry_delay(attempts: Column) -> Column:
    """Seconds until the next try: 15 minutes, doubled each time, a day at most."""
    return F.least(F.lit(86400), (900 * F.pow(F.lit(2), F.least(attempts - 1, F.lit(20)))).cast("bigint"))
