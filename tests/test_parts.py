"""Large groupings and windows are dealt to many parts, whatever the session's settings."""

from pyspark.sql import functions as F

from threadloom.bindings import bind
from threadloom.operators import graph, ingest


def parts(rows):
    return rows.select(F.spark_partition_id()).distinct().count()


def test_relations_are_added_up_in_many_parts(spark):
    entities = spark.range(40).withColumnRenamed("id", "entity_id")
    rows = spark.range(3200).selectExpr("id % 40 AS source_id", "id DIV 40 % 40 AS target_id", "concat('t', id % 2) AS type", "1L AS strength")
    merged = graph.merge_relations(rows, entities)
    assert parts(merged) > 50
    assert merged.agg(F.count("*"), F.min("strength"), F.max("strength")).first()[:] == (1560, 2, 2)
    assert parts(bind(spark, "/root/testdata/sf0.001", "relations")) > 50


def test_deliveries_are_chained_in_many_parts(spark):
    deliveries = spark.range(4000).selectExpr("id DIV 4 AS source", "id % 4 * 100 AS byte_offset", "greatest(id % 4 * 100 - 100, 0L) AS base_offset", "IF(id % 4 = 0, 'full', 'delta') AS mode",
        "concat('h', id) AS hash", "1L AS size", "date'2024-01-01' AS delivered")
    twice = deliveries.union(deliveries)
    for kept in (ingest.dedup_deliveries(twice), ingest.dedup_deliveries(twice, ("source",))):
        assert kept.count() == 4000
        assert parts(kept) > 50
        heads = ingest.select_heads(kept)
        assert parts(heads) > 50
        assert {tuple(r)[1:] for r in heads.collect()} == {(0, 4, 300, 0, 0)}
        chains = ingest.coalesce_chain(kept)
        assert parts(chains) > 50
        assert {tuple(r)[1:4] for r in chains.collect()} == {(3, 3, 300)}
