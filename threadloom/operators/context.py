"""What a project is about: its documents in reading order, and the part of the graph that names it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories in reading order (others follow by name), characters of a document, and of a note in a context.
READING = ("memory", "plan", "identity", "config", "skill", "learning", "note", "conversation")
BODY_CHARS, NOTE_CHARS = 200_000, 1000
CURATED = ("memory", "plan", "identity")


def _top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows with their ``place``."""
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def graph_context(docs: DataFrame, entities: DataFrame, relations: DataFrame, observations: DataFrame, project: str, name: str, user_id: int | None = None) -> DataFrame:
    """section, owner, place, text: all that a project's context shows, in bounded lists.

    Sections: documents (counts by category), recent (5 newest conversation titles), note (5 newest curated
    documents, cut), entity (10 whose name contains ``name``, of ``user_id`` or of nobody), edge (10 of each, the strongest) and fact
    (5 newest of each). ``owner`` is the entity's id. ``docs(document_id, project, category, title, content, synced)``,
    ``entities(entity_id, user_id, name, type)``, ``relations(source_id, target_id, type, strength)``, ``observations(entity_id, content, observed)``.
    """
    of = docs.where(F.col("project") == project)
    newest = [F.desc("synced"), F.asc("document_id")]
    counts = of.groupBy("category").agg(F.count("*").alias("n"))
    shown = [counts.select(F.lit("documents").alias("section"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("category")).alias("place"), F.concat_ws(": ", "category", "n").alias("text"))]
    shown.append(_top(of.where("category = 'conversation'"), newest, 5).select(F.lit("recent").alias("section"), "place", F.col("title").alias("text")))
    notes = _top(of.where(F.col("category").isin(*CURATED)).select("document_id", "synced", "category", "title", F.substring("content", 1, NOTE_CHARS).alias("body")), newest, 5)
    shown.append(notes.select(F.lit("note").alias("section"), "place", F.concat_ws("\n", F.concat_ws(": ", "category", "title"), "body").alias("text")))
    own = F.lit(True) if user_id is None else F.col("user_id").isNull() | (F.col("user_id") == user_id)
    chosen = _top(entities.where(own & F.contains(F.lower("name"), F.lit(name.lower()))), [F.asc("name"), F.asc("entity_id")], 10).select("entity_id", "name", "type", "place")
    held = [chosen.select(F.lit("entity").alias("section"), F.col("entity_id").alias("owner"), "place", F.concat("name", F.lit(" ("), "type", F.lit(")")).alias("text"))]

    def first(rows: DataFrame, n: int, *order: Column) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(*order))).where(F.col("place") <= n)

    far = entities.select(F.col("entity_id").alias("target_id"), F.col("name").alias("far"))
    edges = relations.join(chosen.select(F.col("entity_id").alias("source_id")), "source_id").join(far, "target_id").withColumn("owner", F.col("source_id"))
    held.append(first(edges, 10, F.desc("strength"), F.asc("far"), F.asc("type"), F.asc("target_id")).select(F.lit("edge").alias("section"), "owner", "place", F.concat_ws(" ", "type", "far").alias("text")))
    facts = observations.join(chosen.select("entity_id"), "entity_id").withColumn("owner", F.col("entity_id"))
    held.append(first(facts, 5, F.desc("observed"), F.asc("content")).select(F.lit("fact").alias("section"), "owner", "place", F.concat_ws(" ", F.concat(F.lit("["), F.col("observed").cast("string"), F.lit("]")), "content").alias("text")))
    return reduce(DataFrame.unionByName, [s.withColumn("owner", F.lit(None).cast("long")) for s in shown] + held)


def project_sections(docs: DataFrame, project: str, chars: int | None = BODY_CHARS) -> DataFrame:
    """category, synced, document_id, rank and markdown of a project's documents; sorted by rank, category, newest first and document_id they read in order.

    ``docs(document_id, project, category, title, content, summary, synced)``. A conversation shows its summary, if it has
    one; a text beyond ``chars`` is cut and says so (None: whole texts). Null titles are Untitled.
    """
    rank = F.array_position(F.array(*map(F.lit, READING)), F.col("category"))
    text = F.coalesce(F.when(F.col("category") == "conversation", F.nullif(F.trim("summary"), F.lit(""))), F.col("content"), F.lit(""))
    body = text if chars is None else F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("\n\n[cut]"))).otherwise(text)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))
    return docs.where(F.col("project") == project).select(
        "category", "synced", "document_id", F.when(F.coalesce(rank, F.lit(0)) > 0, rank).otherwise(len(READING) + 1).alias("rank"), F.concat(F.lit("## "), title, F.lit("\n\n"), body, F.lit("\n")).alias("markdown")
    )


def export_project_markdown(docs: DataFrame, project: str, path: str, chars: int | None = BODY_CHARS) -> None:
    """Write a project's sections as text files; the files' names, and the lines in them, are in reading order."""
    order = [F.asc("rank"), F.asc("category"), F.desc("synced"), F.asc("document_id")]
    project_sections(docs, project, chars).repartitionByRange(*order).sortWithinPartitions(*order).select("markdown").write.text(path)
