"""Queries of the library's operators over the given tables, and their SQL for another engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.bindings import E0, NOW
from threadloom.functions import text as T
from threadloom.operators import agents, aggregates, graph, hierarchy, ingest, joins, predicates, reports, search, upkeep, vectors, windows
from threadloom.queries.registry import query
from threadloom.sources import normalize
from threadloom.streaming import states

DAY = "strftime(to_timestamp({ts} - {off} * 60) AT TIME ZONE 'UTC', '%Y-%m-%d')"


def _day(ts: str, offset: int) -> str:
    return DAY.format(ts=ts, off=offset)


# --- sources -------------------------------------------------------------------------


@query("messages", "SELECT message_id, document_id FROM messages WHERE message_id > 40003 ORDER BY message_id LIMIT 50")
def a5_incremental_rows(messages):
    return predicates.incremental_rows(messages, "message_id", 40003, 50).select("message_id", "document_id")


# --- predicates and projections ------------------------------------------------------


@query("docs machines", "SELECT document_id FROM docs WHERE machine_id IN (SELECT machine_id FROM machines WHERE user_id = 1)")
def b1_scope_to_user(docs, machines):
    return predicates.scope_to_user(docs, machines, 1).select("document_id")


_HOST = "lower(regexp_replace(name, ' \\((Windows|Linux)\\)$', ''))"
_HOST_ID = f"concat('host_', substr(sha256(concat(cast(user_id as varchar), chr(0), {_HOST})), 1, 24))"


@query(
    "docs machines",
    f"""SELECT document_id FROM docs JOIN machines m USING (machine_id)
    WHERE {_HOST_ID.replace("user_id", "m.user_id").replace("name", "m.name")} = (SELECT {_HOST_ID} FROM machines WHERE machine_id = 1)""",
)
def b2_resolve_device_scope(docs, machines):
    named = machines.select(
        "machine_id", T.host_id(F.col("user_id").cast("string"), F.col("name")).alias("host_id"), F.concat(F.lit("c"), "machine_id").alias("collector_id")
    )
    chosen = named.where("machine_id = 1").select("host_id").first()["host_id"]  # one row of the machines dimension
    return docs.join(predicates.resolve_device_scope(named, chosen), "machine_id", "left_semi").select("document_id")


@query(
    "docs grants",
    """SELECT document_id FROM docs d WHERE EXISTS (SELECT 1 FROM grants g WHERE g.user_id = 2
        AND (g.project IS NULL OR g.project = d.project) AND (g.tool_id IS NULL OR g.tool_id = d.tool_id))""",
)
def b3_visible_documents(docs, grants):
    return predicates.visible_documents(docs, grants, 2).select("document_id")


@query("docs", "SELECT document_id, relative_path FROM docs WHERE relative_path NOT LIKE '%.resolved%' AND relative_path NOT LIKE '%.meta.json%' AND relative_path NOT LIKE '%.metadata.json%'")
def b4_drop_noise_paths(docs):
    return predicates.drop_noise_paths(docs).select("document_id", "relative_path")


_REAL = "role IN ('user', 'assistant') AND content NOT LIKE '[Result]%' AND content NOT LIKE '[Tool:%' AND content NOT LIKE '{\"tool_use_id\"%'"


@query("messages", f"SELECT message_id, role FROM messages WHERE {_REAL}")
def b5_drop_tool_noise(messages):
    return predicates.drop_tool_noise(messages).select("message_id", "role")


@query("docs", f"SELECT document_id FROM docs WHERE synced >= {NOW - 7 * 86400} AND (synced IS NULL OR synced <= {NOW})")
def b6_within_days(docs):
    return predicates.as_of(predicates.within_days(docs, "synced", 7, NOW), "synced", NOW).select("document_id")


@query("messages", f"SELECT message_id, {_day('ts', 480)} AS day FROM messages")
def b7_local_day(messages):
    return messages.select("message_id", predicates.local_day(F.col("ts"), 480).alias("day"))


@query("conv_docs", "SELECT document_id, coalesce(nullif(root_session_id, ''), nullif(thread, '')) AS thread_id FROM conv_docs")
def b8_thread_id(conv_docs):
    return conv_docs.select("document_id", predicates.first_filled(F.col("root_session_id"), F.col("thread")).alias("thread_id"))


@query("docs", "SELECT document_id, CASE WHEN regexp_matches(substr(project, 4), '^[0-9]+$') THEN cast(substr(project, 4) AS bigint) ELSE 0 END AS n FROM docs")
def b9_safe_int(docs):
    return docs.select("document_id", predicates.safe_int(F.substring("project", 4, 9)).alias("n"))


_LATEST = """latest AS (SELECT document_id, hash, synced FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY synced DESC, o_orderkey DESC) AS n FROM versions) WHERE n = 1)"""


def _latest_versions(versions):
    return windows.newest_per_key(versions, ["document_id"], [F.desc("synced"), F.desc("o_orderkey")]).select("document_id", "hash", F.col("synced").cast("string").alias("synced_day"))


@query(
    "docs versions",
    f""" , {_LATEST} SELECT d.document_id, coalesce(l.hash, md5(d.content)) AS hash, coalesce(cast(l.synced AS varchar), cast(d.synced AS varchar)) AS synced
    FROM docs d LEFT JOIN latest l USING (document_id)""",
)
def b10_effective_document(docs, versions):
    own = docs.select("document_id", F.md5("content").alias("hash"), F.col("synced").cast("string").alias("synced"))
    return predicates.effective_document(own, _latest_versions(versions).withColumnRenamed("synced_day", "synced"), ["hash", "synced"])


@query("conv_docs", "SELECT document_id, coalesce(activity, least(mtime, synced)) AS ts FROM conv_docs")
def b11_effective_activity(conv_docs):
    return conv_docs.select("document_id", predicates.effective_activity(F.col("activity"), F.col("mtime"), F.col("synced")).alias("ts"))


@query(
    "signals",
    """SELECT event_id, coalesce((a >= -300) AND ((status = 'running' AND a <= 86400) OR (status <> 'running' AND a <= 3600)), false) AS fresh
    FROM (SELECT *, 1704153600 - cast(floor(epoch(ts)) AS bigint) AS a FROM signals)""",
)
def b12_is_fresh(signals):
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return signals.select("event_id", predicates.is_fresh(F.col("status"), ts, 1704153600).alias("fresh"))


@query("messages", f"SELECT message_id FROM messages WHERE ts < {E0 + 180000} OR (ts = {E0 + 180000} AND message_id > 50000)")
def b13_after_cursor(messages):
    return predicates.after_cursor(messages, [("ts", E0 + 180000, True), ("message_id", 50000, False)]).select("message_id")


@query(
    "conv_docs",
    """SELECT document_id FROM conv_docs WHERE thread IN ('t8', 't32') OR root_session_id IN ('t8', 't32')
        OR relative_path LIKE '%/t8/subagents/%' OR relative_path LIKE '%/t32/subagents/%'""",
)
def b14_companions(conv_docs):
    roots = conv_docs.where("root in (8, 32)").select(F.concat(F.lit("t"), "root").alias("root_id")).distinct()
    return predicates.companions(conv_docs, roots).select("document_id")


_SUMMARY = """SELECT document_id, count(*) AS messages, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants,
    cast(coalesce(sum(length(content)) FILTER (role IN ('user', 'assistant')), 0) AS bigint) AS chars FROM messages GROUP BY document_id"""


@query("messages", f"SELECT document_id, users = 0 OR assistants = 0 OR (users + assistants <= 2 AND chars < 120) AS low FROM ({_SUMMARY})")
def b15_is_low_activity(messages):
    low = predicates.is_low_activity(F.col("users"), F.col("assistants"), F.col("chars"))
    return aggregates.activity_summary(messages).select("document_id", low.alias("low"))


@query("messages", "SELECT document_id, line_number, ts, substr(content, 1, 500) AS prompt FROM messages WHERE role = 'user' AND trim(content) <> '' AND content NOT LIKE '%[Subagent Context]%'")
def b16_human_prompts(messages):
    return ingest.prompt_projection(messages)


@query("conv_docs", "SELECT document_id, document_id % 3 = 0 OR document_id % 3 = 1 AS generated FROM conv_docs")
def b17_has_generated_title(conv_docs):
    uuid = F.format_string("%08d-0000-4000-8000-000000000000.jsonl", "document_id")
    title = F.when(F.col("document_id") % 3 == 0, uuid).when(F.col("document_id") % 3 == 1, F.format_string("agent-%d", "document_id")).otherwise("agent notes")
    return conv_docs.select("document_id", predicates.has_generated_title(title).alias("generated"))


@query(
    "docs",
    f"""SELECT document_id, synced FROM docs WHERE (document_id % 4 IN (0, 1) OR (document_id % 4 = 2 AND synced < {NOW - 2100})) AND document_id % 7 < 5
    ORDER BY synced, document_id LIMIT 8""",
)
def b19_retry_candidates(docs):
    status = F.element_at(F.array(*map(F.lit, ("pending", "failed", "processing", "ok"))), (F.col("document_id") % 4 + 1).cast("int"))
    return predicates.retry_candidates(docs.withColumn("status", status).withColumn("attempts", F.col("document_id") % 7), NOW).select("document_id", "synced")


@query("docs", f"SELECT document_id, CASE WHEN length(content) >= 4000 THEN greatest(0, 600 - ({NOW} - synced)) ELSE 0 END AS seconds FROM docs")
def b20_quiet_seconds(docs):
    return docs.select("document_id", predicates.quiet_seconds(F.length("content"), F.col("synced"), NOW, 4000).alias("seconds"))


@query("docs", f"SELECT document_id, project, synced, substr(content, 1, 500) AS preview FROM docs WHERE category = 'memory' AND synced >= {NOW - 30 * 86400} AND lower(project) LIKE '%src1%' ORDER BY synced DESC, document_id LIMIT 20")
def b22_recall(docs):
    return predicates.recall(docs, "memory", 30, NOW, "src1")


@query("versions", "SELECT document_id, hash FROM versions WHERE size > 100000 ORDER BY o_orderkey DESC LIMIT 50 OFFSET 25")
def b23_audit_log(versions):
    return versions.where("size > 100000").orderBy(F.desc("o_orderkey")).offset(25).limit(50).select("document_id", "hash")


@query(
    "docs",
    """SELECT machine_id, document_id, place FROM (SELECT machine_id, document_id, row_number() OVER (PARTITION BY machine_id ORDER BY length(content), document_id) AS place
    FROM docs WHERE document_id % 3 > 0) WHERE place <= 5""",
)
def b24_stale_sources(docs):
    rows = docs.select("machine_id", "document_id", F.length("content").alias("size"), F.lit("b").alias("hash"), F.when(F.col("document_id") % 3 == 0, "b").when(F.col("document_id") % 3 == 1, "a").alias("stored_hash"))
    return predicates.stale_sources(rows, 5).select("machine_id", "document_id", "place")


# --- joins ---------------------------------------------------------------------------


@query("docs projects machines", "SELECT d.document_id, p.title AS project_title, m.name AS machine_name FROM docs d LEFT JOIN projects p ON d.project = p.slug LEFT JOIN machines m USING (machine_id)")
def c1_with_dimensions(docs, projects, machines):
    return joins.with_dimensions(docs, projects, machines).select("document_id", "project_title", "machine_name")


@query("messages docs", "SELECT message_id, tool_id, project FROM messages JOIN docs USING (document_id) WHERE category = 'plan'")
def c2_messages_with_docs(messages, docs):
    return joins.messages_with_docs(messages, docs, "plan").select("message_id", "tool_id", "project")


@query("projects docs", "SELECT slug, count(document_id) AS n FROM projects LEFT JOIN docs ON project = slug GROUP BY slug")
def c3_project_counts(projects, docs):
    return joins.project_counts(projects, docs)


@query("docs conv_docs", "SELECT document_id FROM docs WHERE document_id NOT IN (SELECT document_id FROM conv_docs)")
def c4_orphans(docs, conv_docs):
    return joins.orphans(docs.select("document_id"), conv_docs, "document_id")


@query("relations supplier", "SELECT source_id, target_id, strength FROM relations WHERE source_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def c5_owned(relations, supplier):
    return joins.owned(relations, supplier.where("s_acctbal < 0").withColumnRenamed("s_suppkey", "source_id"), "source_id").select("source_id", "target_id", "strength")


@query("docs versions", f", {_LATEST} SELECT d.document_id, coalesce(l.hash, 'own') = CASE WHEN d.document_id % 2 = 0 THEN 'own' ELSE coalesce(l.hash, 'none') END AS is_current FROM docs d LEFT JOIN latest l USING (document_id)")
def c6_is_current_revision(docs, versions):
    latest = _latest_versions(versions)
    asked = latest.select("document_id", F.col("hash").alias("asked"))
    own = docs.select("document_id", F.lit("own").alias("hash")).join(asked, "document_id", "left")
    revision = F.when(F.col("document_id") % 2 == 0, "own").otherwise(F.coalesce("asked", F.lit("none")))
    return joins.is_current_revision(own, latest, revision).select("document_id", "is_current")


@query(
    "messages",
    """, m AS (SELECT message_id, document_id, content, line_number, ts, 1 AS p FROM messages WHERE role = 'assistant'
        UNION ALL SELECT message_id + 500, document_id, content, line_number + 2, ts + 6, 3 FROM messages WHERE role = 'assistant' AND document_id % 2 = 0
        UNION ALL SELECT message_id + 700, document_id, content, line_number + 2, ts + 60, 2 FROM messages WHERE role = 'assistant' AND document_id % 3 = 0)
    SELECT message_id FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.document_id = b.document_id AND a.content = b.content AND b.p > a.p
        AND abs(a.line_number - b.line_number) <= 4 AND abs(a.ts - b.ts) <= 12)""",
)
def c7_drop_transport_mirrors(messages):
    said = messages.where("role = 'assistant'").select("message_id", "document_id", "content", "line_number", "ts")

    def copy(rows, name, ids, lines, seconds):
        return rows.select((F.col("message_id") + ids).alias("message_id"), "document_id", "content", (F.col("line_number") + lines).alias("line_number"), (F.col("ts") + seconds).alias("ts"), F.lit(name).alias("transport"))

    rows = copy(said, "task_complete", 0, 0, 0).union(copy(said.where("document_id % 2 = 0"), "agent_message", 500, 2, 6)).union(copy(said.where("document_id % 3 = 0"), "response_item", 700, 2, 60))
    return joins.drop_transport_mirrors(rows).select("message_id")


@query(
    "signals messages",
    f"""SELECT document_id, event_id, coalesce((SELECT max(line_number) FROM messages m WHERE m.document_id = s.document_id AND m.ts <= s.t), 0) AS line
    FROM (SELECT document_id, event_id, {E0} + document_id * 3600 + event_id % 600 AS t FROM signals) s""",
)
def c9_anchor_asof(signals, messages):
    events = signals.select("document_id", "event_id", (E0 + F.col("document_id") * 3600 + F.col("event_id") % 600).alias("ts"))
    return joins.anchor_asof(events, messages)


@query(
    "entities relations",
    """SELECT 'out' AS direction, target_id AS far_id, r.type AS relation, strength, e.name AS far_name, e.type AS far_type FROM relations r JOIN entities e ON e.entity_id = target_id WHERE source_id = 7
    UNION ALL SELECT 'in', source_id, r.type, strength, e.name, e.type FROM relations r JOIN entities e ON e.entity_id = source_id WHERE target_id = 7""",
)
def c11_entity_relations(entities, relations):
    return joins.entity_relations(entities, relations, 7)


@query(
    "entities region",
    """SELECT slug, name FROM (SELECT r_name AS slug, name, row_number() OVER (PARTITION BY r_name ORDER BY name) AS n
    FROM (SELECT DISTINCT name FROM entities) JOIN region ON contains(lower(name), lower(substr('brand#', 1, 1 + r_regionkey)))) WHERE n <= 20""",
)
def c12_entities_for_project(entities, region):
    projects = region.select(F.col("r_name").alias("slug"), F.substr(F.lit("brand#"), F.lit(1), F.col("r_regionkey") + 1).alias("title"))
    return joins.entities_for_project(projects, entities)


_COSINE = "list_dot_product(cast(q.embedding AS double[]), cast(c.embedding AS double[])) / sqrt(list_dot_product(cast(q.embedding AS double[]), cast(q.embedding AS double[])) * list_dot_product(cast(c.embedding AS double[]), cast(c.embedding AS double[])))"
_SCORES = f"scores AS (SELECT q.vec_id AS query_id, c.vec_id, c.document_id, c.tier, {_COSINE} AS cosine FROM vectors c JOIN vectors q ON q.tier = c.tier WHERE q.vec_id % 100 = 0)"


def _stated(chunks):
    return chunks.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "tier", F.col("embedding").alias("vector"))


@query("vectors", f", {_SCORES} SELECT query_id, vec_id, round(cosine, 4) + 0.0 AS cosine FROM scores")
def c16_score_vectors(chunks):
    return vectors.score_vectors(_stated(chunks), chunks).select("query_id", "vec_id", (F.round("cosine", 4) + 0.0).alias("cosine"))


# --- aggregations --------------------------------------------------------------------


@query("docs", f"SELECT tool_id, category, count(*) AS n, count(*) FILTER (synced >= {NOW - 86400}) AS n_today FROM docs GROUP BY ALL")
def d1_counts_by_tool_category(docs):
    return aggregates.counts_by_tool_category(docs, NOW - 86400)


@query("docs", f"SELECT {_day('synced', -60)} AS day, tool_id, count(*) AS n FROM docs WHERE synced BETWEEN {NOW - 7 * 86400} AND {NOW} GROUP BY ALL")
def d2_daily_counts(docs):
    return aggregates.daily_counts(docs, NOW, -60)


@query("docs", f"SELECT count(*) AS documents, count(DISTINCT project) AS projects, count(*) FILTER (synced >= {NOW - 86400}) AS today, count(DISTINCT machine_id) AS machines FROM docs")
def d3_dashboard_totals(docs):
    return aggregates.dashboard_totals(docs, NOW - 86400)


@query("messages", _SUMMARY)
def d4_activity_summary(messages):
    return aggregates.activity_summary(messages)


@query("messages", f"SELECT document_id, max(ts) FILTER (role IN ('user', 'assistant') AND ts <= {E0 + 200000}) AS last_ts FROM messages GROUP BY document_id")
def d5_last_activity(messages):
    return aggregates.last_activity(messages, E0 + 200000)


@query("messages docs", f"SELECT {_day('ts', 0)} AS day, count(*) AS messages, array_to_string(list_sort(list(DISTINCT tool_id)), ',') AS tools FROM messages JOIN docs USING (document_id) WHERE {_REAL.replace('content', 'messages.content')} GROUP BY ALL")
def d6_active_days(messages, docs):
    return aggregates.active_days(messages, docs, 0)


@query("messages docs", f"SELECT document_id, tool_id, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants FROM messages JOIN docs USING (document_id) WHERE {_REAL.replace('content', 'messages.content')} AND {_day('ts', 0)} = '2024-01-02' GROUP BY ALL")
def d7_day_detail(messages, docs):
    return aggregates.day_detail(messages, docs, "2024-01-02", 0)


@query("messages", f"SELECT message_id, ts FROM messages WHERE {_REAL} AND {_day('ts', 0)} = '2024-01-02' ORDER BY ts, document_id, line_number LIMIT 20 OFFSET 10")
def d8_day_messages(messages):
    return aggregates.day_messages(messages, "2024-01-02", 0, 10, 20).select("message_id", "ts")


@query("machines docs", "SELECT machine_id, name, count(document_id) AS n, coalesce(array_to_string(list_sort(list(DISTINCT tool_id) FILTER (tool_id IS NOT NULL)), ','), '') AS tools FROM machines LEFT JOIN docs USING (machine_id) GROUP BY ALL")
def d10_device_stats(machines, docs):
    return aggregates.device_stats(machines, docs)


@query("machines docs", f"SELECT user_id, {_HOST} AS host, count(DISTINCT machine_id) AS members, count(DISTINCT concat(tool_id, '|', relative_path)) FILTER (document_id IS NOT NULL) AS files FROM machines LEFT JOIN docs USING (machine_id) GROUP BY ALL")
def d11_host_groups(machines, docs):
    return aggregates.host_groups(machines.withColumn("host", F.lower(T.host_name(F.col("name")))), docs)


@query("docs", "SELECT tool_id, category, count(DISTINCT relative_path) AS files, max(synced) AS last_sync FROM docs GROUP BY ALL")
def d12_distinct_files(docs):
    return aggregates.distinct_files(docs, "tool_id", "category")


@query("entities relations observations", "SELECT 'entities' AS kind, count(*) AS n FROM entities UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'observations', count(*) FROM observations")
def d13_memory_stats(entities, relations, observations):
    return aggregates.memory_stats(entities, relations, observations)


_TERMS = "SELECT DISTINCT message_id, t.term FROM (SELECT message_id, unnest(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}_''-]+')) AS term FROM messages WHERE role IN ('user', 'assistant')) t WHERE regexp_matches(t.term, '^[a-z][a-z0-9_''-]{2,63}$')"


@query("messages", f"SELECT term, count(*) AS frequency FROM ({_TERMS}) GROUP BY term")
def d16_build_lexicon(messages):
    return aggregates.build_lexicon(messages)


@query("messages", "SELECT document_id, sum(n)::bigint AS lines, min(a) AS first_ts, max(b) AS last_ts, array_to_string(list_sort(list(concat(role, '=', n))), ',') AS types FROM (SELECT document_id, role, count(*) AS n, min(ts) AS a, max(ts) AS b FROM messages GROUP BY ALL) GROUP BY document_id")
def d17_transcript_stats(messages):
    return aggregates.transcript_stats(messages)


@query("docs", "SELECT tool_id, relative_path FROM (SELECT *, row_number() OVER (PARTITION BY tool_id ORDER BY synced DESC, document_id DESC) AS n FROM docs) WHERE n = 1")
def d18_sync_status(docs):
    return aggregates.latest_by(docs, "tool_id", "relative_path", "synced", "document_id")


@query("docs", f"SELECT tool_id, document_id, place, n, substr(content, 1, 300) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY tool_id ORDER BY synced, document_id) AS place, count(*) OVER (PARTITION BY tool_id) AS n FROM docs WHERE synced BETWEEN {E0 + 864000} AND {E0 + 950399}) WHERE place <= 20")
def d20_digest_inputs(docs):
    return aggregates.digest_inputs(docs, E0 + 864000)


# --- windows -------------------------------------------------------------------------


@query("messages", "SELECT document_id, line_number, substr(content, 1, 500) AS content FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_number, message_id) AS n FROM messages WHERE contains(lower(content), 'the')) WHERE n = 1")
def e1_first_match_per_doc(messages):
    return windows.first_match_per_doc(messages, "The")


@query("messages", "SELECT message_id, place FROM (SELECT message_id, row_number() OVER (PARTITION BY document_id ORDER BY line_number) AS place FROM messages WHERE role IN ('user', 'assistant')) WHERE place <= 4")
def e2_preview(messages):
    return windows.preview(messages).select("message_id", "place")


@query("vectors", f", {_SCORES} SELECT query_id, document_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY round(cosine, 9) DESC, vec_id) AS n FROM scores) WHERE n = 1")
def e3_best_chunk_per_doc(chunks):
    return vectors.best_chunks(_stated(chunks), chunks).select("query_id", "document_id", "vec_id")


@query("messages", "SELECT document_id, line_number, row_number() OVER (PARTITION BY document_id ORDER BY line_number) AS prompt FROM messages WHERE role = 'user'")
def e4_number_prompts(messages):
    return windows.number_prompts(messages)


@query(
    "messages",
    """SELECT document_id, min(line_number) AS start_line, max(end_line) AS end_line FROM (
        SELECT *, coalesce(lead(line_number) OVER (PARTITION BY document_id ORDER BY line_number) - 1, 2147483647) AS end_line,
            row_number() OVER (PARTITION BY document_id ORDER BY line_number) AS prompt FROM messages WHERE role = 'user') WHERE prompt BETWEEN 2 AND 3 GROUP BY document_id""",
)
def e5_prompt_spans(messages):
    return windows.prompt_spans(messages, 2, 3).select("document_id", "start_line", "end_line")


@query("docs", "SELECT category, relative_path, document_id FROM (SELECT *, row_number() OVER (PARTITION BY category, relative_path ORDER BY synced DESC, document_id DESC) AS n FROM docs) WHERE n = 1")
def e7_latest_by_path(docs):
    return windows.newest_per_key(docs, ["category", "relative_path"], [F.desc("synced"), F.desc("document_id")]).select("category", "relative_path", "document_id")


@query("conv_docs", "SELECT tool_id, thread, document_id FROM (SELECT *, row_number() OVER (PARTITION BY tool_id, thread ORDER BY mtime DESC, file_size DESC, synced DESC, document_id) AS n FROM conv_docs) WHERE n = 1")
def e8_canonical_by_session(conv_docs):
    return windows.newest_per_key(conv_docs, ["tool_id", "thread"], [F.desc("mtime"), F.desc("file_size"), F.desc("synced"), F.col("document_id")]).select("tool_id", "thread", "document_id")


@query(
    "messages",
    """SELECT message_id, substr(c, 1, 4000 - used) AS content FROM (SELECT message_id, c, cast(coalesce(sum(length(c)) OVER (PARTITION BY document_id ORDER BY line_number
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS int) AS used FROM (SELECT *, substr(content, 1, 1500) AS c FROM messages WHERE role IN ('user', 'assistant'))) WHERE used < 4000""",
)
def e9_take_within_budget(messages):
    rows = messages.where("role in ('user', 'assistant')")
    return windows.take_within_budget(rows, "document_id", ["line_number"], "content", 4000, 1500).select("message_id", "content")


@query("messages", "SELECT message_id, last_value(CASE WHEN message_id % 5 = 0 THEN message_id END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_number) AS model FROM messages")
def e10_carry_identity(messages):
    marked = messages.select("message_id", "document_id", "line_number", F.when(F.col("message_id") % 5 == 0, F.col("message_id")).alias("model"))
    return windows.carry_forward(marked, "document_id", "line_number", "model").select("message_id", "model")


@query(
    "messages",
    """SELECT message_id, CASE WHEN (m = 's' OR role = 'assistant') AND n > 0 THEN n END AS turn_no FROM (SELECT message_id, role,
        cast(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS bigint) AS n, last_value(CASE WHEN role = 'user' THEN 's' WHEN role = 'assistant' THEN 'e' END IGNORE NULLS) OVER w AS m
        FROM messages WINDOW w AS (PARTITION BY document_id ORDER BY line_number))""",
)
def e11_carry_turn(messages):
    return windows.carry_turn(messages, "document_id", "line_number", F.col("role") == "user", F.col("role") == "assistant").select("message_id", "turn_no")


@query(
    "messages",
    """, h AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY length(content) DESC, message_id) AS place FROM messages WHERE contains(lower(content), 'the'))
    SELECT message_id, place FROM h WHERE place <= 3 AND document_id IN (SELECT document_id FROM h WHERE place = 1 ORDER BY length(content) DESC, message_id LIMIT 20)""",
)
def e12_hits_per_group(messages):
    hits = messages.where(search.ilike_contains(F.col("content"), "the"))
    return windows.hits_per_group(hits, "document_id", [F.desc(F.length("content")), F.col("message_id")]).select("message_id", "place")


# --- sort, limit, sets ---------------------------------------------------------------


@query("messages", "SELECT message_id FROM messages ORDER BY ts DESC, message_id LIMIT 26 OFFSET 50")
def f1_page(messages):
    return messages.orderBy(F.desc("ts"), "message_id").offset(50).limit(26).select("message_id")


@query("messages", "SELECT message_id FROM messages WHERE document_id = 5 AND line_number BETWEEN 2 AND 5")
def f2_message_window(messages):
    return windows.message_window(messages, 5, 4, 2, 1).select("message_id")


@query("conv_docs", "SELECT document_id FROM conv_docs WHERE document_id % 9 = 0 UNION ALL SELECT document_id FROM (SELECT document_id FROM conv_docs WHERE document_id % 9 <> 0 ORDER BY synced DESC, document_id LIMIT 20)")
def f3_attention_then_recent(conv_docs):
    return windows.attention_then_recent(conv_docs, F.col("document_id") % 9 == 0, [F.desc("synced"), F.col("document_id")], 20).select("document_id")


@query("messages", "SELECT document_id, max(line_number) FILTER (role = 'assistant') AS line_number FROM messages GROUP BY document_id")
def f6_latest_assistant_line(messages):
    return windows.latest_assistant_line(messages)


@query("entities relations", ", n AS (SELECT entity_id FROM entities ORDER BY entity_id DESC LIMIT 1950) SELECT source_id, target_id, type, strength FROM relations WHERE source_id IN (SELECT * FROM n) AND target_id IN (SELECT * FROM n)")
def f7_recent_graph(entities, relations):
    return graph.recent_graph(entities, relations, 1950).select("source_id", "target_id", "type", "strength")


@query("docs", "SELECT document_id, title FROM docs WHERE document_id % 3 = 0 UNION ALL SELECT document_id, 'legacy' FROM docs WHERE document_id % 3 <> 0")
def g1_union_projected_legacy(docs):
    projected = docs.where("document_id % 3 = 0").select("document_id", "title")
    return joins.union_projected_legacy(projected, docs.select("document_id", F.lit("legacy").alias("title")), "document_id")


@query("docs", "SELECT document_id, CASE WHEN document_id % 2 = 0 THEN 1 ELSE 2 END AS rank FROM docs WHERE document_id % 2 = 0 OR document_id % 3 = 0")
def g2_merge_by_id(docs):
    first, second = (docs.where(f"document_id % {k} = 0").select("document_id", F.lit(k - 1).alias("rank")) for k in (2, 3))
    return joins.merge_by_id(first, second, "document_id")


@query("messages conv_docs", "SELECT document_id FROM messages WHERE contains(lower(content), 'the') INTERSECT SELECT document_id FROM messages WHERE role = 'system' INTERSECT SELECT document_id FROM conv_docs WHERE tool_id = 'codex'")
def g3_intersect_matches(messages, conv_docs):
    hits = messages.where(search.ilike_contains(F.col("content"), "the")).select("document_id")
    return hits.intersect(messages.where("role = 'system'").select("document_id")).intersect(conv_docs.where("tool_id = 'codex'").select("document_id"))


@query("orders", "SELECT coalesce(a.term, b.term) AS term, a.frequency, CASE WHEN a.term IS NULL THEN 'delete' WHEN b.term IS NULL THEN 'insert' WHEN a.frequency = b.frequency THEN 'keep' ELSE 'update' END AS action FROM (SELECT o_orderpriority AS term, count(*) AS frequency FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW' GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS term, count(*) AS frequency FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1) b USING (term)")
def g4_replace_lexicon(orders):
    def counts(rows):
        return rows.groupBy(F.col("o_orderpriority").alias("term")).agg(F.count("*").alias("frequency"))

    return search.replace_lexicon(counts(orders.where("o_orderstatus <> 'O' and o_orderpriority <> '5-LOW'")), counts(orders.where("o_orderpriority <> '1-URGENT'")))


@query("messages", "SELECT message_id FROM messages WHERE line_number BETWEEN 1 AND 3 OR line_number = 5 OR line_number >= 7")
def g5_in_any_interval(messages):
    return joins.in_any_interval(messages, "line_number", [(1, 2), (7, None), (2, 3), (5, 5)]).select("message_id")


# --- text search ---------------------------------------------------------------------

_SEP = """[\\s　.,;:!?\\-_/\\\\()\\[\\]{}"''`~@#$%^&*+=<>|]+"""
_RUNS = f"CASE WHEN NOT regexp_matches(p, '[{T.UNSPACED}]') THEN [p] ELSE flatten(list_transform(regexp_extract_all(p, '[{T.UNSPACED}]+|[^{T.UNSPACED}{T.MARKS}]+'), lambda r: CASE WHEN regexp_matches(r, '^[{T.UNSPACED}]{{2,}}$') THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END)) END"
_TOK = f"list_filter(flatten(list_transform(regexp_split_to_array(lower(substr(content, 1, 200000)), '{_SEP}'), lambda p: {_RUNS})), lambda x: length(x) > 1 OR regexp_matches(x, '^[^\\x00-\\x7F]$'))"


@query("messages", f"SELECT message_id, array_to_string({_TOK}, ' ') AS tokens FROM messages")
def h1_tokenize_index(messages):
    return messages.select("message_id", F.array_join(T.tokens(F.col("content")), " ").alias("tokens"))


#: All tokens of the whole text, without an index entry's bounds.
_WHOLE = _TOK.replace("substr(content, 1, 200000)", "content")
_ASKED = "list_filter({t}, lambda x, i: list_position({t}, x) = i)"


@query("messages", f"SELECT message_id, array_to_string({_ASKED.format(t='t')}[1:16], ' ') AS tokens FROM (SELECT message_id, {_TOK} AS t FROM messages)")
def h2_tokenize_query(messages):
    return messages.select("message_id", F.array_join(T.query_tokens(F.col("content")), " ").alias("tokens"))


@query("docs", f"SELECT document_id FROM docs WHERE list_has_all({_TOK}, ['the', 'of', 'and'])")
def h3_fts_match(docs):
    return search.fts_match(docs, "The of, and of").select("document_id")


@query("messages", f"SELECT message_id FROM (SELECT message_id, {_TOK} AS t FROM messages) WHERE list_contains(t, 'the') AND contains(concat(' ', array_to_string(t, ' '), ' '), ' of the ') AND list_has_any(t, ['and', 'with']) AND NOT list_has_any(t, ['was'])")
def h4_boolean_search(messages):
    return search.boolean_search(messages, ["the"], ["of the"], ["and", "with"], ["was"]).select("message_id")


@query("messages", "SELECT message_id FROM messages WHERE contains(lower(content), 'ing of')")
def h6_ilike_contains(messages):
    return messages.where(search.ilike_contains(F.col("content"), "Ing of")).select("message_id")


def _grams(text: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3)))))"


def _alike(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1)::double"


@query("part", f"SELECT p_partkey, round({_alike(_grams('p_name'), _grams('p_type'))}, 4) AS similarity FROM part")
def h7_trigram_similarity(part):
    return part.select("p_partkey", F.round(T.trigram_similarity(F.col("p_name"), F.col("p_type")), 4).alias("similarity"))


@query("messages", f"SELECT message_id, CASE WHEN e THEN 4.0::double ELSE 3.0::double END AS score, CASE WHEN e THEN 'exact' ELSE 'full_text' END AS match_type FROM (SELECT message_id, contains(lower(content), 'the and') AS e, list_has_all({_TOK}, ['the', 'and']) AS l FROM messages WHERE role IN ('user', 'assistant')) WHERE e OR l")
def h9_score_messages(messages):
    return search.score_messages(messages, "the and").select("message_id", "score", "match_type")


@query(
    "messages",
    f""", lexicon AS (SELECT term, count(*) AS frequency, {_grams("term")} AS g FROM ({_TERMS}) GROUP BY term),
    q AS (SELECT DISTINCT token FROM (SELECT unnest({_WHOLE}) AS token FROM messages WHERE role = 'user') WHERE regexp_matches(token, '^[\\x00-\\x7F]+$')),
    a AS (SELECT token, coalesce(frequency, 0) AS own, {_grams("token")} AS h FROM q LEFT JOIN lexicon ON term = token),
    m AS (SELECT DISTINCT token, term FROM (SELECT token, unnest(h) AS gram FROM a) JOIN (SELECT term, unnest(g) AS gram FROM lexicon) USING (gram) WHERE token <> term AND abs(length(token) - length(term)) <= 2),
    s AS (SELECT token, own, term, frequency, {_alike("h", "g")} AS similarity FROM m JOIN a USING (token) JOIN lexicon USING (term)),
    b AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY similarity DESC, frequency DESC, term) AS n FROM s)
    SELECT token, term, similarity FROM b WHERE n = 1 AND CASE WHEN own = 0 THEN similarity >= 0.45 ELSE similarity >= 0.55 AND frequency >= 20 AND frequency >= 20 * own END""",
)
def h10_correct_queries(messages):
    asked = messages.where("role = 'user'").select(F.col("content").alias("query"))
    return search.correct_queries(asked, aggregates.build_lexicon(messages))


@query(
    "messages",
    """SELECT message_id, concat(CASE WHEN start > 1 THEN '…' ELSE '' END, substr(said, start, 120), CASE WHEN start + 119 < length(said) THEN '…' ELSE '' END) AS snippet
    FROM (SELECT message_id, said, greatest(1, strpos(lower(said), 'ing of') - 57) AS start FROM (SELECT message_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS said FROM messages WHERE contains(lower(content), 'ing of')))""",
)
def h14_snippet(messages):
    return messages.where(search.ilike_contains(F.col("content"), "ing of")).select("message_id", T.snippet(F.col("content"), "ing of", 120).alias("snippet"))


@query("messages", "SELECT message_id, substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 500) AS query FROM messages")
def h16_normalize_query(messages):
    return messages.select("message_id", T.normalize_query(F.col("content")).alias("query"))


# --- redaction and scalars -----------------------------------------------------------


def _nested_redaction() -> str:
    text = "content"
    for pattern, mask in T.SECRETS:
        text = f"regexp_replace({text}, '{pattern.replace("'", "''")}', '{mask.replace('$1', chr(92) + '1')}', 'g')"
    return text


@query("docs", f"SELECT document_id, sha256({_nested_redaction()}) AS digest FROM docs")
def i1_redact(docs):
    return docs.select("document_id", F.sha2(T.redact(F.col("content")), 256).alias("digest"))


def _counted_redaction() -> str:
    """As many replacements as each pattern makes in what the ones before it left."""
    text, total = "content", "0"
    for pattern, mask in T.SECRETS:
        quoted = pattern.replace("'", "''")
        total += f" + len(regexp_extract_all({text}, '{quoted}'))"
        text = f"regexp_replace({text}, '{quoted}', '{mask.replace('$1', chr(92) + '1')}', 'g')"
    return total


@query("docs", f"SELECT document_id, {_counted_redaction()} AS n FROM docs")
def i1_count_secrets(docs):
    return docs.select("document_id", T.count_secrets(F.col("content")).alias("n"))


@query("events", "SELECT event_id, concat(event_type, ' done') AS line FROM events")
def i2_strip_terminal(events):
    return events.select("event_id", T.strip_terminal(F.concat(F.lit("\x1b[31m"), "event_type", F.lit("\x1b[0m done"))).alias("line"))


@query("events", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'host' ELSE concat('10.', user_id % 256, '.', event_id % 256, '.0') END AS ip FROM events")
def i6_anonymize_ip(events):
    ip = F.when(F.col("event_id") % 3 == 0, "host").otherwise(F.concat_ws(".", F.lit("10"), F.col("user_id") % 256, F.col("event_id") % 256, F.col("user_id") % 250))
    return events.select("event_id", T.anonymize_ip(ip).alias("ip"))


@query("machines", f"SELECT machine_id, {_HOST} AS host, CASE WHEN name LIKE '%(Windows)' THEN 'Windows' WHEN name LIKE '%(Linux)' THEN 'Linux' ELSE 'Unknown' END AS platform, {_HOST_ID.replace('cast(user_id as varchar)', 'coalesce(cast(user_id as varchar), cast(machine_id as varchar))')} AS host_id FROM machines")
def i8_host_id(machines):
    owner = F.coalesce(F.col("user_id").cast("string"), F.col("machine_id").cast("string"))
    return machines.select("machine_id", F.lower(T.host_name(F.col("name"))).alias("host"), T.platform(F.col("name")).alias("platform"), T.host_id(owner, F.col("name")).alias("host_id"))


_COMPACT = """SELECT message_id, CASE WHEN c = '' THEN NULL WHEN length(c) <= 96 THEN c ELSE concat(regexp_replace(CASE WHEN contains(s, ' ') THEN regexp_replace(s, ' [^ ]*$', '') ELSE s END, '[.,;:\\-]+$', ''), '…') END AS title
    FROM (SELECT *, rtrim(substr(c, 1, 95)) AS s FROM (SELECT message_id, trim(regexp_replace(regexp_replace(trim(content), '\\s+', ' ', 'g'), '^[#>*`\\-\\s]+', '')) AS c FROM messages))"""


@query("messages", _COMPACT)
def i9_compact_title(messages):
    return messages.select("message_id", T.compact_title(F.col("content")).alias("title"))


@query("conv_docs", "SELECT document_id, nullif(regexp_extract(relative_path, '([^/]+)/subagents/', 1), '') AS root, CASE WHEN relative_path LIKE '%/subagents/%' THEN 1 ELSE 0 END AS depth FROM conv_docs")
def i12_subagent_path_identity(conv_docs):
    return conv_docs.select("document_id", T.subagent_root(F.col("relative_path")).alias("root"), T.subagent_depth(F.col("relative_path")).alias("depth"))


@query("docs", "SELECT document_id, concat(coalesce(nullif(substr(regexp_replace(regexp_replace(trim(project || ' notes!'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'conversation'), '-', lpad(cast(document_id AS varchar), 8, '0')) AS name FROM docs")
def i13_safe_filename(docs):
    return docs.select("document_id", T.safe_filename(F.concat("project", F.lit(" notes!")), F.lpad(F.col("document_id").cast("string"), 8, "0")).alias("name"))


@query("events", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'xai' WHEN 3 THEN 'google' END AS family FROM events")
def i15_model_family(events):
    names = F.array(*map(F.lit, ("claude-x", "gpt-5", "Grok-4", "gemini-pro", "other")))
    return events.select("event_id", T.model_family(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))).alias("family"))


@query("events", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'pending' END AS status FROM events")
def i16_normalize_status(events):
    names = F.array(*map(F.lit, ("Done", "in progress", "TODO", "odd")))
    return events.select("event_id", T.normalize_status(F.element_at(names, (F.col("event_id") % 4 + 1).cast("int"))).alias("status"))


@query("docs", """SELECT document_id, sha256(concat('{"document_id":', document_id, ',"tool_id":"', tool_id, '","project":"', project, '"}')) AS digest FROM docs""")
def i17_fingerprint(docs):
    return docs.select("document_id", T.fingerprint("document_id", "tool_id", "project").alias("digest"))


@query("messages", "SELECT message_id, trim(content) AS text FROM messages")
def j20_strip_system_tags(messages):
    tagged = F.concat(F.lit("<system-reminder>\nx</system-reminder>"), F.col("content"), F.lit("<command-name a='1'>y</command-name>"))
    return messages.select("message_id", T.strip_system_tags(tagged).alias("text"))


@query("messages", "SELECT message_id FROM (SELECT *, CASE WHEN message_id % 4 = 0 THEN 1 ELSE row_number() OVER (PARTITION BY document_id, CASE WHEN message_id % 4 <> 0 THEN message_id % 3 END ORDER BY line_number, message_id) END AS n FROM (SELECT * FROM messages WHERE message_id % 4 <> 0)) WHERE n = 1 UNION ALL SELECT message_id FROM messages WHERE message_id % 4 = 0")
def j8_dedup_source_ids(messages):
    rows = messages.withColumn("source_id", F.when(F.col("message_id") % 4 != 0, F.col("message_id") % 3))
    return windows.dedup_source_ids(rows, "source_id", "document_id", "line_number").select("message_id")


@query("signals", "SELECT activity_id, status, cast(floor(epoch(ts)) AS bigint) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY ts DESC, event_id DESC) AS n FROM signals) WHERE n = 1 AND status = 'running'")
def j13_live_activities(signals):
    return ingest.live_activities(signals).select("activity_id", "status", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("ts"))


# --- hierarchy -----------------------------------------------------------------------

_CHILD = "(CASE WHEN tool_id = 'codex' THEN root_session_id IS NOT NULL ELSE contains(relative_path, '/subagents/') END)"
_ROOT = "(CASE WHEN tool_id = 'codex' THEN coalesce(root_session_id, thread) ELSE coalesce(nullif(regexp_extract(relative_path, '([^/]+)/subagents/', 1), ''), thread) END)"
_FOLD = f""", r AS (SELECT *, {_CHILD} AS child, {_ROOT} AS top FROM conv_docs),
    o AS (SELECT *, row_number() OVER (PARTITION BY tool_id, top ORDER BY child, CASE WHEN child THEN depth ELSE 0 END, synced DESC, file_size DESC, document_id) AS n FROM r),
    g AS (SELECT tool_id, top, min(document_id) FILTER (n = 1) AS canonical_id, bool_or(child AND n = 1) AS orphan, count(DISTINCT thread) FILTER (child) AS threads FROM o GROUP BY ALL)"""


@query("conv_docs", f"SELECT document_id, {_CHILD} AS child, {_ROOT} AS root FROM conv_docs")
def k1_is_subagent(conv_docs):
    return conv_docs.select("document_id", hierarchy.is_subagent().alias("child"), hierarchy.root_thread().alias("root"))


@query("conv_docs", _FOLD + " SELECT document_id, o.top AS root, canonical_id, n = 1 AS visible, cast(threads - CASE WHEN orphan THEN 1 ELSE 0 END AS int) AS subagents FROM o JOIN g ON o.tool_id = g.tool_id AND o.top = g.top")
def k4_fold(conv_docs):
    return hierarchy.fold(conv_docs)


@query("conv_docs", _FOLD + " SELECT canonical_id, max(coalesce(activity, least(mtime, synced))) AS ts FROM o JOIN g ON o.tool_id = g.tool_id AND o.top = g.top GROUP BY 1")
def k7_logical_activity(conv_docs):
    activity = conv_docs.select("document_id", predicates.effective_activity(F.col("activity"), F.col("mtime"), F.col("synced")).alias("ts"))
    return hierarchy.logical_activity(hierarchy.fold(conv_docs), activity)


# --- knowledge graph -----------------------------------------------------------------


@query("entities", "SELECT user_id, name, type, max_by(summary, (length(summary), summary)) AS summary, count(*) AS merged FROM entities GROUP BY ALL")
def l3_merge_entities(entities):
    return graph.merge_entities(entities)


@query("relations entities", "SELECT source_id, target_id, type, cast(sum(strength) AS bigint) AS strength FROM relations WHERE source_id <> target_id AND source_id IN (SELECT entity_id FROM entities) AND target_id IN (SELECT entity_id FROM entities) GROUP BY ALL")
def l4_merge_relations(relations, entities):
    return graph.merge_relations(relations, entities)


@query("entities", "SELECT entity_id, CASE WHEN entity_id % 4 = 0 THEN 'ok' WHEN entity_id % 12 >= 8 THEN 'permanent_failed' ELSE 'failed' END AS status, least(86400, cast(900 * pow(2, entity_id % 12 - 1) AS bigint)) AS delay FROM entities WHERE entity_id % 12 > 0")
def l6_extraction_status(entities):
    tries = (F.col("entity_id") % 12).cast("int")
    return entities.where("entity_id % 12 > 0").select("entity_id", graph.extraction_status(tries, F.col("entity_id") % 4 == 0).alias("status"), graph.retry_delay(tries).alias("delay"))


@query("observations", "SELECT entity, count(*) AS n, sha256(string_agg(concat('- ', strftime(observed, '%Y-%m-%d'), ': ', content), chr(10) ORDER BY concat('- ', strftime(observed, '%Y-%m-%d'), ': ', content))) AS digest FROM observations WHERE observed < date '1996-01-01' GROUP BY entity HAVING count(*) >= 5")
def l7_compaction_candidates(observations):
    return graph.compaction_candidates(observations, F.lit("1996-01-01").cast("date"))


@query("relations", "SELECT source_id, target_id, type, strength FROM relations WHERE strength >= 1.5")
def l9_prune_weak_relations(relations):
    return graph.prune_weak_relations(relations).select("source_id", "target_id", "type", "strength")


@query("entities observations", "SELECT entity_id FROM entities WHERE name IN (SELECT entity FROM observations WHERE l_orderkey % 7 = 0)")
def l10_vacuum(entities, observations):
    return graph.vacuum(entities, observations.where("l_orderkey % 7 = 0")).select("entity_id")


@query("entities observations", "SELECT place, name, text FROM (SELECT DISTINCT 1 AS place, name, summary AS text FROM entities WHERE contains(lower(name), 'brand#1') OR contains(lower(summary), 'brand#1') UNION SELECT DISTINCT 2, entity, content FROM observations WHERE contains(lower(content), 'brand#1')) ORDER BY place, name, text LIMIT 40")
def l11_search_graph(entities, observations):
    return graph.search_graph(entities, observations, "brand#1", 40)


@query("observations", "SELECT content, cast(observed AS varchar) AS observed FROM observations WHERE entity = (SELECT min(entity) FROM observations) ORDER BY observations.observed DESC, l_orderkey, l_linenumber, l_partkey, content LIMIT 20")
def l12_entity_detail(observations):
    first = observations.agg(F.min("entity")).first()[0]
    return graph.entity_detail(observations, first).select("content", F.col("observed").cast("string").alias("observed"))


@query(
    "entities observations",
    """, n AS (SELECT DISTINCT name FROM entities WHERE contains(lower(name), 'brand#2') ORDER BY name LIMIT 5),
    f AS (SELECT name, content, row_number() OVER (PARTITION BY name ORDER BY observed DESC, content) AS place FROM (SELECT DISTINCT entity AS name, content, observed FROM observations) JOIN n USING (name))
    SELECT name, string_agg(content, '; ' ORDER BY place) AS text, 0.7::double AS score FROM f WHERE place <= 3 GROUP BY name""",
)
def l14_graph_hits(entities, observations):
    return graph.graph_hits(entities, observations, "brand#2")


# --- embeddings ----------------------------------------------------------------------


@query("vectors", "SELECT document_id, chunk_index FROM vectors WHERE document_id % 3 = 0 OR (document_id % 3 = 1 AND chunk_index > 2)")
def m3_changed_chunks(chunks):
    new = chunks.select("document_id", "chunk_index", F.lit("h").alias("hash"))
    stored = chunks.where("document_id % 3 > 0").select("document_id", "chunk_index", F.when((F.col("document_id") % 3 == 1) & (F.col("chunk_index") > 2), "old").otherwise("h").alias("hash"))
    return vectors.changed_chunks(new, stored).select("document_id", "chunk_index")


@query("vectors", "SELECT document_id, chunk_index, CASE WHEN document_id % 2 = 0 AND chunk_index < 3 THEN 'new' ELSE 'old' END AS state FROM vectors WHERE document_id % 2 = 1 OR chunk_index < 3")
def m4_merge_vectors(chunks):
    rows = chunks.select("document_id", "chunk_index", F.lit("old").alias("state"))
    return vectors.merge_vectors(rows, rows.where("document_id % 2 = 0 and chunk_index < 3").withColumn("state", F.lit("new")))


@query("vectors", "SELECT vec_id, len(embedding) = 64 AS valid FROM vectors")
def m6_validate_vectors(chunks):
    return vectors.validate_vectors(chunks, 64).select("vec_id", "valid")


_TOPK = f", {_SCORES}, b AS (SELECT query_id, document_id, max(round(cosine, 9)) AS cosine FROM scores GROUP BY ALL), t AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, document_id) AS rank FROM b)"


def _ranked(chunks, k):
    return vectors.semantic_search(_stated(chunks), chunks, k).select("query_id", "document_id", "rank")


@query("vectors", _TOPK + " SELECT query_id, document_id, rank FROM t WHERE rank <= 10")
def m7_semantic_search(chunks):
    return _ranked(chunks, 10)


@query("vectors", _TOPK + ", d AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY document_id DESC) AS rank FROM b) SELECT query_id, document_id, round(sum(1.0::double / (60 + rank)), 9) AS score FROM (SELECT * FROM t WHERE rank <= 10 UNION ALL SELECT * FROM d WHERE rank <= 10) GROUP BY ALL")
def m8_rrf(chunks):
    # the newest documents are those of a tier, whatever the query
    newest = chunks.select("document_id", "tier").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("document_id")))).where("rank <= 10")
    newest = newest.join(_stated(chunks).select("query_id", "tier"), "tier")
    both = _ranked(chunks, 10).unionByName(newest.select("query_id", "document_id", "rank"))
    return vectors.rrf(both).withColumn("score", F.round("score", 9))


# --- ingest --------------------------------------------------------------------------

_DEDUP = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, hash, byte_offset ORDER BY delivered, size, base_offset) AS n FROM deliveries) WHERE n = 1)"


@query("deliveries", f", {_DEDUP} SELECT source, byte_offset, size FROM u")
def n1_dedup_deliveries(deliveries):
    return ingest.dedup_deliveries(deliveries).select("source", "byte_offset", "size")


@query("deliveries", f", {_DEDUP} SELECT source, byte_offset, CASE WHEN byte_offset <= c THEN 'stale' WHEN base_offset <> c THEN 'mismatched' ELSE 'applicable' END AS disposition FROM (SELECT *, CASE WHEN source % 2 = 0 THEN 200 ELSE 0 END AS c FROM u)")
def n2_guard_deltas(deliveries):
    state = deliveries.where("source % 2 = 0").select("source").distinct().withColumn("byte_offset", F.lit(200))
    return ingest.guard_deltas(ingest.dedup_deliveries(deliveries, ("source",)), state).select("source", "byte_offset", "disposition")


@query("deliveries", "SELECT source, hash, size FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY delivered DESC, byte_offset DESC, size DESC, hash DESC) AS n FROM deliveries WHERE mode = 'full') WHERE n = 1")
def n3_supersedes(deliveries):
    return ingest.latest_full(deliveries)


@query(
    "deliveries",
    f""", {_DEDUP}, g AS (SELECT *, coalesce(base_offset <> lag(byte_offset) OVER w, false) AS gap FROM u WHERE mode = 'delta' WINDOW w AS (PARTITION BY source ORDER BY byte_offset)),
    c AS (SELECT *, bool_or(gap) OVER w AS broken, sum(size) OVER w AS bytes FROM g WINDOW w AS (PARTITION BY source ORDER BY byte_offset))
    SELECT source, count(*) AS jobs, cast(sum(size) AS bigint) AS size, max(byte_offset) AS byte_offset, string_agg(hash, '|' ORDER BY byte_offset) AS chain FROM c WHERE NOT broken AND bytes <= 100 GROUP BY source""",
)
def n5_coalesce_chain(deliveries):
    return ingest.coalesce_chain(ingest.dedup_deliveries(deliveries, ("source",)), max_bytes=100)


@query("deliveries", "SELECT source, max(byte_offset) AS byte_offset, max_by(hash, byte_offset) AS hash FROM deliveries GROUP BY source")
def n9_update_sync_state(deliveries):
    early = deliveries.where("delivered < date'1995-01-01'")
    state = early.groupBy("source").agg(F.max("byte_offset").alias("byte_offset"), F.max_by("hash", "byte_offset").alias("hash"))
    return ingest.update_sync_state(state, deliveries.where("delivered >= date'1995-01-01'"))


@query("conv_docs", "SELECT document_id, least(CASE WHEN document_id % 5 > 0 THEN mtime END, synced) AS ts FROM conv_docs")
def n11_bounded_source_time(conv_docs):
    mtime = F.when(F.col("document_id") % 5 > 0, F.col("mtime"))
    return conv_docs.select("document_id", ingest.bounded_source_time(mtime, F.col("synced")).alias("ts"))


_MODEL = f"SELECT s.*, l.line_number FROM ({_SUMMARY}) s LEFT JOIN (SELECT document_id, max(line_number) FILTER (role = 'assistant') AS line_number FROM messages GROUP BY 1) l USING (document_id)"


@query("messages", _MODEL)
def n12_refresh_read_model(messages):
    """Incremental: what was projected through line 3, merged with the lines behind it."""
    return ingest.merge_read_model(ingest.refresh_read_model(messages.where("line_number <= 3")), ingest.refresh_read_model(messages.where("line_number > 3")))


@query("messages", "SELECT document_id, line_number FROM messages WHERE line_number <= 3 UNION ALL SELECT document_id, coalesce(m, 0) + row_number() OVER (PARTITION BY document_id ORDER BY line_number) FROM messages LEFT JOIN (SELECT document_id, max(line_number) AS m FROM messages WHERE line_number <= 3 GROUP BY 1) USING (document_id) WHERE line_number > 4")
def n8_append_messages(messages):
    rows = messages.select("document_id", "line_number")
    return ingest.append_messages(rows.where("line_number <= 3"), rows.where("line_number > 4"))


@query("docs", "SELECT document_id FROM docs WHERE document_id % 4 = 0 OR document_id % 5 = 0")
def n15_invalidate_embeddings(docs):
    new = docs.select("document_id", F.md5("content").alias("hash"))
    old = new.where("document_id % 4 > 0").withColumn("hash", F.when(F.col("document_id") % 5 == 0, "old").otherwise(F.col("hash")))
    return ingest.invalidate_embeddings(old, new)


# --- compositions --------------------------------------------------------------------


@query("messages", f"SELECT day, max(ts) > min(created) AS stale FROM (SELECT {_day('ts', -480)} AS day, ts, {E0} + document_id * 0 + 250000 AS created FROM messages) GROUP BY day")
def d9_summary_staleness(messages):
    summaries = messages.select(predicates.local_day(F.col("ts"), -480).alias("day"), F.lit(E0 + 250000).alias("created")).distinct()
    return reports.summary_staleness(summaries, messages)


@query("docs messages projects machines", "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM machines) AS machines")
def d14_public_stats(docs, messages, projects, machines):
    counts = [t.agg(F.count("*").alias(n)) for n, t in (("documents", docs), ("messages", messages), ("projects", projects), ("machines", machines))]
    return counts[0].join(counts[1]).join(counts[2]).join(counts[3])  # one row each


@query(
    "messages",
    """SELECT document_id, string_agg(substr(c, 1, 3000 - used), chr(10) ORDER BY line_number) AS digest FROM (
        SELECT document_id, line_number, c, cast(coalesce(sum(length(c)) OVER (PARTITION BY document_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS int) AS used
        FROM (SELECT *, concat(role, ': ', substr(content, 1, 500)) AS c FROM messages WHERE role IN ('user', 'assistant'))) WHERE used < 3000 GROUP BY document_id""",
)
def d21_conversation_digest(messages):
    return reports.conversation_digest(messages)


@query("customer orders", "SELECT c_custkey AS link_id, count(o_orderkey) AS views FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def d22_share_counts(customer, orders):
    return reports.share_counts(customer.select(F.col("c_custkey").alias("link_id")), orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("link_id")))


@query("conv_docs", _FOLD + " SELECT canonical_id, cast(sum(document_id % 3) AS bigint) AS pending FROM o JOIN g ON o.tool_id = g.tool_id AND o.top = g.top GROUP BY 1")
def d23_pending_by_root(conv_docs):
    return reports.pending_by_root(hierarchy.fold(conv_docs), conv_docs.select("document_id", (F.col("document_id") % 3).alias("pending")))


@query("lineitem", "SELECT l_orderkey, count(*) FILTER (s = 0)::int AS pending, count(*) FILTER (s = 1)::int AS in_progress, count(*) FILTER (s = 2)::int AS blocked, count(*) FILTER (s = 3)::int AS completed, count(*) FILTER (s = 4)::int AS cancelled, count(*) FILTER (s < 3)::int AS outstanding FROM (SELECT l_orderkey, l_partkey % 5 AS s FROM lineitem) GROUP BY 1")
def d24_task_counts(lineitem):
    names = F.array(*map(F.lit, ("pending", "in_progress", "blocked", "completed", "cancelled")))
    tasks = lineitem.groupBy("l_orderkey").agg(F.collect_list(F.element_at(names, (F.col("l_partkey") % 5 + 1).cast("int"))).alias("tasks"))
    return tasks.select("l_orderkey", *reports.task_counts(F.col("tasks")))


@query("messages", "SELECT message_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, line_number DESC) AS n FROM messages WHERE role = 'assistant') WHERE n <= 2 ORDER BY ts DESC, line_number DESC, document_id LIMIT 50")
def e6_task_history(messages):
    return reports.task_history(messages.where("role = 'assistant'"), 2).select("message_id")


@query("messages", f"SELECT message_id, score FROM (SELECT message_id, ts, CASE WHEN contains(lower(content), 'the and') THEN 4.0::double ELSE 3.0::double END AS score FROM messages WHERE role IN ('user', 'assistant') AND (contains(lower(content), 'the and') OR list_has_all({_TOK}, ['the', 'and']))) ORDER BY score DESC, ts DESC, message_id LIMIT 121")
def f4_overfetch_candidates(messages):
    """min(12 * limit + 1, 401) candidates for a limit of 10."""
    return search.score_messages(messages, "the and").orderBy(F.desc("score"), F.desc("ts"), "message_id").limit(min(12 * 10 + 1, 401)).select("message_id", "score")


_GROUPS = "SELECT tool_id, coalesce(root_session_id, thread, cast(document_id AS varchar)) AS group_key, count(*) AS members, max(coalesce(activity, least(mtime, synced))) AS ts FROM conv_docs GROUP BY ALL"


@query("conv_docs", f"SELECT group_key, ts FROM ({_GROUPS}) WHERE ts < {E0 + 200000} ORDER BY ts DESC, group_key LIMIT 10")
def f5_timeline_page(conv_docs):
    groups = predicates.after_cursor(reports.project_timeline(conv_docs), [("ts", E0 + 200000, True)])
    return groups.orderBy(F.desc("ts"), "group_key").limit(10).select("group_key", "ts")


@query("messages", f"SELECT message_id FROM messages WHERE document_id = 9 AND role IN ('user', 'assistant') AND (contains(lower(content), 'the') OR list_contains({_TOK}, 'the')) ORDER BY line_number LIMIT 4")
def h12_search_in_conversation(messages):
    return reports.search_in_conversation(messages, 9, "the", 3).select("message_id")


@query("docs", f"SELECT document_id, synced FROM docs WHERE contains(lower(title), 'the of') OR contains(lower(relative_path), 'the of') OR list_has_all({_TOK}, ['the', 'of']) ORDER BY synced DESC, document_id LIMIT 20 OFFSET 5")
def h13_search_documents(docs):
    return reports.search_documents(docs, "the of", 5, 20)


@query("docs", "SELECT path, max(score) AS score FROM (SELECT relative_path AS path, round((document_id % 97) / 100.0::double, 4) AS score FROM docs WHERE document_id % 5 = 0 UNION ALL SELECT relative_path, 0.5::double FROM docs WHERE document_id % 3 = 0 UNION ALL SELECT relative_path, 0.7::double FROM docs WHERE document_id % 11 = 0) GROUP BY path ORDER BY score DESC, path LIMIT 30")
def h15_hybrid_search(docs):
    rows = docs.select(F.col("relative_path").alias("path"), F.round((F.col("document_id") % 97) / 100.0, 4).alias("score"), "document_id")
    return reports.hybrid_search(rows.where("document_id % 5 = 0"), rows.where("document_id % 3 = 0"), rows.where("document_id % 11 = 0"), 30)


@query("docs", "SELECT document_id, CASE document_id % 3 WHEN 0 THEN concat('c:/my docs/', project) WHEN 1 THEN concat('C:\\x\\', project) ELSE concat('/home/', project) END AS path FROM docs")
def i10_clean_path(docs):
    kind = F.col("document_id") % 3
    path = F.when(kind == 0, F.concat(F.lit("file:///c%3A/my%20docs/"), "project", F.lit("/"))).when(kind == 1, F.concat(F.lit("\\\\?\\C:\\x\\"), "project")).otherwise(F.concat(F.lit("/home/"), "project", F.lit("//")))
    return docs.select("document_id", reports.clean_path(path).alias("path"))


@query("events nation", "SELECT event_id AS view_id, coalesce(n_name, '') AS country FROM events LEFT JOIN nation ON (10 * 16777216 + (user_id % 256) * 65536 + (event_id % 256) * 256) BETWEEN 10 * 16777216 + n_nationkey * 400000 AND 10 * 16777216 + n_nationkey * 400000 + 299999")
def i18_geo_tag(events, nation):
    views = events.select(F.col("event_id").alias("view_id"), F.concat_ws(".", F.lit("10"), F.col("user_id") % 256, F.col("event_id") % 256, F.lit("0")).alias("ip"))
    low = 10 * 16777216 + F.col("n_nationkey").cast("bigint") * 400000
    return reports.geo_tag(views, nation.select(low.alias("low"), (low + 299999).alias("high"), F.col("n_name").alias("country")))


@query("docs", "SELECT document_id, CASE tool_id WHEN 'codex' THEN 'Codex' WHEN 'claude_code' THEN 'Claude Code' WHEN 'cursor' THEN 'Cursor' ELSE 'Obsidian' END AS name FROM docs")
def i19_tool_display_name(docs):
    return docs.select("document_id", reports.display_name(F.col("tool_id")).alias("name"))


@query("messages", "SELECT message_id, CASE message_id % 3 WHEN 1 THEN 'system' ELSE 'user' END AS role, CASE message_id % 3 WHEN 1 THEN trim(concat('<environment_context> ', content)) ELSE trim(content) END AS text FROM messages")
def j6_split_codex_user(messages):
    start, kind = F.col("content"), F.col("message_id") % 3
    payload = F.when(kind == 0, F.concat(F.lit("# Context from my IDE setup:\n\n## My request for Codex:\n"), start)).when(kind == 1, F.concat(F.lit("<environment_context> "), start)).otherwise(start)
    role, text = reports.split_codex_user(payload)
    return messages.select("message_id", role.alias("role"), text.alias("text"))


@query(
    "messages",
    """, k AS (SELECT *, CASE WHEN role = 'user' AND message_id % 5 = 0 THEN 'prompt' WHEN line_number % 3 = 0 THEN 'answer' ELSE 'question' END AS kind, line_number % 2 AS question_id FROM messages)
    SELECT document_id, question_id, line_number FROM k q WHERE kind = 'question' AND NOT EXISTS (SELECT 1 FROM k a WHERE a.kind = 'answer' AND a.document_id = q.document_id AND a.question_id = q.question_id)
        AND NOT EXISTS (SELECT 1 FROM k p WHERE p.kind = 'prompt' AND p.document_id = q.document_id AND p.line_number >= q.line_number)""",
)
def j12_pending_interactions(messages):
    kind = F.when((F.col("role") == "user") & (F.col("message_id") % 5 == 0), "prompt").when(F.col("line_number") % 3 == 0, "answer").otherwise("question")
    return reports.pending_interactions(messages.withColumn("kind", kind).withColumn("question_id", F.col("line_number") % 2))


@query("messages", "SELECT document_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY message_id % 3 = 0 DESC, line_number DESC, message_id DESC) AS n FROM messages WHERE role = 'assistant') WHERE n = 1")
def j18_current_task_state(messages):
    return reports.current_task_state(messages.where("role = 'assistant'").withColumn("is_current", F.col("message_id") % 3 == 0))


@query("conv_docs", _GROUPS)
def k10_project_timeline(conv_docs):
    return reports.project_timeline(conv_docs)


@query(
    "messages",
    """, d AS (SELECT document_id, string_agg(substr(c, 1, 4000 - used), chr(10) ORDER BY line_number) AS t FROM (
        SELECT document_id, line_number, c, cast(coalesce(sum(length(c)) OVER (PARTITION BY document_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS int) AS used
        FROM (SELECT *, concat(role, ': ', substr(content, 1, 4000)) AS c FROM messages WHERE role IN ('user', 'assistant'))) WHERE used < 4000 GROUP BY document_id)
    SELECT document_id, sha256(t) AS hash FROM d WHERE length(t) >= 200 AND document_id % 2 = 1""",
)
def l1_extraction_inputs(messages):
    none = messages.select("document_id", F.lit("").alias("hash")).distinct()
    seen = reports.extraction_inputs(messages, none).where("document_id % 2 = 0")
    return reports.extraction_inputs(messages, seen)


@query("part", "SELECT p_partkey, p_brand AS name, 1 AS n FROM part")
def l2_parse_extraction(part):
    body = F.to_json(F.struct(F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("type"))).alias("entities")))
    parsed = part.select("p_partkey", reports.parse_extraction(F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).alias("r"))
    return parsed.select("p_partkey", F.col("r.entities")[0]["name"].alias("name"), F.size("r.entities").alias("n"))


@query("observations", "SELECT document_id, CASE WHEN document_id % 4 = 0 THEN 'new' ELSE content END AS content, count(*) AS n FROM observations GROUP BY ALL")
def l5_replace_observations(observations):
    stored = observations.select("document_id", "content")
    fresh = stored.withColumn("content", F.lit("new"))
    return reports.replace_by_document(stored, fresh, stored.where("document_id % 4 = 0")).groupBy("document_id", "content").agg(F.count("*").alias("n"))


@query(
    "docs messages",
    """, s AS (SELECT document_id, string_agg(substr(content, 1, 4000), chr(10) ORDER BY line_number) AS said FROM messages WHERE role IN ('user', 'assistant') GROUP BY 1)
    SELECT document_id, sha256(t) AS hash FROM (SELECT document_id, coalesce(CASE WHEN document_id % 2 = 0 THEN content END, said) AS t FROM docs LEFT JOIN s USING (document_id)) WHERE length(t) >= 100""",
)
def m1_embedding_text(docs, messages):
    half = docs.withColumn("content", F.when(F.col("document_id") % 2 == 0, F.col("content")))
    return reports.embedding_text(half, messages).select("document_id", F.sha2("text", 256).alias("hash"))


@query("docs", "SELECT document_id, CASE WHEN document_id % 10 = 0 OR category IN ('memory', 'plan', 'identity', 'learning') THEN 'quality' ELSE 'fast' END AS tier FROM docs")
def m5_assign_tier(docs):
    current = F.when(F.col("document_id") % 10 == 0, "quality").otherwise("fast")
    return docs.select("document_id", reports.assign_tier(F.col("category"), current).alias("tier"))


@query("vectors docs", "SELECT DISTINCT tier FROM vectors WHERE document_id IN (SELECT document_id FROM docs WHERE category = 'plan')")
def m9_searchable_tiers(chunks, docs):
    return chunks.join(docs.where("category = 'plan'").select("document_id"), "document_id", "left_semi").select("tier").distinct()


@query(
    "lineitem",
    """, i AS (SELECT l_orderkey AS source, l_linenumber AS item_id, CASE WHEN l_linenumber % 4 = 1 THEN 'full' ELSE 'delta' END AS mode, l_linenumber % 2 AS base_offset FROM lineitem),
    f AS (SELECT source, max(item_id) AS last_full FROM i WHERE mode = 'full' GROUP BY 1)
    SELECT source, mode, base_offset, max(item_id) AS item_id FROM i LEFT JOIN f USING (source) WHERE last_full IS NULL OR item_id >= last_full GROUP BY ALL""".replace(", i AS", "WITH i AS", 1),
)
def n6_coalesce_queue(lineitem):
    items = lineitem.select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("item_id"), F.when(F.col("l_linenumber") % 4 == 1, "full").otherwise("delta").alias("mode"), (F.col("l_linenumber") % 2).alias("base_offset"))
    return reports.coalesce_queue(items).select("source", "mode", "base_offset", "item_id")


@query("versions", "SELECT document_id, max_by(hash, (synced, hash)) AS hash, cast(max(synced) AS varchar) AS delivered, max(o_orderkey) AS activity FROM versions GROUP BY 1")
def n10_delivery_state(versions):
    rows = versions.select("document_id", "hash", F.col("synced").alias("delivered"), F.col("o_orderkey").alias("activity"))
    split = F.col("delivered") < F.lit("1995-01-01").cast("date")
    return reports.delivery_state(rows.where(split), rows.where(~split)).withColumn("delivered", F.col("delivered").cast("string"))


@query("docs", "SELECT document_id, tool_id, title, document_id % 3 = 0 OR document_id % 7 = 0 AS changed FROM docs")
def n14_dashboard_projection(docs):
    empty = docs.limit(0).select("document_id", F.lit("").alias("row_hash"))
    stored = reports.dashboard_projection(docs, empty).where("document_id % 3 > 0")
    stored = stored.withColumn("row_hash", F.when(F.col("document_id") % 7 == 0, "old").otherwise(F.col("row_hash")))
    return reports.dashboard_projection(docs, stored).select("document_id", "tool_id", "title", "changed")


@query(
    "docs messages",
    f""", s AS (SELECT document_id, string_agg(substr(content, 1, 2048), ' ' ORDER BY line_number) AS said FROM messages WHERE role IN ('user', 'assistant') GROUP BY 1)
    SELECT document_id, len({_TOK})::int AS tokens FROM (SELECT document_id, concat_ws(' ', title, said) AS content FROM docs LEFT JOIN s USING (document_id))""",
)
def n16_refresh_fts(docs, messages):
    return reports.refresh_fts(docs, messages)


# --- batch forms of the streaming operators ------------------------------------------


@query("signals", "SELECT strftime(ts, '%Y-%m-%d') AS day, status, count(*) AS n FROM signals GROUP BY ALL")
def o2_day_counts(signals):
    return states.day_counts(signals.withColumn("ts", F.col("ts").cast("timestamp")))


@query(
    "signals",
    """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM signals WINDOW w AS (PARTITION BY document_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY ts, event_id) AS island FROM g)
    SELECT document_id, cast(floor(epoch(min(ts))) AS bigint) AS start_ts, count(*) AS n, max_by(event_id, (ts, event_id)) AS event_id FROM i GROUP BY document_id, island""",
)
def o3_quiet_window(signals):
    return states.quiet_windows(signals.withColumn("ts", F.col("ts").cast("timestamp")))


@query(
    "signals",
    """, r AS (SELECT activity_id, min(ts) AS start FROM signals WHERE status = 'running' GROUP BY activity_id),
    b AS (SELECT s.*, start FROM signals s JOIN r USING (activity_id) WHERE ts >= start),
    f AS (SELECT activity_id, any_value(start) AS start, min(CASE WHEN status <> 'running' THEN ts END) AS ended, max(CASE WHEN status = 'running' THEN ts END) AS last FROM b GROUP BY activity_id)
    SELECT f.activity_id, coalesce((SELECT min_by(status, event_id) FROM b WHERE b.activity_id = f.activity_id AND b.ts = f.ended AND status <> 'running'), 'running') AS status,
           cast(floor(epoch(start)) AS bigint) AS start_ts, cast(floor(epoch(coalesce(ended, last))) AS bigint) AS last_ts FROM f""",
)
def o4_activity_state(signals):
    return states.activity_state_batch(signals.withColumn("ts", F.col("ts").cast("timestamp")))


# --- upkeep --------------------------------------------------------------------------


@query("vectors", "SELECT vec_id FROM vectors WHERE vec_id % 3 = 0 OR (vec_id % 3 = 1 AND tier = 0)")
def b18_compatible_vectors(chunks):
    signature = F.when(F.col("vec_id") % 3 == 0, "p1").when(F.col("vec_id") % 3 == 2, "p2")
    model = F.when(F.col("tier") == 0, "m1").otherwise("m2")
    return upkeep.compatible_vectors(chunks.withColumns({"signature": signature, "model": model}), "p1", "m1").select("vec_id")


@query(
    "versions",
    f"""SELECT o_orderkey FROM versions WHERE o_orderkey % 5 > 0 AND (o_orderkey % 3 = 0 OR {NOW} + (o_orderkey % 7 - 3) * 86400 > {NOW})
    AND (o_orderkey % 4 = 0 OR document_id % 6 = 2 OR document_id % 9 = 2)""",
)
def b21_active_shares(versions):
    key, document = F.col("o_orderkey"), F.col("document_id")
    links = versions.select(
        "o_orderkey", (key % 5 == 0).alias("revoked"), F.when(key % 3 != 0, NOW + (key % 7 - 3) * 86400).alias("expires"),
        F.when(key % 4 == 0, "public").otherwise("user").alias("audience"), (document % 6).alias("directed_to"), (document % 9).alias("owner"),
    )
    return upkeep.active_shares(links, F.lit(2), NOW).select("o_orderkey")


@query(
    "messages",
    """, q AS (SELECT message_id + 500 AS queued_id, document_id, content, ts - 60 - (message_id % 3) * 50000 AS qts,
        row_number() OVER (PARTITION BY document_id, content ORDER BY ts - 60 - (message_id % 3) * 50000, message_id + 500) AS n FROM messages WHERE role = 'user' AND message_id % 2 = 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY document_id, content ORDER BY ts, message_id) AS n FROM messages WHERE role = 'user')
    SELECT queued_id, message_id FROM c JOIN q USING (document_id, content, n) WHERE ts - qts BETWEEN 0 AND 86400""",
)
def c10_pair_queued_prompts(messages):
    said = messages.where("role = 'user'").select("message_id", "document_id", "content", "ts", F.lit(False).alias("queued"))
    early = F.col("ts") - 60 - (F.col("message_id") % 3) * 50000
    queued = said.where("message_id % 2 = 0").select((F.col("message_id") + 500).alias("message_id"), "document_id", "content", early.alias("ts"), F.lit(True).alias("queued"))
    return upkeep.pair_queued_prompts(said.unionByName(queued))


@query("docs", ", t AS (SELECT category, count(*) AS n_outcome FROM docs GROUP BY ALL) SELECT machine_id, tool_id, relative_path AS path, category AS outcome, count(*) AS n, n_outcome FROM docs JOIN t USING (category) GROUP BY ALL")
def d15_artifact_inventory(docs):
    refs = docs.select("machine_id", "tool_id", F.col("relative_path").alias("path"), F.col("category").alias("outcome"))
    return upkeep.artifact_inventory(refs)


@query(
    "docs",
    """SELECT document_id, CASE document_id % 3 WHEN 0 THEN concat('/home/u/', project) WHEN 1 THEN '/home/u/other' ELSE concat('/home/u/', category) END AS root FROM docs""",
)
def d19_workspace_vote(docs):
    own, other, kind = F.concat(F.lit("at /home/u/"), "project", F.lit("/a.md ")), F.lit("in /home/u/other/b.py "), F.concat(F.lit("see /home/u/"), "category", F.lit("/c "))
    hidden = F.repeat(F.lit("and /home/u/.antigravity/d "), 4)
    paths = F.when(F.col("document_id") % 3 == 0, F.concat(own, other)).when(F.col("document_id") % 3 == 1, F.concat(own, other, other)).otherwise(F.concat(own, kind, hidden, kind))
    return upkeep.workspace_vote(docs.select("document_id", F.concat(paths, F.coalesce("content", F.lit(""))).alias("content")), r"(/home/u/[\w.-]+)/", r"/\.antigravity")


@query(
    "observations",
    """, r AS (SELECT entity, concat('seen ', count(*), ' times') AS content, date '1996-01-01' AS observed FROM observations WHERE observed < date '1996-01-01' GROUP BY entity HAVING count(*) >= 5)
    SELECT entity, content, strftime(observed, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT entity, content, observed FROM observations WHERE observed >= date '1996-01-01' OR entity NOT IN (SELECT entity FROM r)
    UNION ALL SELECT * FROM r) GROUP BY ALL""",
)
def l8_apply_compaction(observations):
    before = F.lit("1996-01-01").cast("date")
    many = observations.where(F.col("observed") < before).groupBy("entity").agg(F.count("*").alias("n")).where("n >= 5")
    replies = many.select("entity", F.format_string("seen %d times", "n").alias("content"), before.alias("observed"))
    left = upkeep.apply_compaction(observations, replies, before)
    return left.groupBy("entity", "content", F.date_format("observed", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(
    "entities docs",
    """, k AS (SELECT DISTINCT name, type FROM entities), s AS (SELECT DISTINCT CASE WHEN document_id % 2 = 0 THEN concat('Brand#', document_id % 60) ELSE project END AS name FROM docs)
    SELECT name, type FROM k UNION ALL SELECT name, 'Note' FROM s WHERE name NOT IN (SELECT name FROM k)""",
)
def l15_store_observations(entities, docs):
    even = F.col("document_id") % 2 == 0
    rows = docs.select(F.when(even, F.concat(F.lit("Brand#"), F.col("document_id") % 60)).otherwise("  ").alias("entity"), F.concat(F.lit("  "), "project").alias("content"))
    return upkeep.store_observations(entities, rows)


@query(
    "docs vectors",
    """SELECT 'docs' AS name, count(*) AS n FROM docs WHERE machine_id <> 3 UNION ALL
    SELECT 'vectors', count(*) FROM vectors WHERE document_id NOT IN (SELECT document_id FROM docs WHERE machine_id = 3)""",
)
def l16_reset_memory(docs, chunks):
    left = upkeep.reset_memory({"docs": docs, "vectors": chunks}, docs.where("machine_id = 3"), "document_id")
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in left.items()]
    return counts[0].union(counts[1])


@query(
    "conv_docs messages",
    """SELECT m.document_id - CASE WHEN m.document_id % 8 IN (1, 7) AND c.document_id IS NOT NULL THEN 1 ELSE 0 END AS document_id, count(*) AS n
    FROM messages m LEFT JOIN conv_docs c USING (document_id) GROUP BY ALL""",
)
def n17_consolidate_sessions(conv_docs, messages):
    aliases = conv_docs.where("k in (1, 7)").select(F.col("document_id").alias("alias"), (F.col("document_id") - 1).alias("target"))
    _, tables = upkeep.consolidate_sessions(conv_docs, aliases, {"messages": messages})
    return tables["messages"].groupBy("document_id").agg(F.count("*").alias("n"))


@query(
    "docs messages",
    """SELECT category, count(*) AS n FROM (SELECT CASE WHEN relative_path LIKE '%.meta.json' THEN 'state' ELSE category END AS category FROM docs) GROUP BY ALL
    UNION ALL SELECT 'messages', count(*) FROM messages WHERE document_id NOT IN (SELECT document_id FROM docs WHERE relative_path LIKE '%.meta.json')""",
)
def n18_reclassify_sidecars(docs, messages):
    changed, rest = upkeep.reclassify_sidecars(docs, messages)
    return changed.groupBy("category").agg(F.count("*").alias("n")).union(rest.agg(F.count("*").alias("n")).select(F.lit("messages"), "n"))


@query(
    "docs messages machines",
    """, g AS (SELECT document_id FROM docs WHERE machine_id IN (SELECT machine_id FROM machines WHERE user_id = 1))
    SELECT 'documents' AS name, count(*) FILTER (document_id IN (SELECT document_id FROM g)) AS n_removed, count(*) FILTER (document_id NOT IN (SELECT document_id FROM g)) AS n_kept FROM docs
    UNION ALL SELECT 'messages', count(*) FILTER (document_id IN (SELECT document_id FROM g)), count(*) FILTER (document_id NOT IN (SELECT document_id FROM g)) FROM messages""",
)
def n19_purge_scope(docs, messages, machines):
    return upkeep.purge_scope(docs, messages, machines.where("user_id = 1"))


@query(
    "docs",
    """SELECT document_id, r AS resource FROM (SELECT document_id, unnest(list_concat(['messages', 'metadata', 'dashboard', 'project'], CASE WHEN document_id % 5 = 0 OR document_id % 3 = 0 THEN ['prompts'] ELSE [] END,
        CASE WHEN document_id % 5 = 0 OR document_id % 2 = 0 OR document_id % 7 = 0 THEN ['search'] ELSE [] END, CASE WHEN document_id % 4 = 0 THEN ['pending'] ELSE [] END)) AS r FROM docs)""",
)
def o12_change_sets(docs):
    key = F.col("document_id")

    def state(new):
        return docs.select(
            "document_id", (key % 5 == 0).alias("full"), F.when(key % 3 == 0, new).otherwise(0).alias("n_user"), F.when(key % 2 == 0, new).otherwise(0).alias("n_chars"),
            F.when(key % 7 == 0, F.concat("title", F.lit(str(new)))).otherwise(F.col("title")).alias("title"), F.when(key % 4 == 0, new).alias("pending"), "project",
        )

    return upkeep.change_sets(state(1), state(2))


# --- chunks, neighbours, pages and merges ---------------------------------------------


_LAST = "length(regexp_extract(w, '(?s)^.*{}'))"


@query(
    "docs",
    f""", c AS (WITH RECURSIVE c AS (
        SELECT document_id, content, 0::bigint AS a, 0::bigint AS b, 0 AS n FROM docs WHERE length(content) > 2000
        UNION ALL SELECT document_id, content, a, CASE WHEN a + 2000 >= length(content) THEN a + 2000 WHEN p > 0 THEN a + 1000 + p WHEN l > 0 THEN a + 1000 + l WHEN s > 0 THEN a + 1000 + s ELSE a + 2000 END, n + 1
        FROM (SELECT *, {_LAST.format(chr(10) * 2)} AS p, {_LAST.format(chr(10))} AS l, {_LAST.format("[.] ")} AS s FROM (
            SELECT document_id, content, start AS a, substr(content, start + 1001, 1000) AS w, n FROM (SELECT document_id, content, CASE WHEN n = 0 THEN 0 ELSE b - 200 END AS start, n FROM c) WHERE start < length(content))))
        SELECT document_id, n, regexp_replace(substr(content, a + 1, b - a), '^\\s+|\\s+$', '', 'g') AS chunk FROM c WHERE n > 0)
    SELECT document_id, cast(row_number() OVER (PARTITION BY document_id ORDER BY n) - 1 AS int) AS chunk_index, length(chunk)::int AS n_chars, md5(chunk) AS digest FROM c WHERE length(chunk) > 50
    UNION ALL SELECT document_id, 0, length(content)::int, md5(content) FROM docs WHERE length(content) BETWEEN 1 AND 2000""",
)
def m2_chunk_text(docs):
    return search.chunk_text(docs).select("document_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("vectors", f", {_SCORES} SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM scores WHERE vec_id <> query_id) WHERE rank <= 10")
def m11_knn_join(chunks):
    return vectors.nearest(_stated(chunks), chunks, 10).select("query_id", "vec_id", "rank")


_HALF = _SCORES.replace("scores AS", "halves AS").replace("FROM vectors c JOIN vectors q", "FROM half c JOIN half q")


@query(
    "vectors",
    f""", half AS (SELECT * REPLACE (embedding[1:32] AS embedding) FROM vectors), {_SCORES}, {_HALF},
    n AS (SELECT query_id, vec_id, 0 AS space, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM scores WHERE vec_id <> query_id
        UNION ALL SELECT query_id, vec_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) FROM halves WHERE vec_id <> query_id)
    SELECT query_id, round(sum(CASE WHEN s = 2 THEN 1 ELSE 0 END) / count(*), 6) AS overlap FROM (SELECT query_id, vec_id, count(*) AS s FROM n WHERE rank <= 10 GROUP BY ALL) GROUP BY query_id""",
)
def m10_compare_embedding_spaces(chunks):
    half = chunks.withColumn("embedding", F.slice("embedding", 1, 32))
    return vectors.compare_spaces((_stated(chunks), _stated(half)), (chunks, half), 10).select("query_id", F.round("overlap", 6).alias("overlap"))


@query(
    "messages conv_docs",
    f""", h AS (SELECT root, message_id, ts, CASE WHEN contains(lower(content), 'the and') THEN 4.0::double ELSE 3.0::double END AS score FROM messages JOIN conv_docs USING (document_id)
        WHERE role IN ('user', 'assistant') AND (contains(lower(content), 'the and') OR list_has_all({_TOK}, ['the', 'and'])) AND root % 3 <> 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, ts DESC, message_id) AS place FROM h)
    SELECT root, place, message_id, score FROM p WHERE place <= 3 AND root IN (SELECT root FROM p WHERE place = 1 ORDER BY score DESC, ts DESC, root LIMIT 20)""",
)
def h11_search_messages(messages, conv_docs):
    seen = conv_docs.where("root % 3 = 0").select("root").distinct()
    return search.search_messages(messages, conv_docs.select("document_id", "root"), "the and", 20, seen=seen).drop("match_type")


@query(
    "deliveries",
    """, e AS (SELECT * REPLACE (CASE WHEN source % 3 = 0 AND byte_offset = 300 THEN 'full' ELSE mode END AS mode) FROM deliveries
        QUALIFY row_number() OVER (PARTITION BY source, hash, byte_offset ORDER BY delivered, size, base_offset) = 1),
    d AS (SELECT *, max(CASE WHEN mode = 'full' THEN byte_offset END) OVER (PARTITION BY source) AS head, lag(byte_offset) OVER (PARTITION BY source ORDER BY byte_offset) AS before FROM e),
    g AS (SELECT *, byte_offset < coalesce(head, 0) AS old, mode = 'delta' AND base_offset <> coalesce(before, 0) AS gap FROM d),
    r AS (SELECT *, max(gap AND NOT old) OVER (PARTITION BY source ORDER BY byte_offset ROWS UNBOUNDED PRECEDING) AS broken FROM g)
    SELECT source, max(head) AS head, count(*) FILTER (NOT old AND NOT broken) AS jobs, max(byte_offset) FILTER (NOT old AND NOT broken) AS "end", count(*) FILTER (old) AS superseded, count(*) FILTER (NOT old AND broken) AS waiting
    FROM r GROUP BY source""",
)
def n4_select_heads(deliveries):
    mode = F.when((F.col("source") % 3 == 0) & (F.col("byte_offset") == 300), "full").otherwise(F.col("mode"))
    return ingest.select_heads(ingest.dedup_deliveries(deliveries, ("source",)).withColumn("mode", mode))


@query(
    "docs",
    """, o AS (SELECT document_id, title, project, category, document_id % 5 = 0 AS manual FROM docs WHERE document_id % 3 <> 0),
    n AS (SELECT document_id, CASE WHEN document_id % 4 = 0 THEN '' ELSE concat(title, '!') END AS title, CASE WHEN document_id % 8 = 0 THEN NULL ELSE concat(project, 'x') END AS project, document_id % 10 = 2 AS same FROM docs WHERE document_id % 2 = 0)
    SELECT document_id, CASE WHEN coalesce(o.manual, false) THEN o.title ELSE coalesce(nullif(n.title, ''), o.title) END AS title, coalesce(n.project, o.project) AS project,
        CASE WHEN n.document_id IS NULL THEN 'keep' WHEN o.document_id IS NULL THEN 'insert' WHEN n.same THEN 'touch' ELSE 'update' END AS action,
        CASE WHEN n.document_id IS NULL THEN 'old' ELSE 'new' END AS origin, CASE WHEN o.manual THEN 'yes' END AS manual
    FROM o FULL JOIN n USING (document_id)""",
)
def n7_merge_documents(docs):
    key = F.col("document_id")
    origin, manual = F.lit("origin"), F.lit("manual_title")
    old = docs.where(key % 3 != 0).select(
        "document_id", "title", "project", F.lit("a").alias("hash"),
        F.when(key % 5 == 0, F.create_map(origin, F.lit("old"), manual, F.lit("yes"))).otherwise(F.create_map(origin, F.lit("old"))).alias("metadata"),
    )
    new = docs.where(key % 2 == 0).select(
        "document_id", F.when(key % 4 == 0, "").otherwise(F.concat("title", F.lit("!"))).alias("title"),
        F.when(key % 8 != 0, F.concat("project", F.lit("x"))).alias("project"), F.when(key % 10 == 2, "a").otherwise("b").alias("hash"),
        F.create_map(origin, F.lit("new")).alias("metadata"),
    )
    merged = ingest.merge_documents(old, new)
    value = lambda name: F.try_element_at("metadata", F.lit(name))
    return merged.select("document_id", "title", "project", "action", value("origin").alias("origin"), value("manual_title").alias("manual"))


_RECORDS = """r AS (SELECT document_id, line_number * 4 AS record, 'response_item' AS kind, content, ts FROM messages WHERE role = 'user' AND message_id % 5 <> 0
    UNION ALL SELECT document_id, line_number * 4 + 1 + document_id % 3, 'user_message', CASE WHEN document_id % 7 = 0 THEN concat('x', content) ELSE substr(content, 1, 80) END, ts + document_id % 2 + line_number % 2 FROM messages WHERE role = 'user')"""


@query(
    "messages",
    f""", {_RECORDS}, w AS (SELECT *, lead(kind) OVER o AS k, lead(record) OVER o AS n, lead(ts) OVER o AS t, lead(content) OVER o AS c FROM r WINDOW o AS (PARTITION BY document_id ORDER BY record)),
    m AS (SELECT *, coalesce(kind = 'response_item' AND k = 'user_message' AND n - record <= 2 AND abs(t - ts) <= 1 AND (starts_with(content, c) OR starts_with(c, content)), false) AS gone FROM w)
    SELECT document_id, record, kind, coalesce(lag(gone) OVER (PARTITION BY document_id ORDER BY record), false) AS paired FROM m QUALIFY NOT gone""",
)
def j9_collapse_user_mirrors(messages):
    users = messages.where("role = 'user'")
    items = users.where("message_id % 5 <> 0").selectExpr("document_id", "line_number * 4 AS record", "'response_item' AS kind", "content", "ts")
    events = users.selectExpr(
        "document_id", "line_number * 4 + 1 + document_id % 3 AS record", "'user_message' AS kind",
        "CASE WHEN document_id % 7 = 0 THEN concat('x', content) ELSE substr(content, 1, 80) END AS content", "ts + document_id % 2 + line_number % 2 AS ts",
    )
    return ingest.collapse_user_mirrors(items.unionByName(events)).select("document_id", "record", "kind", "paired")


@query(
    "messages conv_docs",
    f""", t AS ({_COMPACT}), p AS (SELECT document_id, title, row_number() OVER (PARTITION BY document_id ORDER BY line_number) AS n FROM messages JOIN t USING (message_id) WHERE role = 'user'),
    f AS (SELECT document_id, min_by(title, n) AS found FROM p WHERE n <= 25 AND title IS NOT NULL GROUP BY document_id)
    SELECT document_id, CASE document_id % 4 WHEN 0 THEN 'Kept title' WHEN 1 THEN found WHEN 2 THEN coalesce(found, ' ') ELSE coalesce(found, concat('rollout-', document_id)) END AS title FROM conv_docs LEFT JOIN f USING (document_id)""",
)
def e13_first_prompt_title(messages, conv_docs):
    kind = F.col("document_id") % 4
    title = F.when(kind == 0, "Kept title").when(kind == 2, " ").when(kind == 3, F.concat(F.lit("rollout-"), "document_id"))
    return ingest.first_prompt_title(conv_docs.select("document_id", title.alias("title")), messages)


@query(
    "messages",
    """SELECT message_id, CASE WHEN c <> '' AND length(c) <= 500 AND NOT regexp_matches(c, '^<[a-z_-]+') THEN c END AS title
    FROM (SELECT message_id, trim(regexp_replace(CASE WHEN message_id % 6 = 0 THEN concat('<note>', content) ELSE content END, '\\s+', ' ', 'g')) AS c FROM messages)""",
)
def i5_clean_title(messages):
    """Titles with terminal colours and bells, some inside a wrapper's tag."""
    raw = F.concat(F.lit("\x1b[1m"), F.when(F.col("message_id") % 6 == 0, "<note>").otherwise(""), F.lit("\x1b[0m"), "content", F.lit("\x07"))
    return messages.select("message_id", T.clean_title(raw).alias("title"))


# --- agents --------------------------------------------------------------------------


@query(
    "launches children",
    """, calls AS (SELECT root, tool_use_id, max(document_id) AS c FROM children WHERE tool_use_id IS NOT NULL GROUP BY ALL),
    names AS (SELECT root, document_id, unnest([agent_id, concat('agent-', agent_id), thread_id, concat('agent-', thread_id)]) AS alias FROM children),
    named AS (SELECT event_id, max(document_id) AS n FROM (SELECT event_id, root, unnest([thread_id, CASE WHEN starts_with(thread_id, 'agent-') THEN substr(thread_id, 7) ELSE concat('agent-', thread_id) END]) AS alias FROM launches)
        JOIN names USING (root, alias) GROUP BY 1)
    SELECT event_id, coalesce(c, n) AS document_id, 'm' || (coalesce(c, n) % 5) AS runtime FROM launches LEFT JOIN calls USING (root, tool_use_id) LEFT JOIN named USING (event_id)""",
)
def c13_overlay_child_runtime(launches, children):
    return agents.overlay_child_runtime(launches, children)


_FILES = """document_id, CASE WHEN document_id % 20 = 1 THEN 99 ELSE 7 END AS machine_id, project, document_id - document_id % 2 AS pair,
    concat('x/subagents/agent-', document_id - document_id % 2, CASE WHEN document_id % 2 = 0 THEN '.jsonl' ELSE '.meta.json' END) AS relative_path"""


@query(
    "docs",
    f""", f AS (SELECT {_FILES} FROM docs)
    SELECT a.document_id, b.document_id AS sidecar_id, cast(a.pair AS varchar) AS agent_id, b.project AS description, concat('call', a.pair) AS tool_use_id, 'worker' AS agent_type
    FROM f a JOIN f b ON a.pair = b.pair AND a.machine_id = b.machine_id WHERE a.document_id % 2 = 0 AND b.document_id % 2 = 1 AND b.pair % 14 > 0 AND b.pair % 18 > 0""",
)
def c14_attach_sidecars(docs):
    body = """CASE WHEN document_id % 2 = 0 OR pair % 18 = 0 THEN 'plain' ELSE concat('{"description": " ', project, '", "toolUseId": "call', pair, '", "agentType": "worker", "agentId": "',
        CASE WHEN pair % 14 = 0 THEN 'other' ELSE cast(pair AS string) END, '"}') END AS content"""
    return agents.attach_sidecars(docs.selectExpr(*_columns(_FILES)).selectExpr("*", body))


def _columns(select: str) -> list[str]:
    """The items of a select list without commas inside brackets."""
    return [c.strip() for c in re.split(r",(?![^()]*\))", select.replace("\n", " "))]


_INBOX = """event_id AS signal_id, CASE WHEN event_id % 3 = 0 THEN concat('t', user_id) END AS session, CASE WHEN event_id % 2 = 0 THEN concat('p/t', user_id, '.jsonl') END AS path,
    concat('t', user_id % 40) AS title_thread, event_id % 1000 AS received, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS expires"""


@query(
    "events conv_docs",
    f""", s AS (SELECT {_INBOX} FROM events), r AS (
    SELECT signal_id, received, document_id, 0 AS rank FROM s JOIN conv_docs ON session = thread WHERE expires > 1 UNION ALL
    SELECT signal_id, received, document_id, 1 FROM s JOIN conv_docs ON path = relative_path WHERE expires > 1 UNION ALL
    SELECT signal_id, received, document_id, 2 FROM s JOIN conv_docs ON title_thread = thread WHERE expires > 1),
    b AS (SELECT * FROM r QUALIFY rank = min(rank) OVER (PARTITION BY signal_id))
    SELECT document_id, signal_id, row_number() OVER (PARTITION BY document_id ORDER BY received, signal_id) AS place FROM b QUALIFY place <= 256""",
)
def c15_apply_inbox(events, conv_docs):
    routes = conv_docs.selectExpr("document_id", "thread AS session", "relative_path AS path", "thread")
    return agents.apply_inbox(events.selectExpr(*_columns(_INBOX)), routes, 1)


@query(
    "messages",
    """, r AS (SELECT document_id AS message_id, message_id AS ref_id, line_number * 700 AS pos, count(*) OVER (PARTITION BY document_id) = 1 AS alone FROM messages WHERE role = 'user' AND (document_id % 2 = 0 OR line_number = 3)),
    b AS (SELECT document_id AS message_id, message_id AS block_id, line_number * 700 + message_id % 3 * 900 AS spot FROM messages WHERE role = 'assistant'),
    p AS (SELECT ref_id, min(CASE WHEN spot BETWEEN pos AND pos + 2000 THEN (spot, block_id) END) AS n, min(CASE WHEN alone THEN (spot, block_id) END) AS f FROM r JOIN b USING (message_id) GROUP BY 1)
    SELECT ref_id, coalesce(n[2], f[2]) AS block_id FROM p WHERE n IS NOT NULL OR f IS NOT NULL""",
)
def c17_associate_code_blocks(messages):
    refs = messages.where("role = 'user' AND (document_id % 2 = 0 OR line_number = 3)")
    refs = refs.selectExpr("document_id AS message_id", "message_id AS ref_id", "line_number * 700 AS position")
    blocks = messages.where("role = 'assistant'").selectExpr("document_id AS message_id", "message_id AS block_id", "line_number * 700 + message_id % 3 * 900 AS position")
    return agents.associate_code_blocks(refs, blocks)


@query("messages", f"""SELECT message_id, round(3.0 + 0.1 * len(list_filter({_TOK}, lambda x: x = 'the')) + CASE WHEN contains(lower(content), 'the') THEN 1 ELSE 0 END, 9) AS score FROM messages
    WHERE role IN ('user', 'assistant') AND (contains(lower(content), 'the') OR list_contains({_TOK}, 'the'))""")
def h5_cover_density_rank(messages):
    return search.rank_messages(messages, "the").select("message_id", F.round("score", 9).alias("score"))


@query("messages")
def h8_word_similarity(messages):
    return search.rank_messages(messages, "other word", fuzzy=0.6).select("message_id", "score", "match_type")


@query("docs", """SELECT document_id, concat('{"Token":"[REDACTED]","path":"', relative_path, '","list":[{"apiKey":"[REDACTED]","n":', document_id, '}]}') AS content, 2 AS count FROM docs""")
def i3_redact_json(docs):
    record = """concat('{"Token": {"secret": "', project, '"}, "path": "', relative_path, '", "list": [{"apiKey": "', document_id, '", "n": ', document_id, '}]}')"""
    return docs.select("document_id", T.redact_json(F.expr(record)).alias("r")).select("document_id", "r.content", "r.count")


_TRANSPORTS = """SELECT document_id, line_number * 6 AS record, 'agent_message' AS kind, content, ts FROM messages WHERE role = 'assistant' AND message_id % 4 > 0 UNION ALL
    SELECT document_id, line_number * 6 + 1 + document_id % 5, 'response_item', CASE WHEN document_id % 3 = 0 THEN concat(content, ' [file]') ELSE content END, ts + message_id % 15 FROM messages WHERE role = 'assistant' UNION ALL
    SELECT document_id, line_number * 6 + 5, 'task_complete', content, ts + message_id % 15 + 1 FROM messages WHERE role = 'assistant' AND message_id % 3 = 0 AND document_id % 5 < 4"""


@query(
    "messages",
    f""", t AS ({_TRANSPORTS}), w AS (SELECT *, trim(content) AS c, trim(lag(content) OVER o) AS p, abs(ts - lag(ts) OVER o) AS apart, kind <> lag(kind) OVER o AND record - lag(record) OVER o <= 4 AS near FROM t WINDOW o AS (PARTITION BY document_id ORDER BY record)),
    m AS (SELECT *, sum(CASE WHEN coalesce(near AND c <> '' AND p <> '' AND ((c = p AND apart <= 12) OR ((starts_with(c, p) OR starts_with(p, c)) AND apart <= 1)), false) THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY record) AS chain FROM w)
    SELECT document_id, record, kind, count(*) OVER (PARTITION BY document_id, chain) > 1 AS paired FROM m
    QUALIFY row_number() OVER (PARTITION BY document_id, chain ORDER BY CASE kind WHEN 'agent_message' THEN 3 WHEN 'response_item' THEN 2 ELSE 1 END DESC, record) = 1""",
)
def j10_collapse_assistant_mirrors(messages):
    rows = messages.sparkSession.sql(_TRANSPORTS.replace("FROM messages", "FROM {messages}"), messages=messages)
    return ingest.collapse_assistant_mirrors(rows).select("document_id", "record", "kind", "paired")


_CARDS = """document_id, line_number, content, CASE WHEN role = 'user' AND message_id % 5 = 0 THEN 'prompt' WHEN line_number % 3 = 0 THEN 'answer' ELSE 'question' END AS kind,
    CASE WHEN message_id % 4 > 0 THEN concat('q', line_number % 2) END AS call_id"""


@query(
    "messages",
    f""", k AS (SELECT {_CARDS} FROM messages), a AS (
    SELECT q.document_id, q.line_number, min(x.line_number) AS answer_line FROM k q LEFT JOIN k x ON x.document_id = q.document_id AND x.line_number > q.line_number
        AND CASE WHEN q.call_id IS NULL THEN x.kind = 'prompt' ELSE x.kind = 'answer' AND x.call_id = q.call_id END WHERE q.kind = 'question' GROUP BY ALL)
    SELECT document_id, a.line_number, answer_line, content AS answer FROM a LEFT JOIN messages m USING (document_id) WHERE m.line_number = answer_line
    UNION ALL SELECT document_id, line_number, NULL, NULL FROM a WHERE answer_line IS NULL""",
)
def j11_link_answers(messages):
    return agents.link_answers(messages.selectExpr(*_columns(_CARDS)))


@query(
    "launches",
    """, w AS (SELECT *, CASE WHEN identity = lag(identity) OVER o AND kind = lag(kind) OVER o THEN 0 ELSE 1 END AS fresh FROM launches WINDOW o AS (PARTITION BY document_id ORDER BY line_number)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY line_number) AS run FROM w)
    SELECT document_id, min(line_number) AS line_number, any_value(identity) AS identity, any_value(kind) AS kind, coalesce(max_by(label, line_number) FILTER (label <> 'Subagent'), 'Subagent') AS label,
        min(started_at) AS started_at, max_by(model, line_number) FILTER (model IS NOT NULL) AS model, count(*) AS merged FROM r GROUP BY document_id, run""",
)
def j14_lifecycle_events(launches):
    return agents.merge_lifecycle_events(launches)


@query(
    "launches children",
    """, s AS (SELECT document_id, max_by(status, (status <> 'running', line_number)) AS seen FROM launches GROUP BY 1)
    SELECT document_id, CASE WHEN seen IS NULL OR (status = 'completed' AND seen = 'running') THEN status ELSE seen END AS status FROM s FULL JOIN children USING (document_id)""",
)
def j15_child_lifecycle(launches, children):
    return agents.child_lifecycle(launches, children)


@query(
    "events",
    """SELECT event_id, concat_ws(',', concat('t', event_id % 3), CASE WHEN event_id % 2 <> event_id % 3 THEN concat('t', event_id % 2) END, CASE WHEN event_id % 4 > 0 THEN 'task-3' END) AS ids,
    concat_ws(',', 'pending', CASE WHEN event_id % 2 <> event_id % 3 THEN 'completed' END, CASE WHEN event_id % 4 > 0 THEN CASE WHEN event_type = 'error' THEN 'blocked' ELSE 'pending' END END) AS statuses FROM events""",
)
def j17_clean_task_state(events):
    tasks = """array(named_struct('id', concat('t', event_id % 3), 'content', event_type, 'status', 'To-Do?'), named_struct('id', concat(' t', event_id % 2), 'content', 'x', 'status', 'Done'),
        named_struct('id', '', 'content', CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END, 'status', CASE WHEN event_type = 'error' THEN 'BLOCKED' END))"""
    clean = events.select("event_id", agents.clean_task_state(F.expr(tasks)).alias("t"))
    return clean.select("event_id", F.array_join("t.id", ",").alias("ids"), F.array_join("t.status", ",").alias("statuses"))


@query(
    "conv_docs",
    """SELECT document_id, CASE WHEN tool_id = 'claude_code' AND k >= 2 AND document_id % 3 > 0 THEN concat('do ', thread) ELSE thread END AS title,
    CASE WHEN tool_id <> 'codex' AND k >= 2 THEN 'parent_agent' END AS origin FROM conv_docs""",
)
def k3_display_title(conv_docs):
    description = F.when(F.col("document_id") % 3 > 0, F.concat(F.lit(" do "), "thread")).otherwise(" ")
    title = agents.display_title(hierarchy.is_subagent(), F.col("tool_id"), description, F.col("thread"))
    return conv_docs.select("document_id", title.alias("title"), agents.role_origin(hierarchy.is_subagent(), F.col("tool_id")).alias("origin"))


@query(
    "conv_docs",
    """SELECT root AS canonical_id, document_id, CASE WHEN tool_id = 'claude_code' AND document_id % 3 = 0 THEN concat('do ', thread) WHEN document_id % 5 = 0 THEN 'deep search' WHEN document_id % 7 = 0 THEN 'nick'
        WHEN document_id % 2 = 0 THEN concat('title ', thread) ELSE concat('Subagent ', substr(thread, 1, 8)) END AS title, CASE WHEN document_id % 4 = 0 THEN 'completed' ELSE 'unknown' END AS status
    FROM conv_docs WHERE document_id <> root""",
)
def k5_subagent_summaries(conv_docs):
    folded = conv_docs.selectExpr("document_id", "root AS canonical_id")
    docs = conv_docs.selectExpr(
        "document_id", "tool_id", "thread", "CASE WHEN document_id % 2 = 0 THEN concat('title ', thread) END AS title", "CASE WHEN document_id % 3 = 0 THEN concat('do ', thread) END AS description",
        "CASE WHEN document_id % 5 = 0 THEN '/root/deep_search/' END AS agent_path", "CASE WHEN document_id % 7 = 0 THEN 'nick' END AS nickname", "CASE WHEN document_id % 4 = 0 THEN 'completed' END AS status",
    )
    return agents.subagent_summaries(folded, docs)


@query(
    "children launches",
    """, e AS (SELECT root, tool_use_id, max_by(status, (status <> 'running', document_id * 1000 + line_number)) AS s, max_by(label, document_id * 1000 + line_number) FILTER (label <> 'Subagent') AS l
        FROM launches WHERE tool_use_id IS NOT NULL GROUP BY ALL), c AS (SELECT * FROM children WHERE tool_use_id IS NOT NULL)
    SELECT root, tool_use_id, document_id, coalesce(l, title, 'Subagent') AS title, coalesce(CASE WHEN s IS NULL OR (status = 'completed' AND s = 'running') THEN status ELSE s END, 'unknown') AS status,
        document_id IS NOT NULL AS ready FROM c FULL JOIN e USING (root, tool_use_id)""",
)
def k6_merge_event_summaries(children, launches):
    events = launches.where("tool_use_id IS NOT NULL").withColumn("line_number", F.col("document_id") * 1000 + F.col("line_number"))
    return agents.merge_event_summaries(children.where("tool_use_id IS NOT NULL"), events)


# --- record formats ------------------------------------------------------------------

_SPOKEN = "role IN ('user', 'assistant')"


def _lines(messages: DataFrame, record: str) -> DataFrame:
    return messages.selectExpr("document_id", "line_number", f"{record} AS text")


@query(
    "messages",
    f"""SELECT document_id, line_number, 0 AS part, concat('u', message_id) AS source_id, role, 'text' AS kind, content FROM messages WHERE {_SPOKEN} AND content <> ''
    UNION ALL SELECT document_id, line_number, 2, concat('u', message_id, ':tool_use:1'), 'tool', 'tool_use', 'run' FROM messages WHERE {_SPOKEN} AND message_id % 2 = 1""",
)
def j1_normalize_claude(messages):
    plain = "to_json(named_struct('type', role, 'uuid', concat('u', message_id), 'message', named_struct('content', content)))"
    blocks = "array(named_struct('type', 'text', 'text', content, 'name', NULL), named_struct('type', 'tool_use', 'text', NULL, 'name', 'run'))"
    mixed = plain.replace("'content', content", f"'content', {blocks}")
    return normalize.normalize_claude(_lines(messages, f"CASE WHEN message_id % 2 = 0 THEN {plain} ELSE {mixed} END")).drop("thinking", "ts")


@query(
    "messages",
    f"""SELECT document_id, line_number, NULL AS source_id, role, 'message' AS kind, content FROM messages WHERE {_SPOKEN} AND message_id % 3 > 0 AND content <> ''
    UNION ALL SELECT document_id, line_number, concat('c', message_id, ':output'), 'tool', 'function_call_output', content FROM messages WHERE message_id % 3 = 0 AND content <> ''""",
)
def j2_normalize_codex(messages):
    said = "to_json(named_struct('type', 'response_item', 'payload', named_struct('type', 'message', 'role', role, 'content', array(named_struct('type', 'text', 'text', content)))))"
    output = "to_json(named_struct('type', 'response_item', 'payload', named_struct('type', 'function_call_output', 'call_id', concat('c', message_id), 'output', content)))"
    return normalize.normalize_codex(_lines(messages, f"CASE WHEN message_id % 3 > 0 THEN {said} ELSE {output} END")).drop("part", "thinking", "ts")


@query(
    "messages",
    """SELECT document_id, line_number, CASE WHEN message_id % 3 = 0 THEN concat('c', message_id) END AS source_id, CASE WHEN message_id % 3 = 0 THEN 'tool' ELSE role END AS role,
    CASE WHEN message_id % 3 = 0 AND trim(content) = '' THEN '[Read]' ELSE trim(content) END AS content FROM messages
    WHERE message_id % 3 = 0 OR (role IN ('user', 'assistant', 'system') AND trim(content) <> '')""",
)
def j3_normalize_cursor(messages):
    said = "to_json(named_struct('role', role, 'message', named_struct('content', array(named_struct('type', 'text', 'text', content)))))"
    state = "to_json(named_struct('type', 'cursor_state_tool', 'tool_name', 'Read', 'id', concat('c', message_id), 'content', content))"
    return normalize.normalize_cursor(_lines(messages, f"CASE WHEN message_id % 3 = 0 THEN {state} ELSE {said} END")).select("document_id", "line_number", "source_id", "role", "content")


@query("messages", f"SELECT document_id, line_number, CASE WHEN message_id % 4 = 0 THEN 'system' WHEN message_id % 4 = 1 THEN 'tool' ELSE role END AS role, trim(content) AS content FROM messages WHERE trim(content) <> '' AND (message_id % 4 < 2 OR {_SPOKEN})")
def j4_normalize_openclaw(messages):
    record = """CASE message_id % 4 WHEN 0 THEN to_json(named_struct('type', 'compaction', 'summary', trim(content))) WHEN 1 THEN to_json(named_struct('type', 'tool_result', 'data', trim(content)))
        WHEN 2 THEN to_json(named_struct('type', 'message', 'message', named_struct('role', role, 'content', content)))
        ELSE to_json(named_struct('type', 'message', 'message', to_json(named_struct('role', role, 'content', concat('[[reply_to_current]] ', content))))) END"""
    return normalize.normalize_openclaw(_lines(messages, record)).select("document_id", "line_number", "role", "content")


@query(
    "messages",
    """, p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY message_id) AS place FROM messages)
    SELECT document_id, place AS line_number, CASE WHEN message_id % 5 = 0 THEN 'tool' ELSE role END AS role, CASE WHEN message_id % 5 = 0 THEN concat('run', message_id % 2) ELSE 'text' END AS kind, trim(content) AS content
    FROM p WHERE trim(content) <> '' AND (message_id % 5 = 0 OR role IN ('user', 'assistant', 'tool'))""",
)
def j5_normalize_hermes(messages):
    tool = F.col("message_id") % 5 == 0
    calls = F.expr("array(named_struct('id', CAST(message_id AS string), 'function', named_struct('name', concat('run', message_id % 2))))")
    said = F.struct("message_id", F.when(tool, "tool").otherwise(F.col("role")).alias("role"), "content", F.when(tool, F.col("message_id").cast("string")).alias("tool_call_id"), F.when(tool, calls).alias("tool_calls"))
    sessions = messages.groupBy("document_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(said)).alias("messages"))).alias("text"))
    return normalize.normalize_hermes(sessions).select("document_id", "line_number", "role", "kind", "content")


@query("conv_docs", "SELECT document_id, CASE WHEN tool_id = 'codex' THEN coalesce(root_session_id, thread) ELSE coalesce(nullif(regexp_extract(relative_path, '([^/]+)/subagents/', 1), ''), thread) END AS root FROM conv_docs")
def k2_root_thread(conv_docs):
    return conv_docs.select("document_id", hierarchy.root_thread().alias("root"))


@query("messages", "SELECT document_id, line_number, ts, substr(content, 1, 500) AS prompt FROM messages WHERE role = 'user' AND trim(content) <> '' AND NOT contains(content, '[Subagent Context]')")
def n13_prompt_projection(messages):
    return ingest.prompt_projection(messages)


# --- project pages and sources -------------------------------------------------------


@query("docs", r"SELECT machine_id, tool_id, concat('/home/', project) AS root, CASE WHEN document_id % 4 > 0 THEN concat('C:/a+', document_id, ' x%') END AS path FROM docs")
def a7_clean_discovery(docs):
    path = F.concat(F.lit("\\\\?\\C:/a+"), "document_id", F.lit("%20x%25"))
    projects = F.when(F.col("document_id") % 4 > 0, F.array(F.struct(path.alias("path")))).otherwise(F.array().cast("array<struct<path: string>>"))
    tool = F.struct(F.concat(F.lit("%2Fhome%2F"), "project").alias("root"), projects.alias("projects"))
    return reports.clean_discovery(docs.select("machine_id", F.to_json(F.create_map("tool_id", tool)).alias("content")))


@query(
    "docs messages",
    """, n AS (SELECT * FROM docs WHERE tool_id = 'codex' QUALIFY row_number() OVER (PARTITION BY machine_id, relative_path ORDER BY synced DESC, document_id DESC) = 1),
    a AS (SELECT document_id, max(ts) AS ts FROM messages WHERE role IN ('user', 'assistant') GROUP BY 1)
    SELECT document_id, coalesce(ts, synced) AS active_at FROM n LEFT JOIN a USING (document_id) ORDER BY active_at DESC, document_id LIMIT 40 OFFSET 3""",
)
def k12_list_files(docs, messages):
    return reports.list_files(docs, aggregates.last_activity(messages).withColumnRenamed("last_ts", "ts"), F.col("tool_id") == "codex", 3, 40).select("document_id", "active_at")


@query(
    "docs",
    """SELECT project, category, document_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY project, category) AS total FROM docs
    WINDOW w AS (PARTITION BY project, category ORDER BY synced DESC, document_id) QUALIFY place <= 15""",
)
def k13_project_detail(docs):
    return reports.project_detail(docs).select("project", "category", "document_id", "place", "total")


@query(
    "messages conv_docs",
    """SELECT root, message_id FROM messages JOIN conv_docs USING (document_id)
    QUALIFY least(row_number() OVER (PARTITION BY root ORDER BY ts, document_id, line_number), row_number() OVER (PARTITION BY root ORDER BY ts DESC, document_id DESC, line_number DESC)) <= 5""",
)
def k11_project_conversations(messages, conv_docs):
    return reports.project_conversations(messages, conv_docs, 5).select("root", "message_id")


@query("messages", "SELECT document_id, document_id % 3 > 0 AND document_id % 5 > 0 AS proven FROM messages GROUP BY document_id")
def n24_prove_snapshot(messages):
    stats = messages.groupBy("document_id").agg(F.count("*").alias("lines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    recorded = stats.where("document_id % 5 > 0").withColumn("last_ts", F.when(F.col("document_id") % 3 > 0, F.col("last_ts")))
    return reports.prove_snapshot(stats, recorded)


@query(
    "launches",
    """, t AS (SELECT * FROM launches QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY line_number DESC) <= 5)
    SELECT document_id, identity AS call_id, max_by(status, line_number) AS status FROM t WHERE identity IS NOT NULL GROUP BY ALL""",
)
def o10_live_signals(launches):
    return reports.live_signals(launches.withColumn("call_id", F.col("identity")), 5)
