"""Queries that run keyed streams over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.queries.registry import stream_query
from threadloom.streaming import keyed
from threadloom.streaming.runs import run_available


@stream_query(
    "deliveries",
    """, o AS (SELECT source, byte_offset, bool_or(mode = 'full' OR base_offset = byte_offset - 100) AS fits FROM deliveries GROUP BY source, byte_offset),
    n AS (SELECT source, byte_offset, fits AND byte_offset = 100 * row_number() OVER (PARTITION BY source ORDER BY byte_offset) AS follows FROM o),
    c AS (SELECT source, byte_offset, bool_and(follows) OVER (PARTITION BY source ORDER BY byte_offset) AS chained FROM n)
    SELECT source, count(*) AS accepted, max(byte_offset) AS end_offset FROM c WHERE chained GROUP BY source""",
)
def o9_contiguous_deltas(deliveries):
    timed = deliveries.withColumns({"at": F.col("delivered").cast("timestamp"), "ts": F.unix_seconds(F.col("delivered").cast("timestamp"))})
    rows = run_available(keyed.contiguous_deltas(timed), "o9")
    return rows.where("disposition = 'accepted'").groupBy("source").agg(F.count("*").alias("accepted"), F.max("byte_offset").alias("end_offset"))


@stream_query(
    "inbox_rows",
    """, d AS (SELECT session, min(ts) AS arrived FROM inbox_rows WHERE is_document GROUP BY session),
    s AS (SELECT i.*, arrived, ts + CASE kind WHEN 'activity' THEN 172800 WHEN 'interaction' THEN 604800 ELSE 2592000 END AS expires
          FROM inbox_rows i JOIN d USING (session) WHERE NOT is_document),
    b AS (SELECT *, row_number() OVER (PARTITION BY session, signal_id ORDER BY ts DESC) AS n FROM s WHERE ts < arrived)
    SELECT session, signal_id, payload, arrived AS applied_at FROM b WHERE n = 1 AND expires > arrived
    UNION ALL SELECT session, signal_id, payload, ts FROM s WHERE ts >= arrived""",
)
def o7_inbox(rows):
    return run_available(keyed.inbox(rows.withColumn("at", F.timestamp_seconds("ts")), "3650 days"), "o7")


_LAST = "row_number() OVER (PARTITION BY document_id, interaction_id ORDER BY ts DESC)"


@stream_query(
    "question_events",
    f""", e AS (SELECT *, {_LAST} AS n, ts + 604800 > (SELECT max(ts) FROM question_events) - 3600 AS young FROM question_events WHERE status <> 'human'),
    a AS (SELECT document_id, fingerprint, ts, status FROM e WHERE kind = 'ask'),
    w AS (SELECT document_id, interaction_id FROM e p WHERE kind = 'wrapper' AND status = 'pending' AND young
            AND coalesce((SELECT max_by(status, ts) FROM a WHERE a.document_id = p.document_id AND a.fingerprint = p.fingerprint AND a.ts < p.ts), '') <> 'pending'
            AND NOT EXISTS (SELECT 1 FROM a WHERE a.document_id = p.document_id AND a.fingerprint = p.fingerprint AND a.ts > p.ts AND a.status = 'pending')
            AND NOT EXISTS (SELECT 1 FROM e r WHERE r.document_id = p.document_id AND r.interaction_id = p.interaction_id AND r.ts > p.ts AND r.status <> 'pending')),
    p AS (SELECT DISTINCT document_id, interaction_id FROM w UNION SELECT document_id, interaction_id FROM e WHERE kind <> 'wrapper' AND n = 1 AND status = 'pending' AND young),
    f AS (SELECT document_id, interaction_id, min(ts) AS opened FROM e WHERE kind = 'permission' AND status = 'pending' GROUP BY ALL),
    h AS (SELECT document_id, interaction_id, opened, max_by(status, ts) AS status FROM e JOIN f USING (document_id, interaction_id) WHERE ts >= opened GROUP BY ALL)
    SELECT document_id, coalesce((SELECT string_agg(interaction_id, ',' ORDER BY interaction_id) FROM p WHERE p.document_id = d.document_id), '') AS pending,
           coalesce((SELECT string_agg(concat(interaction_id, ':', status), ',' ORDER BY opened DESC, interaction_id) FROM h WHERE h.document_id = d.document_id), '') AS history
    FROM (SELECT DISTINCT document_id FROM question_events) d""",
)
def o5_interaction_state(events):
    rows = run_available(keyed.interaction_state(events.withColumn("at", F.timestamp_seconds("ts"))), "o5")
    last = rows.groupBy("document_id").agg(F.max_by(F.struct("pending", "history"), "revision").alias("x"))
    return last.select("document_id", F.array_join("x.pending", ",").alias("pending"), F.array_join("x.history", ",").alias("history"))


@stream_query(
    "title_events",
    """, RECURSIVE_STEPS AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts, place) AS n FROM title_events),
    r AS (SELECT document_id, cast(0 AS bigint) AS n, cast(NULL AS varchar) AS title, cast(NULL AS varchar) AS source, [0, 0, 0]::bigint[] AS clocks, cast(0 AS bigint) AS updates
          FROM (SELECT DISTINCT document_id FROM title_events)
          UNION ALL
          SELECT document_id, n,
                 CASE WHEN kind = 'manual' OR applied THEN t ELSE title END,
                 CASE WHEN kind = 'manual' OR applied THEN kind ELSE source END,
                 CASE WHEN kind = 'manual' OR ignored THEN clocks ELSE list_transform(clocks, lambda c, i: CASE WHEN i = m THEN revision ELSE c END) END,
                 updates + CASE WHEN applied AND t IS DISTINCT FROM title THEN 1 ELSE 0 END
          FROM (SELECT *, kind <> 'manual' AND NOT ignored AND NOT (coalesce(source = 'manual', false) OR (coalesce(source = 'custom', false) AND kind <> 'custom')) AS applied
                FROM (SELECT r.document_id, s.n, r.title, r.source, r.clocks, r.updates, s.title AS t, s.kind, s.revision, cast(substr(s.machine, 2) AS int) + 1 AS m,
                             coalesce(s.kind <> 'manual' AND s.revision < r.clocks[cast(substr(s.machine, 2) AS int) + 1] AND s.title = r.title, false) AS ignored
                      FROM r JOIN RECURSIVE_STEPS s ON s.document_id = r.document_id AND s.n = r.n + 1)))
    SELECT document_id, max_by(title, n) AS title, max_by(source, n) AS source, max(updates) AS updates,
           max_by(array_to_string(list_filter(list_transform(clocks, lambda c, i: CASE WHEN c > 0 THEN concat('m', i - 1, '=', c) END), lambda x: x IS NOT NULL), ','), n) AS clocks
    FROM r GROUP BY document_id""",
)
def o8_title_revisions(titles):
    rows = run_available(keyed.title_revisions(titles), "o8")
    last = rows.groupBy("document_id").agg(F.max_by(F.struct("title", "source", "updates", "clocks"), "revision").alias("x"))
    return last.select("document_id", "x.title", "x.source", "x.updates", F.array_join("x.clocks", ",").alias("clocks"))
