"""Streaming forms of the live paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.operators import ingest

ENDED = ("completed", "failed", "cancelled")


def day_counts(signals: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Signals by day and status; late ones count until the watermark passes their day."""
    return signals.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "status").agg(F.count("*").alias("n")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "status", "n"
    )


def quiet_windows(signals: DataFrame, gap: str = "600 seconds", lateness: str = "1 hour") -> DataFrame:
    """Runs of a document's signals without a gap, each with its latest event: one trigger for each run."""
    return signals.withWatermark("ts", lateness).groupBy("document_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")
    ).select("document_id", F.unix_seconds("w.start").alias("start_ts"), "n", "event_id")


def event_dedup(signals: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return signals.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def _advance(state: tuple | None, events: list[tuple]) -> tuple | None:
    """The state (status, start, last) after events (ts, status) in order: an end is final, and needs a start."""
    for ts, status in sorted(events, key=lambda e: (e[0], e[1] in ENDED)):
        if state is None:
            if status == "running":
                state = (status, ts, ts)
        elif state[0] == "running" and (ts > state[2] or ts == state[2] and status in ENDED):
            state = (status, state[1], ts)
    return state


def activity_state(signals: DataFrame) -> DataFrame:
    """Latest state of each activity of ``signals(activity_id, ts, status)``, updated as signals arrive."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now: Any = state.get if state.exists else None
        events = [(int(t), s) for f in frames for t, s in zip(f["seconds"], f["status"], strict=True)]
        now = _advance(now, events)
        if now is not None:
            state.update(now)
            yield pd.DataFrame({"activity_id": [key[0]], "status": [now[0]], "start_ts": [now[1]], "last_ts": [now[2]]})

    rows = signals.select("activity_id", "status", F.unix_seconds("ts").alias("seconds"))
    return rows.groupBy("activity_id").applyInPandasWithState(
        update, "activity_id long, status string, start_ts long, last_ts long", "status string, start_ts long, last_ts long", "update", GroupStateTimeout.NoTimeout
    )


def activity_state_batch(signals: DataFrame) -> DataFrame:
    """The batch form: the first start, and the first end at or behind the newest start before any end."""
    running = signals.where("status = 'running'").groupBy("activity_id").agg(F.min("ts").alias("start"))
    behind = signals.join(running, "activity_id").where("ts >= start")
    end = F.min(F.when(F.col("status").isin(*ENDED), F.struct("ts", F.col("event_id"), "status")))
    folded = behind.groupBy("activity_id").agg(F.first("start").alias("start"), end.alias("e"), F.max(F.when(F.col("status") == "running", F.col("ts"))).alias("last"))
    return folded.select(
        "activity_id", F.coalesce("e.status", F.lit("running")).alias("status"), F.unix_seconds("start").alias("start_ts"),
        F.unix_seconds(F.coalesce("e.ts", "last")).alias("last_ts"),
    )


def stream_transcripts(spark: SparkSession, path: str, normalize: Callable[[DataFrame], DataFrame], max_files: int = 1000) -> DataFrame:
    """Message rows of delivered transcript files as they arrive, each file once by the query's checkpoint.

    ``normalize`` is one of the line formats of ``sources.normalize``; a file is read by one task.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(path)
    lines = files.select(F.col("_metadata.file_path").alias("document_id"), F.posexplode(F.split("value", "\n")).alias("place", "text"))
    return normalize(lines.where("trim(text) <> ''").select("document_id", (F.col("place") + 1).alias("line_number"), "text"))


def update_read_model(messages: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps the read model of streamed messages: after batch n it lies in ``folder/batch=n``.

    A batch is merged with the model before it and overwrites its own folder, so a repeated batch counts once.
    """

    def merge(batch: DataFrame, n: int) -> None:
        delta = ingest.refresh_read_model(batch)
        model = delta if n == 0 else ingest.merge_read_model(batch.sparkSession.read.schema(delta.schema).parquet(f"{folder}/batch={n - 1}"), delta)
        model.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return messages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
