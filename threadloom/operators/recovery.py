"""Recovered prompts, semantic rows and rebuilt transcripts put back into stored timelines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds between a prompt and its record in the history, and kinds of rows that a parser adds later.
TOLERANCE = 300
SEMANTIC = ("agent_event", "reasoning")
#: What a recovered prompt is stored as.
RECOVERED = "history_user_message"


def match_in_order(source: np.ndarray, history: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Pairs of places (history, source) of two ordered arrays of times that keep both orders.

    As many as possible are paired, at most ``tolerance`` apart, then with the least total distance;
    among equals the earlier rows of the history. A NaN time is no distance from any. Only every
    so many rows of the table of scores are kept, the ones between are computed again on the way back.
    """
    n, m = len(history), len(source)
    limit = round(tolerance * 1000)
    gain = limit * min(n, m) + 1

    def row(above: np.ndarray, i: int) -> np.ndarray:
        apart = np.rint(np.nan_to_num(np.abs(source - history[i])) * 1000).astype(np.int64)
        paired = np.where(apart <= limit, above[:-1] + gain - apart, -1)
        return np.maximum.accumulate(np.maximum(above, np.concatenate([[0], paired])))

    step = max(1, math.isqrt(n))
    kept = [np.zeros(m + 1, np.int64)]
    below = kept[0]
    for i in range(n):
        below = row(below, i)
        if (i + 1) % step == 0:
            kept.append(below)
    pairs, j = [], m
    for start in range((n - 1) // step * step, -1, -step):
        block = [kept[start // step]]
        for i in range(start, min(start + step, n)):
            block.append(row(block[-1], i))
        for i in range(len(block) - 1, 0, -1):
            while j and block[i][j] != block[i - 1][j] and block[i][j] == block[i][j - 1]:
                j -= 1
            if j and block[i][j] != block[i - 1][j]:
                pairs.append((start + i - 1, j - 1))
                j -= 1
    return pairs[::-1]


def match_recovered_prompts(source: DataFrame, history: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """document_id, key, source_key: each recovered prompt and the source row that holds it, null where it is missing.

    Both ``(document_id, key, content, ts)``, keys long. Rows of one document and text are paired by
    ``match_in_order``. Since partners are at most ``tolerance`` seconds apart, a text's rows are
    matched in runs without a longer gap, each by itself; a text that holds a row without a time
    stays whole, as that row may pair with any.
    """
    rows = source.withColumn("_side", F.lit(0)).unionByName(history.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rows = rows.select("document_id", "key", F.sha2("content", 256).alias("text"), F.col("ts").cast("double").alias("ts"), "_side")
    group = Window.partitionBy("document_id", "text")
    order = group.orderBy(F.asc_nulls_last("ts"), "_side", "key")
    gap = (F.col("ts") - F.lag("ts").over(order) > tolerance) & (F.count_if(F.isnull("ts")).over(group) == 0)
    runs = rows.withColumn("_new", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("run", F.sum("_new").over(order))
    run = Window.partitionBy("document_id", "text", "run")
    runs = runs.withColumn("_sides", F.count_if(F.col("_side") == 0).over(run) * F.count_if(F.col("_side") == 1).over(run))

    def paired(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """The pairs of whole runs, which begin at ``starts``; within each its source rows come first."""
        times, keys = frame["ts"].to_numpy(float), frame["key"].to_numpy()
        sizes = np.diff([*starts, len(frame)])
        middles = starts + np.add.reduceat((frame["_side"] == 0).to_numpy().astype(int), starts)
        # most runs are one row on each side
        lone = (sizes == 2) & (middles - starts == 1)
        one = starts[lone]
        near = np.rint(np.nan_to_num(np.abs(times[one] - times[one + 1])) * 1000) <= round(tolerance * 1000)
        to, at = list(one[near]), list(one[near] + 1)
        for start, middle, size in zip(starts[~lone], middles[~lone], sizes[~lone], strict=True):
            for i, j in match_in_order(times[start:middle], times[middle : start + size], tolerance):
                at.append(middle + i)
                to.append(start + j)
        at, to = np.array(at, int), np.array(to, int)
        return pd.DataFrame({"document_id": frame["document_id"].to_numpy()[at], "key": keys[at], "source_key": keys[to]})

    def matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # parts of the run that is not yet at its end
        for frame in frames:
            rows = pd.concat([held[-1].iloc[-1:], frame]) if held else frame
            cuts = np.zeros(len(rows) - 1, bool)
            for name in ("document_id", "text", "run"):
                column = rows[name].to_numpy()
                cuts |= column[1:] != column[:-1]
            begun = np.flatnonzero(cuts) + (0 if held else 1)
            if not len(begun):
                held.append(frame)
                continue
            whole = pd.concat([*held, frame.iloc[: begun[-1]]])
            before = len(whole) - begun[-1]
            yield paired(whole, np.unique([0, *(begun[:-1] + before)]))
            held = [frame.iloc[begun[-1] :]]
        if held:
            yield paired(pd.concat(held), np.array([0]))

    document, run = source.schema["document_id"].dataType.simpleString(), ["document_id", "text", "run"]
    found = runs.where("_sides > 0").select(*run, "key", "ts", "_side").repartition(*run).sortWithinPartitions(*run, "_side", F.asc_nulls_last("ts"), "key")
    found = found.mapInPandas(matched, f"document_id {document}, key long, source_key long")
    return history.select("document_id", "key").join(found, ["document_id", "key"], "left")


def insert_before(timeline: DataFrame, inserts: DataFrame, order: list[Column]) -> DataFrame:
    """``timeline`` and ``inserts`` as one timeline: an insert takes its ``anchor``'s line, what follows moves down.

    Both share their columns (document_id, line_number and others); ``inserts`` has ``anchor`` besides,
    and ``order`` ranks those of one anchor. Gaps in the line numbers stay.
    """
    rows = timeline.withColumns({"anchor": F.col("line_number"), "_new": F.lit(0)}).unionByName(inserts.withColumn("_new", F.lit(1)))
    place = Window.partitionBy("document_id").orderBy("anchor", F.desc("_new"), *order)
    shift = F.sum("_new").over(place.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("line_number", F.col("anchor") + F.coalesce(shift, F.lit(0))).select(*timeline.columns)


def anchor_by_time(rows: DataFrame, timeline: DataFrame) -> DataFrame:
    """``rows(document_id, ts, …)`` with ``anchor``: the line of the first timeline row of a later time, else the line behind the last.

    ``timeline(document_id, line_number, ts)``; rows without a time go to the end.
    """
    last = timeline.groupBy("document_id").agg(F.max("line_number").alias("_last"))
    marks = timeline.where("ts is not null").groupBy("document_id", "ts").agg(F.min("line_number").alias("_line"))
    both = rows.withColumn("_line", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True).withColumn("_mark", F.col("_line").isNotNull())
    # behind the marks of its own time, a row's anchor is the next mark
    order = Window.partitionBy("document_id").orderBy(F.asc_nulls_last("ts"), F.desc("_mark")).rowsBetween(1, Window.unboundedFollowing)
    placed = both.withColumn("_later", F.first("_line", ignorenulls=True).over(order)).where("not _mark")
    end = F.coalesce("_last", F.lit(0)) + 1
    return placed.join(last, "document_id", "left").withColumn("anchor", F.coalesce("_later", end)).select(*rows.columns, "anchor")


def _unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys (none null) no other row of the document has."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    alone = F.count("*").over(Window.partitionBy("document_id", *keys)) == 1
    return rows.where(known).withColumn("_alone", alone).where("_alone").drop("_alone")


def align(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """document_id, position, line: parsed rows and the stored rows they are, by keys that are unique on both sides.

    First by (role, message_type, source_id), then what is left by (role, message_type, content).
    Semantic rows take no part.
    """
    plain = ~F.coalesce(F.col("message_type").isin(*SEMANTIC), F.lit(False))
    source = F.nullif(F.trim("source_id"), F.lit(""))
    keyed = {"_source": source, "_text": F.sha2("content", 256)}
    left = parsed.where(plain).withColumns(keyed).select("document_id", "position", "role", "message_type", "_source", "_text")
    right = stored.where(plain).withColumns(keyed).select("document_id", F.col("line_number").alias("line"), "role", "message_type", "_source", "_text")
    found = None
    for key in ("_source", "_text"):
        keys = ["role", "message_type", key]
        if found is not None:
            left, right = left.join(found, ["document_id", "position"], "left_anti"), right.join(found, ["document_id", "line"], "left_anti")
        pairs = _unique(left, keys).select("document_id", "position", *keys).join(_unique(right, keys).select("document_id", "line", *keys), ["document_id", *keys])
        pairs = pairs.select("document_id", "position", "line")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def semantic_inserts(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """The parsed semantic rows that are not stored, with the stored line (``anchor``) they belong before.

    ``parsed(document_id, position, role, message_type, source_id, content, ts)`` and ``stored``, the same
    with line_number instead of position. The anchor is the line of the next aligned row of the
    parsed order; behind the last one that of the first stored row of a later time; else the end.
    """
    name = F.coalesce(F.nullif(F.trim("source_id"), F.lit("")), F.sha2(F.concat_ws("\x00", "content", F.col("ts").cast("string")), 256))
    semantic = F.col("message_type").isin(*SEMANTIC)
    known = stored.where(semantic).select("document_id", "message_type", name.alias("_name")).distinct()
    missing = parsed.where(semantic).withColumn("_name", name).join(known, ["document_id", "message_type", "_name"], "left_anti").drop("_name")
    aligned = align(parsed, stored)
    both = missing.withColumn("line", F.lit(None).cast("long")).unionByName(aligned, allowMissingColumns=True).withColumn("_aligned", F.col("line").isNotNull())
    order = Window.partitionBy("document_id").orderBy("position").rowsBetween(1, Window.unboundedFollowing)
    placed = both.withColumn("_next", F.first("line", ignorenulls=True).over(order)).where("not _aligned").select(*missing.columns, "_next")
    timed = anchor_by_time(placed, stored.select("document_id", "line_number", "ts"))
    return timed.withColumn("anchor", F.coalesce("_next", "anchor")).drop("_next")


def align_and_insert(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """``stored`` with the missing semantic rows of ``parsed`` at their places, lines numbered anew."""
    found = semantic_inserts(parsed, stored).withColumn("line_number", F.lit(None).cast("long"))
    rows = insert_before(stored.withColumn("position", F.lit(None).cast("long")), found.select(*stored.columns, "position", "anchor"), [F.col("position")])
    return rows.drop("position")


def backfill_overlays(stored: DataFrame, parsed: DataFrame, columns: list[str]) -> DataFrame:
    """``stored`` with nulls in ``columns`` filled from ``parsed``, and ``aligned`` (line, unique, null); texts and order stay.

    Both ``(document_id, line_number, role, message_type, content, …)``. A row is itself where line and signature (role, type
    and text) agree, else where its signature occurs once on both sides among the rows that no line aligned. Of
    repeated parsed rows of one line and signature the first filled value counts.
    """
    signature = F.sha2(F.concat_ws("\x00", F.coalesce("role", F.lit("")), F.coalesce("message_type", F.lit("")), F.coalesce("content", F.lit(""))), 256)
    ours = stored.withColumn("_sign", signature)
    theirs = parsed.withColumn("_sign", signature).groupBy("document_id", "line_number", "_sign").agg(*[F.first(c, ignorenulls=True).alias(f"_{c}") for c in columns], F.lit(True).alias("_by_line"))
    by_line = ours.join(theirs, ["document_id", "line_number", "_sign"], "left")
    left = by_line.where("_by_line is null").groupBy("document_id", "_sign").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    loose = theirs.join(ours.select("document_id", "line_number", "_sign").distinct(), ["document_id", "line_number", "_sign"], "left_anti")
    lone = loose.groupBy("document_id", "_sign").agg(F.count("*").alias("_n"), *[F.first(f"_{c}", ignorenulls=True).alias(f"_u_{c}") for c in columns]).where("_n = 1").drop("_n")
    lone = lone.join(left, ["document_id", "_sign"]).withColumn("_unique", F.lit(True))
    both = by_line.join(lone, ["document_id", "_sign"], "left").withColumn("_unique", F.col("_unique") & F.col("_by_line").isNull())
    filled = {c: F.coalesce(c, f"_{c}", F.when(F.col("_unique"), F.col(f"_u_{c}"))) for c in columns}
    aligned = F.when(F.col("_by_line"), "line").when(F.col("_unique"), "unique")
    return both.withColumns(filled).select(*stored.columns, aligned.alias("aligned"))


def repair_history(messages: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Messages without recovered prompts that their source holds, the others before the next row of a later time.

    ``messages(document_id, message_id, line_number, role, message_type, content, ts)``. Recovered prompts
    are rows of type ``history_user_message``; those without a place have lines below 1.
    """
    recovered = F.col("message_type").eqNullSafe(RECOVERED)

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select("document_id", F.col("message_id").alias("key"), "content", "ts")

    source = messages.where(~recovered & (F.col("role") == "user"))
    held = match_recovered_prompts(keyed(source), keyed(messages.where(recovered)), tolerance).where("source_key is not null")
    kept = messages.join(held.select("document_id", F.col("key").alias("message_id")), ["document_id", "message_id"], "left_anti").select(*messages.columns)
    placeless = recovered & (F.col("line_number") < 1)
    timeline = kept.where(~placeless)
    marks = timeline.where(~recovered & (F.col("line_number") >= 1)).select("document_id", "line_number", "ts")
    last = timeline.groupBy("document_id").agg(F.max("line_number").alias("_end"))
    anchored = anchor_by_time(kept.where(placeless), marks).join(last, "document_id", "left")
    # behind all timed rows comes the end of the whole timeline
    behind = marks.groupBy("document_id").agg(F.max("line_number").alias("_mark"))
    anchored = anchored.join(behind, "document_id", "left").withColumn("anchor", F.when(F.col("anchor") > F.coalesce("_mark", F.lit(0)), F.coalesce("_end", F.lit(0)) + 1).otherwise(F.col("anchor")))
    return insert_before(timeline, anchored.select(*messages.columns, "anchor"), [F.asc_nulls_last("ts"), F.col("message_id")])
